"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidegrid.plans import queries as plans

HEADLINES = (
    "normalize_last_ffill", "normalize_mean", "wide_table", "resampled_mean", "rolling_mean", "rolling_median", "rolling_day_sum", "rolling_skew", "rolling_fourier",
    "mad_validator", "flatline_validator", "clean_range_average", "incident_summary", "lag_correlations", "datetime_parts", "cyclical_and_onehot", "announced_incidents", "linear_forecast",
    "series_mean_1000", "series_filled", "series_incidents", "penalised_quantiles",
)
PIPELINE = tuple(f"op{n}_" for n in (9, 10, 6, 5, 4, 1, 3, 2, 8, 11, 12, 13, 7))


def main() -> None:
    """Warm-ups of a plain and of a Python query, then each query once, written to nowhere."""
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {n: plans.queries()[n] for n in HEADLINES}
    try:
        import corpus_pipeline
        from tidegrid.llm import queries as llm

        found |= {name: q for n in PIPELINE for name, q in llm.queries().items() if name.startswith(n)} | {"pipeline": corpus_pipeline.run}
    except ImportError as e:
        if e.name not in ("corpus_pipeline", "tidegrid.llm", "tidegrid.llm.queries"):
            raise
    found["clean_above_clip"] = plans.queries()["clean_above_clip"]
    for name in ("clean_above_clip", "rolling_day_sum"):
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name, query in found.items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

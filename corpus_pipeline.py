"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secret scans, packing.

Each stage gets its predecessor's rows, written as Parquet and read again, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontam, ngram_join, packing, quality_rules, secrets_scan
from tidegrid.llm.store import scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base checks or the learned rules reject."""
    return quality_rules.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents that are mostly such passages go."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, sources mixed by their tokens to the power 0.7."""
    return packing.pack(docs, temperature=0.7)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("mixture_packing", pack),
]

#: Learned rules and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What the stages hand on goes as the last one's rows are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope() as whole:
        for name, stage in STAGES:
            with scope() as here:  # what a stage writes on its way goes as its result is there
                docs = here.result(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return whole.result(docs, "pipeline")

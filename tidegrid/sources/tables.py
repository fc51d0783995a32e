"""Tables kept as files: CSV data sets, and a store of one table with get, add and empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_sensor_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, time_col: str | None = None) -> DataFrame:
    """A CSV with a header whose first column is the time (named ``time_col`` on request). Without a schema, types are
    inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    first = df.columns[0]
    df = df.withColumn(first, df[f"`{first}`"].cast("timestamp"))
    return df.withColumnRenamed(first, time_col) if time_col else df


def load_rainbow_beach(spark: SparkSession, path: str) -> DataFrame:
    """The beach data set: six measurements by time."""
    names = ("battery_life", "transducer_depth", "turbidity", "water_temperature", "wave_height", "wave_period")
    return read_sensor_csv(spark, path, "TIME timestamp, " + ", ".join(f"{n} double" for n in names))


def load_sewage_data(spark: SparkSession, path: str) -> DataFrame:
    """The sewage data set: four discharges, precipitation and temperature by time."""
    names = ("Discharge_Hoofdgemaal", "Discharge_Sportlaan", "Discharge_Emmastraat", "Discharge_Kerkstraat", "Precipitation", "Temperature")
    return read_sensor_csv(spark, path, "TIME timestamp, " + ", ".join(f"{n} double" for n in names))


class TableStore:
    """One table in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema

    def _there(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def get(self, query: str | Column | None = None) -> DataFrame:
        """The rows that fulfil a condition, or all."""
        if not self._there():
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).parquet(self.path)
        return df if query is None else df.where(query)

    def add(self, rows: DataFrame) -> TableStore:
        """Appends rows."""
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)
        return self

    def empty(self) -> TableStore:
        """Removes all rows."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)
        return self

"""Column names: quoting, and groups written before a separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def group_of(name: str, sep: str = "#") -> str:
    """What stands before the first separator."""
    return name.split(sep, 1)[0]


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all floating columns: inside the engine only NULL is missing."""
    return df.select(*[F.when(~F.isnan(col(n)), col(n)).alias(n) if t in ("double", "float") else col(n) for n, t in df.dtypes])

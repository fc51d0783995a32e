"""Hooks for users' functions, and logs of what a step changes."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

log = logging.getLogger("tidegrid")


class FeatureEngineer:
    """A function of a table to a table as a transformer that remembers the names it returns."""

    def __init__(self, function: Callable[..., DataFrame], **options):
        self.function, self.options, self.names = function, options, None

    def transform(self, df: DataFrame) -> DataFrame:
        """The function's result."""
        out = df.transform(self.function, **self.options)
        self.names = out.columns
        return out

    def get_feature_names_out(self) -> list[str]:
        """Names of the last result."""
        if self.names is None:
            raise ValueError("transform first")
        return self.names


def log_new_columns(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Logs the columns that a step adds and drops; nothing is computed."""

    @functools.wraps(function)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        out = function(df, *args, **kwargs)
        log.info("%s: new columns %s, dropped %s", function.__name__, sorted(set(out.columns) - set(df.columns)), sorted(set(df.columns) - set(out.columns)))
        return out

    return run


def log_dataframe_characteristics(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Logs the schema that a step returns; nothing is computed."""

    @functools.wraps(function)
    def run(*args, **kwargs) -> DataFrame:
        out = function(*args, **kwargs)
        log.info("%s: %d columns %s", function.__name__, len(out.columns), dict(out.dtypes))
        return out

    return run

"""User functions over rows and batches.

Built-in column expressions come first; these are for code that has none.
Each runs on Arrow batches, never row by row across the JVM border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StructType

from proseforge.session import small_batches


def map_values(column: Column, fn: Callable[[object], object], returns: DataType) -> Column:
    """Apply a Python function to every non-null value of a column."""

    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return apply(column)


def keep_where(df: DataFrame, column: str, test: Callable[[object], bool]) -> DataFrame:
    """Rows whose value passes a Python predicate; nulls do not."""
    small_batches(df.sparkSession)
    return df.filter(F.coalesce(map_values(F.col(column), test, BooleanType()), F.lit(False)))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """Apply a function to batches of rows; it may drop or add rows and columns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)

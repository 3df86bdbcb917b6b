"""Positional zip, first-match join, resume filter and skew-safe lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseforge.operators.dedup import first_wins
from proseforge.operators.numbering import number_rows

HOT_KEYS = 10_000


def zip_rows(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str],
    left_bucket: Column, right_bucket: Column,
) -> DataFrame:
    """Pair the i-th row of both sides; the longer side loses its surplus."""
    a = number_rows(left, left_order, left_bucket)
    b = number_rows(right, right_order, right_bucket)
    return a.join(b, "row_no")


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join that takes the first matching row of ``right``."""
    key = F.struct(*[F.col(k) for k in keys])
    return left.join(first_wins(right, key, order), list(keys), "left")


def pending(wanted: DataFrame, sentences: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of ``wanted`` whose key has fewer than ``n`` sentence rows."""
    done = sentences.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return wanted.join(done.drop("_n"), list(keys), "left_anti")


def lookup(
    big: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str],
    row_id: Sequence[str], hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left-join ``values`` of a keyed table onto ``big``, safe against hot keys.

    The most frequent keys of ``big`` itself are looked up by a broadcast that
    ``limit`` bounds.  Their rows then go through the shuffle join under
    scattered keys that match nothing, so no task receives a hot key.
    ``keys`` must be non-negative integers, one table row per key.
    """
    hot = (
        big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), *keys).limit(hot_keys).select(*keys)
    )
    found = table.select(*keys, *values).join(F.broadcast(hot), list(keys))
    hot_rows = hot.join(found, list(keys), "left").select(
        *keys, F.struct(*values).alias("_hot"), F.lit(True).alias("_is_hot")
    )
    out = big.join(F.broadcast(hot_rows), list(keys), "left")
    scatter = -1 - F.pmod(F.xxhash64(*row_id), F.lit(1 << 30))
    renamed = table.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)],
    )
    for i, k in enumerate(keys):
        out = out.withColumn(f"_j{i}", F.when(F.col("_is_hot"), scatter).otherwise(F.col(k).cast("long")))
    condition = [F.col(f"_j{i}") == F.col(f"_k{i}") for i in range(len(keys))]
    out = out.join(renamed, condition, "left")
    for i, v in enumerate(values):
        out = out.withColumn(v, F.when(F.col("_is_hot"), F.col(f"_hot.{v}")).otherwise(F.col(f"_v{i}")))
    return out.select(*big.columns, *values)

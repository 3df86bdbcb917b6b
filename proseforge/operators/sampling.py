"""Slices, shuffles, splits, balancing and weighted draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseforge.functions import text as T
from proseforge.functions.draws import randint, uniform
from proseforge.operators.numbering import (
    among_smallest,
    id_bucket,
    key_bucket,
    number_rows,
    running_sum,
    smallest_k,
)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return window_slice(df, 0, n, order)


def window_slice(df: DataFrame, start: int, n: int | None, order: Sequence[str]) -> DataFrame:
    """Skip ``start`` rows, then take ``n`` (or all), in the order of columns of any types.

    Rows are numbered in ranges of their keys, so no task holds more than a range, however long the
    slice.  Rows with equal keys are ordered by a hash of the other columns, which also spreads a
    frequent key over several ranges.  Nulls come first.
    """
    others = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    keyed = df.withColumn("_tie", F.xxhash64(*others)).withColumn("_key", F.struct(*order, "_tie"))
    rows = number_rows(keyed, ["_key"], key_bucket(keyed, [*order, "_tie"]), out="_row").filter(F.col("_row") > start)
    return (rows if n is None else rows.filter(F.col("_row") <= start + n)).drop("_row", "_key", "_tie")


def shuffled(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Rows in a reproducible random order (a range-partitioned sort)."""
    return df.orderBy(uniform(seed, "shuffle", *[F.col(k) for k in keys]), *keys)


def sample_rows(df: DataFrame, n: int, seed: int, keys: Sequence[str], name: str = "sample") -> DataFrame:
    """``n`` rows without replacement, or all when there are fewer."""
    return smallest_k(df, n, uniform(seed, name, *[F.col(k) for k in keys]), keys)


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.1, seed: int = 42, exact: bool = True
) -> DataFrame:
    """Add ``split``: exactly ``ceil(test_size * rows)`` rows are test.

    ``exact=False`` thresholds the draw instead: one pass, and the share is
    ``test_size`` in expectation.
    """
    draw = uniform(seed, "split", *[F.col(k) for k in keys])
    if not exact:
        return df.withColumn("split", F.when(draw < test_size, "test").otherwise("train"))
    n_test = math.ceil(test_size * df.count())
    is_test = among_smallest(df, n_test, draw, keys)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def class_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per class, and the size of the smallest class beside each."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # One row per class remains, so the window over all of them is small.
    return counts.withColumn("smallest", F.min("n").over(Window.partitionBy()))


def balanced(
    df: DataFrame,
    by: Sequence[str],
    seed: int,
    keys: Sequence[str],
    max_per_class: int | None = None,
) -> DataFrame:
    """Down-sample every class to the smallest one, rows drawn at random."""
    smallest = df.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
    k = min(smallest, max_per_class) if max_per_class else smallest
    draw = uniform(seed, "balance", *[F.col(c) for c in keys])
    return smallest_k(df, k, draw, keys, by)


def document_weights(df: DataFrame, key: str, length: str, buckets: int = 65536) -> DataFrame:
    """Interval [lo, hi) of each document on the line of usable positions.

    A document of n tokens owns ``max(0, n - 2)`` positions.
    """
    weight = F.greatest(F.col(length) - 2, F.lit(0)).cast("long")
    out = running_sum(df, weight, [key], id_bucket(df, key, buckets), out="hi")
    return out.withColumn("lo", F.col("hi") - weight)


def weighted_draws(
    weights: DataFrame,
    key: str,
    seed: int,
    draws_per_row: int = 64,
    positions_per_bucket: int = 65536,
) -> DataFrame:
    """Draw ``draws_per_row`` times as many documents as there are, by weight.

    Returns (draw_id, position, key).  The lookup of the interval that holds a
    position is a backward search: intervals and positions are laid out on one
    line, cut into equal stretches, and each position takes the last interval
    that starts at or before it.  Positions are uniform over the line, so the
    stretches are even and no pair of rows is ever built.  An interval that
    crosses into later stretches is repeated once in each.
    """
    total = weights.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("docs")).first()
    spark = weights.sparkSession
    n_draws = (total["docs"] or 0) * draws_per_row if total["total"] else 0
    stretch = lambda c: F.floor(c / F.lit(positions_per_bucket)).cast("long")
    draws = (
        spark.range(n_draws)
        .withColumnRenamed("id", "draw_id")
        .withColumn(
            "position",
            F.floor(uniform(seed, "doc", F.col("draw_id")) * F.lit(total["total"] or 0)).cast("long"),
        )
        .select(
            stretch(F.col("position")).alias("_stretch"),
            "position",
            F.lit(1).alias("_is_draw"),
            "draw_id",
            F.lit(None).cast(weights.schema[key].dataType).alias(key),
        )
    )
    starts = (
        weights.filter(F.col("hi") > F.col("lo"))
        .withColumn("_stretch", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.col("hi") - 1))))
        .select(
            "_stretch",
            F.greatest(F.col("lo"), F.col("_stretch") * positions_per_bucket).alias("position"),
            F.lit(0).alias("_is_draw"),
            F.lit(None).cast("long").alias("draw_id"),
            key,
        )
    )
    line = Window.partitionBy("_stretch").orderBy("position", "_is_draw").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        starts.unionByName(draws)
        .withColumn(key, F.last(key, ignorenulls=True).over(line))
        .filter(F.col("_is_draw") == 1)
        .select("draw_id", "position", key)
    )


def harvest_prompts(
    df: DataFrame, column: str, n: int, seed: int, keys: Sequence[str], words: int = 8
) -> DataFrame:
    """Distinct word fragments from a random pool of plain text lines.

    The pool is ``5 * n`` lines, taken in draw order; lines with fewer than
    ``words + 3`` tokens give nothing, and fragments equal but for case are
    kept once.
    """
    key_cols = [F.col(k) for k in keys]
    plain = df.filter(~T.is_header_or_markup(F.col(column)))
    pool = sample_rows(plain, 5 * n, seed, keys, "pool")
    words_col = F.col("_words")
    top = F.greatest(F.lit(1), F.least(F.lit(10), F.size(words_col) - words - 1))
    picked = (
        T.settle(pool, "_words", T.tokens(F.col(column)))
        .filter(F.size(words_col) >= words + 3)
        .withColumn("_start", randint(uniform(seed, "start", *key_cols), 0, top))
        .withColumn("prompt", F.array_join(F.slice(words_col, F.col("_start") + 1, words), " "))
        .withColumn("_order", F.struct(uniform(seed, "pool", *key_cols).alias("u"), *keys))
    )
    first = picked.groupBy(F.lower("prompt").alias("_fold")).agg(
        F.min_by(F.struct("prompt", *keys), "_order").alias("_row"), F.min("_order").alias("_order")
    )
    # At most 5 n rows are left, so the ordered limit is small.
    return first.orderBy("_order").limit(n).select("_row.*")


"""Row numbers, running sums and k-smallest selection without a single-task sort.

A window over a whole table, or over a class holding a third of it, runs in
one task.  Everything here works on order-preserving buckets instead: bucket
totals give each bucket its start, and only rows inside one bucket are sorted
together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseforge.session import cut_lineage

UNIFORM_BUCKETS = 65536
ID_BUCKETS = 65536
QUANTILES = 4096
KEY_BUCKETS = 1024
STRETCH = 65536


def id_bucket(df: DataFrame, column: str, buckets: int = ID_BUCKETS) -> Column:
    """An order-preserving bucket of an integer column.

    Dense ids are cut into equal ranges.  Where ids are sparse, clusters or
    outliers could put most rows into one range, so quantiles are cut instead.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    found = even_bucket(column, low, high, n, buckets)
    return _quantile_bucket(df, column, min(buckets, QUANTILES)) if found is None else found


def even_bucket(column: str, low: int | None, high: int | None, n: int, buckets: int = ID_BUCKETS) -> Column | None:
    """Equal ranges of an integer column whose ``n`` values are known to lie between two; None where they are sparse."""
    if low is None:
        return F.lit(0).cast("long")
    if int(high) - int(low) >= 4 * n:
        return None
    width = (int(high) - int(low)) // buckets + 1
    return F.floor((F.col(column) - F.lit(int(low))) / F.lit(width)).cast("long")


def _quantile_bucket(df: DataFrame, column: str, buckets: int) -> Column:
    """Number of quantile bounds at or below the value, found in two short steps."""
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = sorted(set(df.agg(F.percentile_approx(column, shares, 10 * buckets)).first()[0]))
    step = max(1, int(len(bounds) ** 0.5))
    value = F.col(column)
    count = lambda values: F.size(F.filter(values, lambda b: b <= value))
    literal = lambda values: F.array(*[F.lit(int(b)).cast("long") for b in values])
    # Coarse bounds close a block of ``step`` bounds each.
    whole = count(literal(bounds[step - 1 :: step])) if len(bounds) >= step else F.lit(0)
    rest = count(F.slice(literal(bounds), whole * step + 1, F.lit(step)))
    return (whole * step + rest).cast("long")


def key_bucket(df: DataFrame, order: Sequence[str], buckets: int = KEY_BUCKETS) -> Column:
    """An order-preserving bucket of one or more columns of any types that can be ordered.

    Bounds are the keys of some rows drawn by a hash of the key, a fixed number of which reaches the
    driver.  Whatever the bounds, equal keys share a bucket and larger keys have no smaller one.
    """
    names = [f"k{i}" for i in range(len(order))]
    keys = df.select(*[F.col(c).alias(n) for c, n in zip(order, names)])
    drawn = keys.distinct().orderBy(F.xxhash64(*names), *names).limit(buckets - 1)
    bounds = drawn.orderBy(*names).collect()
    if not bounds:
        return F.lit(0).cast("long")
    kinds = [keys.schema[n].dataType for n in names]
    literal = lambda rows: F.array(*[
        F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, kinds, names)]) for row in rows
    ])
    key = F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)])
    at_most = lambda rows: F.size(F.filter(rows, lambda b: b <= key))
    # Coarse bounds close a block of ``step`` bounds each, so two short searches find the place.
    step = max(1, int(len(bounds) ** 0.5))
    whole = at_most(literal(bounds[step - 1 :: step])) if len(bounds) >= step else F.lit(0)
    return (whole * step + at_most(F.slice(literal(bounds), whole * step + 1, F.lit(step)))).cast("long")


def _starts(totals: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exclusive running sum of bucket totals; at most ``buckets`` rows per group."""
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_start", F.coalesce(F.sum(value).over(before), F.lit(0)))


def running_sum(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    bucket: Column,
    by: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including this row.

    ``bucket`` is an order-preserving bucket of the first ``order`` column.
    With a second order column, one value of the first may hold most rows; its
    rows are then cut into stretches of the last column, and the stretch
    totals, far fewer, are summed by bucket.
    """
    if len(order) > 1:
        *first, last = order
        stretch = F.floor(F.col(last) / F.lit(STRETCH)).cast("long")
        df = df.withColumn("_stretch", stretch).withColumn("_part", value)
        keys = [*by, *first, "_stretch"]
        totals = df.groupBy(*keys).agg(F.sum("_part").alias("_sum")).withColumn(
            "_order", F.struct(*first, "_stretch")
        )
        ends = running_sum(totals, F.col("_sum"), ["_order"], bucket, by, "_end")
        before = ends.select(*keys, (F.col("_end") - F.col("_sum")).alias("_before"))
        inside = Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, 0)
        return (
            df.withColumn("_within", F.sum("_part").over(inside))
            .join(before, keys)
            .withColumn(out, F.col("_before") + F.col("_within"))
            .drop("_stretch", "_part", "_within", "_before")
        )
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    keys = [*by, "_bucket"]
    starts = _starts(df.groupBy(*keys).agg(F.sum("_value").alias("_total")), by, "_total")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum("_value").over(inside))
        .join(starts.drop("_total"), keys)
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_value", "_inside", "_start")
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    by: Sequence[str] = (),
    out: str = "row_no",
) -> DataFrame:
    """Add ``out``: the one-based position in ``order``, per ``by`` group."""
    return running_sum(df, F.lit(1), order, bucket, by, out).withColumn(out, F.col(out).cast("long"))


def _draw_key(draw: Column, ties: Sequence[str]) -> Column:
    return F.struct(draw.alias("draw"), *[F.col(t) for t in ties])


def _kth_keys(
    df: DataFrame, k: int, draw: Column, ties: Sequence[str], by: Sequence[str], buckets: int
) -> DataFrame:
    """(by, _cut): the k-th smallest key of each group with at least ``k`` rows."""
    narrow = df.select(*by, _draw_key(draw, ties).alias("_key")).withColumn(
        "_bucket", F.floor(F.col("_key.draw") * buckets)
    )
    totals = narrow.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    edge = (
        _starts(totals, by, "_n")
        .filter((F.col("_start") < k) & (F.col("_start") + F.col("_n") >= k))
        .withColumn("_need", F.lit(k) - F.col("_start"))
        .select(*by, "_bucket", "_need")
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_key"))
    return (
        narrow.join(cut_lineage(edge, "edges"), [*by, "_bucket"])
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(*by, F.col("_key").alias("_cut"))
    )


def among_smallest(
    df: DataFrame, k: int, draw: Column, ties: Sequence[str], buckets: int = UNIFORM_BUCKETS
) -> Column:
    """A condition on ``df`` that holds for the ``k`` rows with the smallest ``draw``.

    The k-th key is one row; it comes to the driver and becomes a literal.
    """
    if k <= 0:
        return F.lit(False)
    last = _kth_keys(df, k, draw, ties, (), buckets).select("_cut").first()
    if last is None:
        return F.lit(True)
    limit = F.struct(
        F.lit(last[0]["draw"]).alias("draw"),
        *[F.lit(last[0][t]).cast(df.schema[t].dataType).alias(t) for t in ties],
    )
    return _draw_key(draw, ties) <= limit


def smallest_k(
    df: DataFrame,
    k: int,
    draw: Column,
    ties: Sequence[str],
    by: Sequence[str] = (),
    buckets: int = UNIFORM_BUCKETS,
) -> DataFrame:
    """Per ``by`` group, the ``k`` rows with the smallest uniform ``draw``.

    A histogram of draws finds the bucket in which the k-th row lies, a sort
    of that bucket alone finds the k-th row, and one filter then keeps all
    rows up to it.  Wide rows are never shuffled, and a group that holds most
    of the table costs no more than any other.  ``df`` is scanned three times,
    twice for its key columns only; write it out first if it is costly.
    """
    if not by:
        return df.filter(among_smallest(df, k, draw, ties, buckets))
    if k <= 0:
        return df.limit(0)
    # A group with fewer than k rows has no cut and is kept whole.
    # Written out, a small table of cuts is broadcast by the planner, and wide rows stay where they are.
    kept = df.join(cut_lineage(_kth_keys(df, k, draw, ties, by, buckets), "cuts"), list(by), "left")
    return kept.filter(F.col("_cut").isNull() | (_draw_key(draw, ties) <= F.col("_cut"))).drop("_cut")

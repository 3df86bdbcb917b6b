"""Exact deduplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.functions.text import text_key
from proseforge.session import cut_lineage


def first_wins(
    df: DataFrame, key: Column, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Keep, per ``by`` and ``key``, the row that comes first in ``order``.

    ``min_by`` combines on the map side: each task ships one row per key, so a
    text that makes up a third of the corpus never gathers in one place, as it
    would under ``row_number``.
    """
    others = [c for c in df.columns if c not in by]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*by, key.alias("_key")).agg(first).select(*by, "_row.*")


#: Bits of the integer types, by which several order columns become one number.
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def order_number(df: DataFrame, order: Sequence[str]) -> Column:
    """One value that sorts as ``order`` does, nulls first.

    Integer columns of up to 96 bits together become one decimal number, which a hash aggregate can take the minimum of;
    anything else becomes a struct.
    """
    bits = [_BITS.get(type(df.schema[c].dataType)) for c in order]
    if None in bits or sum(bits) > 96:
        return F.struct(*order)
    wide = lambda c: c.cast("decimal(38,0)")
    literal = lambda x: wide(F.lit(str(x)))  # noqa: E731  more than a long holds
    number = literal(0)
    for c, n in zip(order, bits):
        number = wide(number * literal(2 ** (n + 1)) + F.coalesce(wide(F.col(c)), literal(-(2 ** (n - 1)) - 1)))
    return number


def dedup_text(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First-wins deduplication on exact text, within each split.

    Rows are written once.  Which of them win is decided on digests and order numbers alone, and the winners are
    then picked from the rows.  Where rows of one text share their place in ``order``, one of them stays.
    """
    names = [*by, *[c for c in df.columns if c not in by]]
    rows = cut_lineage(df.withColumns({"_key": F.unhex(text_key(F.col(column))), "_place": order_number(df, order)}), "dedup-rows")
    places = cut_lineage(rows.groupBy(*by, "_key", "_place").agg(F.count(F.lit(1)).alias("_n")), "dedup-places")
    winners = places.groupBy(*by, "_key").agg(F.min("_place").alias("_place"))
    kept = _only(rows, winners, [*by, "_key", "_place"])
    tied = _only(places.filter("_n > 1"), winners, [*by, "_key", "_place"]).drop("_n")
    if tied.isEmpty():
        return kept.select(*names)
    tied = cut_lineage(tied, "dedup-ties")
    single = _only(kept, tied, [*by, "_key", "_place"], "left_anti")
    one = first_wins(_only(kept, tied, [*by, "_key", "_place"]).drop("_key"), text_key(F.col(column)), ["_place"], by)
    return single.select(*names).unionByName(one.select(*names))


def _only(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows whose keys stand in ``table``, or do not; nulls are equal."""
    other = table.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    return rows.join(other, condition, how)


def not_seen(df: DataFrame, seen: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows whose text is new: not in ``seen`` and the first among ``df``.

    Deduplicating first leaves one row per text, so the anti join has no hot key.
    """
    fresh = dedup_text(df, column, order).withColumn("_key", text_key(F.col(column)))
    known = seen.select(text_key(F.col(column)).alias("_key")).distinct()
    return fresh.join(known, "_key", "left_anti").drop("_key")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()

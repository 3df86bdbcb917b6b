"""Fixed-length id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100  # label of a position without loss


def fit(ids: Column, length: int, fill: int) -> Column:
    """Cut or pad to ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def mask(n: Column, length: int, marks: tuple = (1, 0)) -> Column:
    """``n`` ones (at most ``length``) followed by zeros; ``marks`` may be text."""
    n = F.least(n, F.lit(length))
    # A slice of a constant, which is cheaper than two arrays of a row's own.
    whole = F.concat(*[F.array_repeat(F.lit(m), F.lit(length)) for m in marks])
    return F.slice(whole, F.lit(length + 1) - n, F.lit(length))


def cut(ids: Column, start: Column, length: Column | int) -> Column:
    """``length`` elements from zero-based ``start``; negative lengths give none."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(ids, start + 1, F.greatest(length, F.lit(0)))


def last(ids: Column | str, n: Column | int) -> Column:
    """The last ``n`` elements, or all when there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.least(n, F.size(ids))
    return F.slice(ids, F.size(ids) - keep + 1, keep)


def joined(ids: Column) -> Column:
    """Elements as comma-separated text."""
    return F.array_join(ids.cast("array<string>"), ",")

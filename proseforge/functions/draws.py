"""Random draws as pure functions of (seed, row key, draw name).

A sequential generator cannot be spread over tasks.  Hashing the key gives
every row its own uniform value, equal on every run and after every retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int, name: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys], F.lit(name)))


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """A value in [0, 1) with 32 random bits."""
    return F.conv(F.substring(_digest(seed, name, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def reached(p: float) -> int:
    """How many of the 2**32 values of ``uniform`` lie below ``p``; exact, as scaling by a power of two is."""
    return min(max(math.ceil(p * 4294967296.0), 0), 1 << 32)


def below(seed: int, name: str, p: float, *keys: Column) -> Column:
    """``uniform(seed, name, *keys) < p``, decided on the digits of the hash without making them a number."""
    n = reached(p)
    return F.lit(True) if n == 1 << 32 else _digest(seed, name, *keys) < F.lit(f"{n:08x}")


def randint(u: Column, low: Column | int, high: Column | int) -> Column:
    """An integer from ``low`` to ``high``, both included."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.floor(u * (high - low + 1))).cast("int")


def normal(u1: Column, u2: Column) -> Column:
    """A standard normal value from two uniforms (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def geometric_gap(u: Column, mean: float) -> Column:
    """Number of successes before a stop of probability 1 / (1 + mean)."""
    stop = 1.0 / (1.0 + mean)
    return F.floor(F.log(1.0 - u) / math.log(1.0 - stop)).cast("int")

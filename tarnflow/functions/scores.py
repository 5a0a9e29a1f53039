"""Column expressions of scores and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000


def sigmoid(x: Column, mid: float, tau: float, top: float) -> Column:
    """top / (1 + exp(-(x - mid) / tau))."""
    return F.lit(top) / (1 + F.exp(-(x - mid) / F.lit(tau)))


def two_slopes(x: Column, mid: float, low: float, middle: float, top: float, largest: Column) -> Column:
    """Straight from low at 0 to middle at mid, then straight to top at the largest x; never above top."""
    first = low + (middle - low) / mid * x
    second = middle + F.coalesce(F.try_divide(F.lit(top - middle), largest - mid), F.lit(0.0)) * (x - mid)
    return F.least(F.when(x <= mid, first).otherwise(second), F.lit(top))


def whole_days(until: Column, since: Column) -> Column:
    """Whole periods of 24 hours between two times, rounded down; null if one is."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(until) - micros(since)) / F.lit(MICROS_A_DAY)).cast("long")


def drawn(seed: int | Column, *keys: str | Column) -> Column:
    """A text to order rows by at random, the same in every run and on every engine with md5."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("-", seed, *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def inverse_or_zero(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), x), F.lit(0.0))


def interpolated(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.lit(y0) + (x - x0) * F.lit((y1 - y0) / (x1 - x0))


def discount(rank: Column) -> Column:
    """1 / log2(rank + 1) for ranks from 1."""
    return 1 / F.log2(rank.cast("double") + 1)


def ideal_gain(n: Column) -> Column:
    """The sum of the first n discounts."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + discount(i))).otherwise(F.lit(0.0))

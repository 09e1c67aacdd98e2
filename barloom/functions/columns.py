"""Column helpers: every function maps Columns to a Column, nothing runs here."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: str | Column) -> Column:
    """Cast to double and turn NaN into NULL, so NULL is the only missing value."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def zero_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def safe_div(n: str | Column, d: str | Column) -> Column:
    """``n / d``; 0 when the denominator is missing or within 1e-9 of zero."""
    den = col(d)
    return or_zero(col(n) / F.when(F.abs(den) > TINY, den))


def imbalance(a: str | Column, b: str | Column, total: str | Column | None = None) -> Column:
    a, b = col(a), col(b)
    return safe_div(a - b, a + b if total is None else total)


def logistic(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Clamp that keeps NULL (``least``/``greatest`` alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def full_window(agg: Column, x: str | Column, w: WindowSpec, n: int) -> Column:
    """``agg`` over ``w`` only where the frame holds ``n`` non-null values of ``x``."""
    return F.when(F.count(col(x)).over(w) == n, agg.over(w))


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def hash_draw(salt: int, *parts: tuple[str | Column, int]) -> Column:
    """Reproducible uniform draw in [0, 1) from integer columns (linear congruence)."""
    acc = F.lit(salt).cast("bigint")
    for c, mult in parts:
        acc = acc + col(c).cast("bigint") * F.lit(mult).cast("bigint")
    return (acc % F.lit(2147483648)) / F.lit(2147483648.0)

"""Ordered computation over series of any length without one-task series.

``Window.partitionBy(ticker).orderBy(ts)`` puts a whole series into one task.
If one ticker holds a third of a very large table, that task never ends.  The
three tools below give the same results with bounded groups:

``index_rows``    row number inside each series, from per-bucket counts;
``HaloBlocks``    bounded frames (n back, n ahead): rows are cut into blocks by
                  row number and each block carries copies of its neighbours;
``running``       unbounded prefixes (sum, max, last): local prefix inside a
                  time bucket plus the carry of all earlier buckets.

Each needs a bucket that bounds its rows.  A bar table has at most one row per
series and bar interval, so a calendar bucket is such a bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import col

IDX = "_idx"
BLK = "_blk"
CORE = "_core"
INNER = "_inner"
BKT = "_bkt"
DEFAULT_BLOCK = 4096
SCAN = 64  # rows per inner block of a linear recurrence


def month_bucket(ts: str | Column) -> Column:
    t = col(ts)
    return F.year(t) * 12 + F.month(t)


def index_rows(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str] | str,
    bucket: Column | None = None,
    name: str = IDX,
    from_end: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row inside its series, or from its end.

    ``order`` must be unique inside a series and ``bucket`` monotone in it.  The
    positions of a bucket start at the row count of all earlier buckets, so the
    only sort is by (series, bucket); the counts table has one row per bucket.
    """
    order = [order] if isinstance(order, str) else list(order)
    bucket = month_bucket(order[0]) if bucket is None else bucket
    keys = list(key)
    rows = df.withColumn(BKT, bucket)
    counts = rows.groupBy(*keys, BKT).agg(F.count("*").alias("_n"))
    outer = F.col(BKT).desc() if from_end else F.col(BKT)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(outer).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BKT).alias("_k_bkt"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    cond = F.col(BKT) == F.col("_k_bkt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    inner = [F.col(c).desc() for c in order] if from_end else order
    here = Window.partitionBy(*keys, BKT).orderBy(*inner)
    return (
        rows.join(starts, cond)
        .withColumn(name, F.col("_start") + F.row_number().over(here) - 1)
        .drop(BKT, "_k_bkt", "_start", *[f"_k_{k}" for k in keys])
    )


@dataclass(frozen=True)
class HaloBlocks:
    """Rows cut into blocks of ``size`` by position, with copied neighbours.

    ``open`` sends a row to its own block and, near an edge, to the next or
    previous one; ``close`` keeps each row once.  Any chain of bounded windows
    over ``window`` that looks at most ``back`` rows back and ``ahead`` rows
    ahead in total gives the same values as on the whole series.  The order of
    ``window`` starts with the inner block, so one sort of the narrow input
    serves it and ``inner``, however many of them are chained.
    """

    key: tuple[str, ...]
    back: int
    ahead: int = 0
    size: int = DEFAULT_BLOCK
    idx: str = IDX
    _size: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_size", max(self.size, self.back, self.ahead, 1))

    def open(self, df: DataFrame) -> DataFrame:
        n = self._size
        own = F.floor(F.col(self.idx) / n)
        pos = F.col(self.idx) - own * n
        targets = [own]
        if self.back:
            targets.append(F.when(pos >= n - self.back, own + 1))
        if self.ahead:
            targets.append(F.when((pos < self.ahead) & (own > 0), own - 1))
        return df.withColumn(
            BLK, F.explode(F.array_compact(F.array(*targets)))
        ).withColumns(
            {CORE: F.col(BLK) == F.floor(F.col(self.idx) / n), INNER: F.floor(F.col(self.idx) / SCAN)}
        )

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key, BLK).orderBy(INNER, self.idx)

    @property
    def inner(self) -> WindowSpec:
        """The rows of an inner block up to the current one."""
        return Window.partitionBy(*self.key, BLK, INNER).orderBy(self.idx).rowsBetween(
            Window.unboundedPreceding, 0
        )

    def last(self, n: int) -> WindowSpec:
        """The current row and the ``n - 1`` rows before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    def close(self, df: DataFrame, keep_index: bool = False) -> DataFrame:
        out = df.filter(F.col(CORE)).drop(BLK, CORE, INNER)
        return out if keep_index else out.drop(self.idx)


def over_blocks(
    df: DataFrame,
    build: Callable[[DataFrame, HaloBlocks], DataFrame],
    *,
    back: int,
    ahead: int = 0,
    key: Sequence[str] = ("ticker",),
    ts: str = "ts",
    size: int = DEFAULT_BLOCK,
    keep_index: bool = False,
) -> DataFrame:
    """Index ``df`` (unless it is), run ``build`` on halo blocks, keep core rows."""
    indexed = df if IDX in df.columns else index_rows(df, key, ts)
    keep = keep_index or IDX in df.columns
    blocks = HaloBlocks(tuple(key), back, ahead, size)
    return blocks.close(build(blocks.open(indexed), blocks), keep)


# --------------------------------------------------------------------------
# first-order linear recurrence  y[i] = decay * y[i-1] + u[i]
# --------------------------------------------------------------------------

def memory(decay: float) -> int:
    """Rows after which a term has faded below double precision."""
    return math.ceil(math.log(1e-17) / math.log(decay)) + SCAN


def span_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def smooth(
    df: DataFrame, b: HaloBlocks, inputs: dict[str, tuple[str, float, int]]
) -> DataFrame:
    """Exponential averages ``y = decay*y + (1-decay)*x`` seeded by the first x.

    ``inputs`` maps an output name to (input column, decay, position of the
    first input).  The local part is a prefix sum over ``SCAN`` rows; whole
    earlier inner blocks enter through their totals, weighted by their age.
    Nulls before the seed position give null.  Needs ``memory(decay)`` rows of
    halo.
    """
    i = F.col(b.idx)
    df = df.withColumn("_r", i - F.col(INNER) * SCAN)
    local = {}
    for out, (x, decay, first) in inputs.items():
        u = F.when(i == first, F.col(x)).when(i > first, F.col(x) * (1.0 - decay))
        scaled = F.coalesce(u, F.lit(0.0)) * F.pow(F.lit(decay), -F.col("_r"))
        local[f"_z_{out}"] = F.pow(F.lit(decay), F.col("_r")) * F.sum(scaled).over(b.inner)
    df = df.withColumns(local)
    # the first row of an inner block looks back at the last rows of the earlier ones, at fixed distances
    carries = {}
    for out, (_, decay, _) in inputs.items():
        carry = F.lit(0.0)
        for m in range(math.ceil(memory(decay) / SCAN)):
            total = F.lag(f"_z_{out}", 1 + SCAN * m).over(b.window)
            carry = carry + F.coalesce(total, F.lit(0.0)) * decay ** (SCAN * m)
        carries[f"_c_{out}"] = F.when(F.col("_r") == 0, carry)
    df = df.withColumns(carries)
    done = {}
    for out, (_, decay, first) in inputs.items():
        before = F.coalesce(F.first(f"_c_{out}").over(b.inner), F.lit(0.0))
        done[out] = F.when(i >= first, F.col(f"_z_{out}") + F.pow(F.lit(decay), F.col("_r") + 1) * before)
    return df.withColumns(done).drop("_r", *local, *carries)


# --------------------------------------------------------------------------
# unbounded prefixes
# --------------------------------------------------------------------------

_PREFIX = {
    "sum": lambda c: F.sum(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
}


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str] | str,
    outputs: dict[str, tuple[str, str]],
    bucket: Column | None = None,
) -> DataFrame:
    """Running aggregates from the series start, ``{output: (how, column)}``.

    Inside a bucket by a window; earlier buckets by one row of totals each.
    """
    order = [order] if isinstance(order, str) else list(order)
    bucket = month_bucket(order[0]) if bucket is None else bucket
    keys = list(key)
    rows = df.withColumn(BKT, bucket)
    totals = rows.groupBy(*keys, BKT).agg(
        *[_PREFIX[how](c).alias(f"_t_{o}") for o, (how, c) in outputs.items()]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BKT).rowsBetween(
        Window.unboundedPreceding, -1
    )
    merge = {"sum": F.sum, "count": F.sum, "max": F.max}
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BKT).alias("_k_bkt"),
        *[
            merge[how](f"_t_{o}").over(before).alias(f"_c_{o}")
            for o, (how, _) in outputs.items()
        ],
    )
    cond = F.col(BKT) == F.col("_k_bkt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    here = Window.partitionBy(*keys, BKT).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = rows.join(carry, cond).withColumns(
        {f"_l_{o}": _PREFIX[how](c).over(here) for o, (how, c) in outputs.items()}
    )
    result = {}
    for o, (how, _) in outputs.items():
        parts = F.col(f"_c_{o}"), F.col(f"_l_{o}")
        if how == "max":
            result[o] = F.greatest(*parts)
        else:
            zero = F.lit(0)
            result[o] = F.when(
                parts[0].isNotNull() | parts[1].isNotNull(),
                F.coalesce(parts[0], zero) + F.coalesce(parts[1], zero),
            )
    temps = [f"_c_{o}" for o in outputs] + [f"_l_{o}" for o in outputs]
    return joined.withColumns(result).drop(
        BKT, "_k_bkt", *temps, *[f"_k_{k}" for k in keys]
    )

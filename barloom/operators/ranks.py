"""Exact ranks and quantiles of groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one
buffer, and a rank window sorts a group in one task.  Here the values of a group
are spread over sub-ranges found by a mergeable sketch, and positions are local
counts plus the totals of lower sub-ranges.  Ranks count equal values together
first (combined before the shuffle); quantiles count and sort only the
sub-ranges that hold a wanted position.  The borders go to the rows, so no task
holds a group, and a row finds its sub-range by halving.  The sketch only decides
the balance of the work; the results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

ROWS = 100_000  #: distinct values meant for one sub-range
SPLITS = 1024  #: sub-ranges of a group at most
CUTS_SENT = 1 << 20  #: borders of sub-ranges that are broadcast; more are joined by a shuffle


def _placed(rows: DataFrame, value: str, splits: int) -> DataFrame:
    """Add ``_sub``, the number of borders in ``_cuts`` below the value, by halving.

    A step is a projection of its own: its result is read twice by the next one.
    """
    rows = rows.withColumn("_sub", F.lit(0))
    for i in range((splits - 1).bit_length() - 1, -1, -1):
        passed = F.get("_cuts", F.col("_sub") + (2**i - 1)) < F.col(value)
        rows = rows.withColumn("_sub", F.col("_sub") + F.when(passed, 2**i).otherwise(0))
    return rows.drop("_cuts")


def _sizes(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and the number of groups."""
    most, groups = rows.groupBy(*keys).count().agg(F.max("count"), F.count("*")).first()
    return most or 0, groups


def _few(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= CUTS_SENT else df


def _spread(
    rows: DataFrame, keys: list[str], value: str, splits: int | None, weight: Column
) -> tuple[DataFrame, DataFrame, int]:
    """Stored rows with their sub-range, the stored sub-range totals and a bound of their number."""
    if splits is not None and splits < 2:
        raise ValueError(f"a group needs two sub-ranges or more, not {splits}")
    most, groups = _sizes(rows, keys)
    if splits is None:
        # all groups get the sub-ranges that the largest one needs
        splits = min(max(2, -(-most // ROWS)), SPLITS)
    probs = [i / splits for i in range(1, splits)]
    cuts = rows.groupBy(*keys).agg(
        F.percentile_approx(value, probs, max(1000, 4 * splits)).alias("_cuts")
    )
    placed = _placed(rows.join(_few(cuts, groups * splits), keys), value, splits)
    totals = placed.groupBy(*keys, "_sub").agg(F.sum(weight).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_sub")
    ranges = totals.withColumn(
        "_lower",
        F.coalesce(
            F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    return placed, materialize(ranges), groups * splits


def _positions(
    placed: DataFrame, ranges: DataFrame, keys: list[str], value: str, n_ranges: int
) -> DataFrame:
    here = Window.partitionBy(*keys, "_sub").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return placed.join(_few(ranges, n_ranges), [*keys, "_sub"]).withColumn(
        "below", F.col("_lower") + F.coalesce(F.sum("cnt").over(here), F.lit(0))
    )


def value_positions(
    df: DataFrame, group: Sequence[str], value: str, splits: int | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Per (group, distinct value): ``cnt`` rows and ``below`` rows of lower value.

    ``extra`` adds aggregates per distinct value.  Null values are left out.
    """
    keys = list(group)
    counts = materialize(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("cnt"), *[c.alias(n) for n, c in (extra or {}).items()])
    )
    placed, ranges, n = _spread(counts, keys, value, splits, F.col("cnt"))
    return _positions(placed, ranges, keys, value, n).drop("_sub", "_lower", "_n")


def average_ranks(
    df: DataFrame, group: Sequence[str], value: str, name: str = "rank", splits: int | None = None
) -> DataFrame:
    """Add the 1-based rank of ``value`` in its group, ties sharing their mean."""
    keys = list(group)
    pos = value_positions(df, keys, value, splits).select(
        *[F.col(k).alias(f"_g_{k}") for k in keys],
        F.col(value).alias("_g_value"),
        (F.col("below") + (F.col("cnt") + 1) / 2.0).alias(name),
    )
    cond = F.col(value) == F.col("_g_value")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_g_{k}"))
    return df.join(pos, cond, "left").drop("_g_value", *[f"_g_{k}" for k in keys])


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Sequence[float] | Column,
    splits: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: rows (group, q, n, quantile).

    ``probs`` is a list, or an array Column over ``n`` (the group's row count).
    An empty ``group`` means the whole table.
    """
    keys = list(group) or ["_all"]
    src = df if group else df.withColumn("_all", F.lit(0))
    rows = materialize(src.filter(F.col(value).isNotNull()).select(*keys, value))
    placed, ranges, n_ranges = _spread(rows, keys, value, splits, F.lit(1))
    wanted = probs if isinstance(probs, Column) else F.array(*[F.lit(float(p)) for p in probs])
    targets = (
        ranges.groupBy(*keys)
        .agg(F.sum("_n").alias("n"))
        .withColumn("q", F.explode(F.array_distinct(wanted)))
        .withColumn("_at", F.col("q") * (F.col("n") - 1))
        .withColumn("_lo", F.floor("_at"))
        .withColumn("_hi", F.least(F.ceil("_at"), F.col("n") - 1))
    )

    def within(edge: str, start: str, length: str) -> Column:
        return (F.col(start) <= F.col(edge)) & (F.col(edge) < F.col(start) + F.col(length))

    # which sub-range holds each wanted position, then which value inside it
    located = targets.join(ranges, keys).filter(
        within("_lo", "_lower", "_n") | within("_hi", "_lower", "_n")
    ).drop("_lower", "_n")
    lo, hi = within("_lo", "below", "cnt"), within("_hi", "below", "cnt")
    # only the sub-ranges that hold a wanted position are counted and sorted
    located = materialize(located)
    held = located.select(*keys, "_sub").distinct()
    counts = (
        placed.join(_few(held, n_ranges), [*keys, "_sub"], "left_semi")
        .groupBy(*keys, "_sub", value)
        .agg(F.count("*").alias("cnt"))
    )
    matched = (
        _positions(counts, ranges, keys, value, n_ranges)
        .join(_few(located, n_ranges), [*keys, "_sub"])
        .filter(lo | hi)
    )
    return (
        matched.groupBy(*keys, "q", "n", "_at", "_lo")
        .agg(
            F.max(F.when(lo, F.col(value))).alias("_vlo"),
            F.max(F.when(hi, F.col(value))).alias("_vhi"),
        )
        .select(
            *group,
            "q",
            "n",
            (
                F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_at") - F.col("_lo"))
            ).alias("quantile"),
        )
    )

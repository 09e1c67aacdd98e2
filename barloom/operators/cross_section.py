"""Features of one series against all others at the same time.

Means and deviations are aggregates with map-side combine joined back by time;
ranks come from counted values (``ranks``), so a time with very many series is
not sorted in one task.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import TINY, or_zero, zero_to_null

logger = logging.getLogger(__name__)


def panel_wide(df: DataFrame, feature: str, *, ticker: str = "ticker", ts: str = "ts") -> DataFrame:
    """One row per time, the values of all tickers in one map: as many columns however many tickers there are.

    A ticker of several rows at a time has the greatest value, nulls and null tickers are not in the map.
    """
    cells = df.filter(F.col(ticker).isNotNull() & F.col(feature).isNotNull()).groupBy(ts, ticker).agg(F.max(feature).alias("_v"))
    return cells.groupBy(ts).agg(F.map_from_entries(F.collect_list(F.struct(ticker, "_v"))).alias(feature))


def panel_cells(wide: DataFrame, feature: str, *, ticker: str = "ticker", ts: str = "ts") -> DataFrame:
    """The rows (time, ticker, value) of a wide panel."""
    return wide.select(ts, F.explode(feature).alias(ticker, feature))


def _moments(rows: DataFrame, df: DataFrame, cols: Sequence[str], ts: str) -> DataFrame:
    stats = df.groupBy(F.col(ts).alias("_ts")).agg(
        *[
            agg.alias(f"_{n}_{c}")
            for c in cols
            for n, agg in (
                ("mean", F.avg(c)),
                ("std", F.stddev_pop(c)),
                ("n", F.count(c)),
            )
        ]
    )
    return rows.join(stats, F.col(ts) == F.col("_ts"))


def _unmoment(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop("_ts", *[f"_{n}_{c}" for c in cols for n in ("mean", "std", "n")])


def _rank(c: str) -> Column:
    n = F.col(f"_n_{c}")
    return F.coalesce(
        F.when(n >= 2, (F.col(f"_r_{c}") - 1) / (n - 1)), F.lit(0.5)
    )


def _zscore(c: str) -> Column:
    std = F.col(f"_std_{c}")
    return or_zero(F.when(std >= TINY, (F.col(c) - F.col(f"_mean_{c}")) / std))


def _relative(c: str, mode: str) -> Column:
    if mode == "ratio":
        return or_zero(F.col(c) / zero_to_null(f"_mean_{c}") - 1.0)
    if mode == "diff":
        return or_zero(F.col(c) - F.col(f"_mean_{c}"))
    raise ValueError(f"relative values are a 'ratio' or a 'diff', not {mode!r}")


def xs_features(
    df: DataFrame,
    features: Sequence[str],
    *,
    rank: bool = True,
    zscore: bool = True,
    relative_mode: str | None = "ratio",
    ts: str = "ts",
) -> DataFrame:
    """``_xrank``, ``_xzscore`` and ``_xrel`` of each feature present in ``df``."""
    cols = [c for c in features if c in df.columns]
    for c in features:
        if c not in cols:
            logger.warning("cross-section: feature %s not found", c)
    if relative_mode not in (None, "ratio", "diff"):
        raise ValueError(f"relative values are a 'ratio' or a 'diff', not {relative_mode!r}")
    out = df
    if rank:
        # a time holds one row per ticker; equal partitioning lets all features share one shuffle
        def shared(c: str) -> Column:
            order = Window.partitionBy(ts).orderBy(F.col(c).asc_nulls_last())
            ties = F.count(F.lit(1)).over(Window.partitionBy(ts, c))
            return F.when(F.col(c).isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)

        out = df.withColumns({f"_r_{c}": shared(c) for c in cols})
    out = _moments(out, df, cols, ts)
    made = {}
    for c in cols:
        if rank:
            made[f"{c}_xrank"] = _rank(c)
        if zscore:
            made[f"{c}_xzscore"] = _zscore(c)
        if relative_mode is not None:
            made[f"{c}_xrel"] = _relative(c, relative_mode)
    return _unmoment(out.withColumns(made), cols).drop(*[f"_r_{c}" for c in cols])


def xs_rank(df: DataFrame, feature: str, ts: str = "ts") -> DataFrame:
    return xs_features(df, [feature], zscore=False, relative_mode=None, ts=ts)


def xs_zscore(df: DataFrame, feature: str, ts: str = "ts") -> DataFrame:
    return xs_features(df, [feature], rank=False, relative_mode=None, ts=ts)


def xs_relative(df: DataFrame, feature: str, mode: str = "ratio", ts: str = "ts") -> DataFrame:
    if mode not in ("ratio", "diff"):
        raise ValueError(f"relative values are a 'ratio' or a 'diff', not {mode!r}")
    return xs_features(df, [feature], rank=False, zscore=False, relative_mode=mode, ts=ts)

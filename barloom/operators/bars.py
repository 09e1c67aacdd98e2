"""Bars, session grid and the joins that put slower series on the bar grid."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from barloom.functions.columns import num, or_zero
from barloom.operators.asof import asof, forward_fill
from barloom.operators.blocks import IDX, HaloBlocks, over_blocks

# Session of the exchange (UTC) and trading days of a year.
SESSION_START = "07:00:00"
SESSION_END = "15:45:00"
SESSION_MINUTES = 525
TRADING_DAYS = 252
DAY_MINUTES = 1440

OHLC = ("open", "high", "low", "close")


def session_filter(
    df: DataFrame, ts: str = "ts", start: str = SESSION_START, end: str = SESSION_END
) -> DataFrame:
    """Weekday rows whose clock time lies in the session, both ends included."""
    clock = F.date_format(ts, "HH:mm:ss.SSSSSS")
    return df.filter(
        (F.weekday(ts) < 5)
        & (clock >= f"{start}.000000")
        & (clock <= f"{end}.000000")
    )


def bar_start(ts: str, minutes: int) -> Column:
    if minutes >= DAY_MINUTES:
        return F.date_trunc("day", F.col(ts))
    return F.window(F.col(ts), f"{minutes} minutes")["start"]


def ticks_as_bars(df: DataFrame, price: str = "price", qty: str = "qty") -> DataFrame:
    """A trade is a bar with one price."""
    return df.withColumns(
        {**{c: F.col(price) for c in OHLC}, "volume": F.col(qty).cast("double")}
    )


def order_key(ts: str | Column, tie: str | Column) -> Column:
    """Time and an integer tie as one sortable number."""
    t = F.col(ts) if isinstance(ts, str) else ts
    k = F.col(tie) if isinstance(tie, str) else tie
    return (
        F.unix_micros(t.cast("timestamp")).cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)")
        + k.cast("decimal(20,0)")
    ).cast("decimal(38,0)")


def _row_order(df: DataFrame, ts: str, tie: Sequence[str]) -> Column:
    if not tie:
        return F.col(ts)
    if len(tie) == 1 and isinstance(df.schema[tie[0]].dataType, IntegralType):
        return order_key(ts, tie[0])
    return F.struct(ts, *tie)


def resample_ohlcv(
    df: DataFrame,
    minutes: int,
    *,
    key: Sequence[str] = ("ticker",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    start: Column | None = None,
    order: Column | None = None,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Left-closed, left-labelled bars; ``tie`` orders rows of equal time.

    A primitive ``order`` column (instead of ``ts`` and ``tie``) keeps the
    aggregation hash-based; one integer ``tie`` is turned into such a column.  First and last skip nulls.  One aggregation with map-side combine: no sort,
    so a bar fed by a third of all ticks is reduced where the ticks are read.
    """
    if minutes <= 1 and start is None:
        return df
    if start is None and minutes < DAY_MINUTES and DAY_MINUTES % minutes:
        raise ValueError("a bar must divide a day, or be a day or longer")
    when = order if order is not None else _row_order(df, ts, tie)
    bar = bar_start(ts, minutes) if start is None else start
    aggs = {
        "open": F.min_by("open", F.when(F.col("open").isNotNull(), when)),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": F.max_by("close", F.when(F.col("close").isNotNull(), when)),
    }
    if "volume" in df.columns:
        aggs["volume"] = F.coalesce(F.sum("volume"), F.lit(0.0))
    aggs.update(extra or {})
    return (
        df.groupBy(*key, bar.alias("_bar"))
        .agg(*[c.alias(n) for n, c in aggs.items()])
        .withColumnRenamed("_bar", ts)
        .dropna(subset=list(OHLC))
    )


def resample_daily(df: DataFrame, **kw) -> DataFrame:
    return resample_ohlcv(df, DAY_MINUTES, **kw)


def bars_per_year(bar_minutes: int, session_minutes: int = SESSION_MINUTES) -> int:
    """Bars of a trading year; the bar opening at the last minute counts once."""
    return TRADING_DAYS * math.floor((session_minutes + 1) / bar_minutes)


def observed_bars_per_year(
    bars: DataFrame, key: Sequence[str] = ("ticker",), ts: str = "ts"
) -> DataFrame:
    """The same from data: bars per observed day times trading days."""
    day = F.to_date(ts)
    return (
        bars.groupBy(*key, day.alias("_day"))
        .agg(F.count("*").alias("_n"))
        .groupBy(*key)
        .agg(F.sum("_n").alias("n_bars"), F.count("*").alias("n_days"))
        .withColumn("bars_per_year", F.lit(float(TRADING_DAYS)) * F.col("n_bars") / F.col("n_days"))
    )


# Trade-flow columns that carry a bar.
TRADE_FLOW_BAR = {
    "pr_open": "open",
    "pr_high": "high",
    "pr_low": "low",
    "pr_close": "close",
    "vol": "volume",
    "val": "value",
    "pr_vwap": "vwap",
}
SECTOR_PREFIX = "sec_pr_"


def bars_from_tradestats(
    df: DataFrame, key: Sequence[str] = ("ticker",), ts: str = "ts"
) -> DataFrame:
    """Bar columns out of a trade-flow table; sector prices are kept if present."""
    named = [num(s).alias(d) for s, d in TRADE_FLOW_BAR.items() if s in df.columns]
    sector = [num(c).alias(c) for c in df.columns if c.startswith(SECTOR_PREFIX)]
    return df.select(*key, ts, *named, *sector)


# --------------------------------------------------------------------------
# slower series
# --------------------------------------------------------------------------

def macro_join_ffill(series: Mapping[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Outer-join dated series ``{column: frame(ts, value)}`` and forward-fill each.

    The frames are stacked and folded by date: one shuffle for any number.
    """
    stacked = None
    for name, frame in series.items():
        part = frame.select(ts, F.lit(name).alias("_name"), F.col("value").cast("double").alias("_v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no series given")
    wide = stacked.groupBy(ts).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in series]
    )
    return forward_fill(wide, list(series), ts=ts)


def index_panel(
    df: DataFrame, codes: Sequence[str], prefix: str = "index", *,
    code: str = "code", ts: str = "ts", value: str = "close",
) -> DataFrame:
    """One row per time, one ``<prefix>_<code>_close`` column per code."""
    return df.groupBy(ts).agg(
        *[
            F.max(F.when(F.col(code) == c, F.col(value))).alias(f"{prefix}_{c.lower()}_close")
            for c in codes
        ]
    )


def index_logret_on_grid(
    bars: DataFrame, panel: DataFrame, *, key: Sequence[str] = ("ticker",), ts: str = "ts", **blocks
) -> DataFrame:
    """Index closes on the bar grid first, then log-returns on that grid, null -> 0."""
    cols = [c for c in panel.columns if c.endswith("_close")]
    grid = bars.select(*key, ts, *[c for c in (IDX,) if c in bars.columns])
    times = grid.select(ts).distinct()
    on_time = asof(times, panel, key=(), ts=ts, values=cols)
    aligned = grid.join(on_time, ts)

    def build(df: DataFrame, b: HaloBlocks) -> DataFrame:
        return df.withColumns(
            {
                c.replace("_close", "_logret"): or_zero(
                    F.log(F.col(c) / F.nullif(F.lag(c).over(b.window), F.lit(0.0)))
                )
                for c in cols
            }
        )

    return over_blocks(aligned, build, back=1, key=key, ts=ts, **blocks).drop(*cols)


def price_slice(
    bars: DataFrame, start, end, bar_minutes: int, max_horizon: int,
    key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Prices of the test period plus room for the longest horizon."""
    stop = F.lit(end).cast("timestamp") + F.make_dt_interval(
        mins=F.lit(bar_minutes * max_horizon)
    )
    return bars.select(*key, ts, *OHLC).filter(
        F.col(ts).between(F.lit(start).cast("timestamp"), stop)
    )


def last_n_bars(
    bars: DataFrame, n: int = 60, key: Sequence[str] = ("ticker",), ts: str = "ts"
) -> DataFrame:
    """Newest ``n`` bars per series; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*key).orderBy(F.col(ts).desc())
    return bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_close(bars: DataFrame, key: Sequence[str] = ("ticker",), ts: str = "ts") -> DataFrame:
    return bars.groupBy(*key).agg(
        F.max(ts).alias("last_ts"), F.max_by("close", ts).alias("last_close")
    )


def drop_null_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(features))


def fill_policy(
    df: DataFrame, *, carried: Sequence[str], zeroed: Sequence[str],
    key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Event distances keep their last value; everything else missing becomes 0."""
    out = forward_fill(df, carried, key=key, ts=ts) if carried else df
    return out.na.fill(0.0, subset=[*carried, *zeroed])


def fill_with_means(df: DataFrame, means: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing live columns take the training mean (``means``: one row)."""
    joined = df.crossJoin(
        F.broadcast(means.select(*[F.col(c).alias(f"_m_{c}") for c in cols]))
    )
    return joined.withColumns(
        {
            c: F.coalesce(F.col(c), F.col(f"_m_{c}")) if c in df.columns else F.col(f"_m_{c}")
            for c in cols
        }
    ).drop(*[f"_m_{c}" for c in cols])

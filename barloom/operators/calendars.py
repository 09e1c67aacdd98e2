"""Calendar and event features.

Distances are computed once per distinct day (per series where events belong to
one) and joined back by equality, so the bars are never searched by range.
``compat=True`` keeps the convention that 0 means both "today" and "no such
event"; with False a missing event is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import flag, or_zero
from barloom.operators.asof import asof

# Day reasons of the trading calendar.
HOLIDAY, TRANSFERRED = "H", "T"


def _year(day: str) -> Column:
    return F.year(day)


def _nearest(
    days: DataFrame, events: DataFrame, key: Sequence[str], direction: str, values: Sequence[str]
) -> DataFrame:
    return asof(
        days, events, key=key, ts="day", values=values, direction=direction, bucket=_year("day")
    )


def _events(df: DataFrame, date: str, key: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per event day; of several events on a day the first value counts
    for what is coming and the last for what has been (both kept)."""
    day = F.to_date(F.col(date))
    out = df.withColumn("day", day).filter(F.col("day").isNotNull())
    if not carry:
        return out.select(*key, "day").distinct().withColumn("event_day", F.col("day"))
    return out.groupBy(*key, "day").agg(
        F.max("day").alias("event_day"), *[F.max(c).alias(c) for c in carry]
    )


def _gap(late: str | Column, early: str | Column, compat: bool) -> Column:
    gap = F.datediff(late, early)
    return F.coalesce(gap, F.lit(0)) if compat else gap


def _with_days(bars: DataFrame, ts: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    dated = bars.withColumn("day", F.to_date(ts))
    return dated, dated.select(*key, "day").distinct()


def days_to_next_event(
    bars: DataFrame, events: DataFrame, date: str, *, name: str = "days_to_event",
    key: Sequence[str] = (), ts: str = "ts", compat: bool = True,
) -> DataFrame:
    """Calendar days to the next event, 0 on its day."""
    dated, days = _with_days(bars, ts, key)
    near = _nearest(days, _events(events, date, key), key, "forward", ["event_day"])
    near = near.select(*key, "day", _gap("event_day", "day", compat).alias(name))
    return dated.join(near, [*key, "day"]).drop("day")


def days_since_event(
    bars: DataFrame, events: DataFrame, date: str, *, name: str = "days_since_event",
    key: Sequence[str] = (), ts: str = "ts", compat: bool = True,
) -> DataFrame:
    """Calendar days since the last event, 0 on its day."""
    dated, days = _with_days(bars, ts, key)
    near = _nearest(days, _events(events, date, key), key, "backward", ["event_day"])
    near = near.select(*key, "day", _gap("day", "event_day", compat).alias(name))
    return dated.join(near, [*key, "day"]).drop("day")


def trading_day_flags(
    bars: DataFrame, calendar: DataFrame, ts: str = "ts", compat: bool = True
) -> DataFrame:
    """Traded, holiday and transferred flags plus distances to holidays.

    ``calendar``: ``tradedate``, optional ``is_traded`` and ``reason``.  Days not
    in it count as traded.
    """
    traded = F.col("is_traded").cast("int") if "is_traded" in calendar.columns else F.lit(1)
    reason = F.col("reason") if "reason" in calendar.columns else F.lit("N")
    cal = (
        calendar.withColumn("day", F.to_date("tradedate"))
        .filter(F.col("day").isNotNull())
        .groupBy("day")
        .agg(
            F.max(traded).alias("_traded"),
            F.max(flag(reason == HOLIDAY)).alias("_h"),
            F.max(flag(reason == TRANSFERRED)).alias("_t"),
        )
    )
    dated, days = _with_days(bars, ts, ())
    holidays = cal.filter(F.col("_h") == 1).withColumn("event_day", F.col("day"))
    near = (
        _nearest(days, holidays, (), "forward", ["event_day"])
        .withColumnRenamed("event_day", "_next")
        .join(
            _nearest(days, holidays, (), "backward", ["event_day"]).withColumnRenamed(
                "event_day", "_prev"
            ),
            "day",
        )
        .join(cal, "day", "left")
        .select(
            "day",
            F.coalesce("_traded", F.lit(1)).alias("cal_is_traded"),
            F.coalesce("_h", F.lit(0)).alias("cal_is_holiday"),
            F.coalesce("_t", F.lit(0)).alias("cal_is_transferred"),
            _gap("_next", "day", compat).alias("cal_days_to_holiday"),
            _gap("day", "_prev", compat).alias("cal_days_since_holiday"),
        )
    )
    return dated.join(near, "day").drop("day")


def dividend_features(
    bars: DataFrame,
    dividends: DataFrame,
    *,
    key: Sequence[str] = (),
    ts: str = "ts",
    price: str | Column | None = None,
    compat: bool = True,
) -> DataFrame:
    """Distances to record dates, the last and next payment, optional yields.

    ``dividends``: key, ``registryclosedate``, ``value``.  With ``compat`` the
    ex-day flag is also 1 before the first and after the last event.
    """
    dated, days = _with_days(bars, ts, key)
    ev = _events(dividends, "registryclosedate", key, ["value"])
    ahead = _nearest(days, ev, key, "forward", ["event_day", "value"]).select(
        *key, "day", F.col("event_day").alias("_next"), F.col("value").alias("_vnext")
    )
    behind = _nearest(days, ev, key, "backward", ["event_day", "value"]).select(
        *key, "day", F.col("event_day").alias("_prev"), F.col("value").alias("_vprev")
    )
    to, since = _gap("_next", "day", compat), _gap("day", "_prev", compat)
    near = ahead.join(behind, [*key, "day"]).select(
        *key,
        "day",
        to.alias("div_days_to_ex"),
        since.alias("div_days_since_ex"),
        flag((to == 0) | (since == 0)).alias("div_is_ex_day"),
        or_zero("_vprev").alias("div_value_last"),
        or_zero("_vnext").alias("div_value_next"),
    )
    out = dated.join(near, [*key, "day"]).drop("day")
    if price is None:
        return out
    p = F.col(price) if isinstance(price, str) else price
    p = F.when(p > 0, p)
    return out.withColumns(
        {
            "div_yield_last": F.col("div_value_last") / p,
            "div_yield_next": F.col("div_value_next") / p,
        }
    )


def expiration_distance(
    bars: DataFrame, expirations: DataFrame, *, asset_code: str | None = None,
    ts: str = "ts", compat: bool = True,
) -> DataFrame:
    """Days to the next expiration, optionally of one asset."""
    # Date columns in order of preference.
    dates = ("expiration_date", "lasttradedate", "tradedate")
    df = expirations
    if asset_code is not None and "asset_code" in df.columns:
        df = df.filter(F.col("asset_code") == asset_code)
    date = next((c for c in dates if c in df.columns), None)
    if date is None:
        return bars.withColumn("cal_days_to_expiration", F.lit(0))
    return days_to_next_event(
        bars, df, date, name="cal_days_to_expiration", ts=ts, compat=compat
    )

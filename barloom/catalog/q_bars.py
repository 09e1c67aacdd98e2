"""Queries of bars, the session grid and alignment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query, rnd, rounded
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators.asof import asof
from barloom.plans.panels import (
    BARS, DAYS, EVENT_TICKS, INDEX_D, MACRO_D, SERIES, TICKS, bars, days, event_ticks, index_d,
    macro_d, table, ticks,
)

SESSION = """weekday(ts) BETWEEN 1 AND 5 AND strftime(ts, '%H:%M:%S.%f') BETWEEN '07:00:00.000000' AND '15:45:00.000000'"""


@query(f"WITH {EVENT_TICKS} SELECT event_id, ticker, price, qty FROM event_ticks WHERE {SESSION}")
def q_session_filter(spark, sf):
    return B.session_filter(event_ticks(spark, sf)).select("event_id", "ticker", "price", "qty")


OHLCV = ["open", "high", "low", "close", "volume"]


def _bar_sql(start: str, where: str = "true") -> str:
    return f"""WITH {EVENT_TICKS}, b AS (SELECT ticker, {start} AS ts, arg_min(price, row(ts, event_id)) AS open,
      max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(qty) AS volume
    FROM event_ticks WHERE {where} GROUP BY ticker, {start}) SELECT {rounded(OHLCV, ['ticker'])} FROM b"""


@query(_bar_sql("time_bucket(INTERVAL 5 MINUTE, ts)", SESSION))
def q_resample_ohlcv(spark, sf):
    t = B.session_filter(B.ticks_as_bars(event_ticks(spark, sf)))
    return B.resample_ohlcv(t, 5, tie=["event_id"])


@query(_bar_sql("date_trunc('day', ts)"))
def q_resample_daily(spark, sf):
    return B.resample_daily(B.ticks_as_bars(event_ticks(spark, sf)), tie=["event_id"])


@query(f"""WITH {EVENT_TICKS}, b AS (SELECT DISTINCT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS ts FROM event_ticks WHERE {SESSION})
  SELECT ticker, count(*) AS n_bars, count(DISTINCT date_trunc('day', ts)) AS n_days,
         {rnd("252.0 * count(*) / count(DISTINCT date_trunc('day', ts))")} AS bars_per_year,
         {B.bars_per_year(5)} AS nominal
  FROM b GROUP BY ticker""")
def q_bars_per_year(spark, sf):
    t = B.session_filter(B.ticks_as_bars(event_ticks(spark, sf)))
    made = B.resample_ohlcv(t, 5, tie=["event_id"])
    return B.observed_bars_per_year(made).withColumn("nominal", F.lit(B.bars_per_year(5)))


@query(f"""WITH {TICKS}, f AS (SELECT ticker, ts, arg_min(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS open,
    max(price) AS high, min(price) AS low, arg_max(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS close,
    sum(qty) AS volume, sum(value) AS value, sum(value) / sum(qty) AS vwap FROM ticks GROUP BY ticker, ts),
  sec AS (SELECT ts, sum(value) / sum(qty) AS sec_pr_close FROM ticks GROUP BY ts)
  SELECT {rounded([*OHLCV, 'value', 'vwap', 'sec_pr_close'], ['ticker'], digits=4)} FROM f JOIN sec USING (ts)""", digits=4)
def q_bars_from_tradestats(spark, sf):
    from barloom.plans.panels import trade_flow

    return B.bars_from_tradestats(trade_flow(spark, sf))


@query(f"""WITH {BARS}, {MACRO_D}
  SELECT ticker, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rnd('close')} AS close,
         {rnd('o')} AS o, {rnd('f')} AS f, {rnd('p')} AS p
  FROM bars b ASOF LEFT JOIN macro_raw m ON b.ts >= m.ts""")
def q_asof_align(spark, sf):
    b = bars(spark, sf).select("ticker", "ts", "close")
    times = b.select("ts").distinct()
    on_time = asof(times, macro_d(spark, sf), key=(), values=["o", "f", "p"])
    return b.join(on_time, "ts")


@query(f"""WITH {MACRO_D} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    {rnd('last_value(o IGNORE NULLS) OVER w')} AS o, {rnd('last_value(f IGNORE NULLS) OVER w')} AS f,
    {rnd('last_value(p IGNORE NULLS) OVER w')} AS p
  FROM macro_raw WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_macro_join_ffill(spark, sf):
    raw = macro_d(spark, sf)
    return B.macro_join_ffill(
        {c: raw.filter(F.col(c).isNotNull()).select("ts", F.col(c).alias("value")) for c in "ofp"}
    )


@query(f"""WITH {INDEX_D} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    {rnd("max(close) FILTER (code = 'AVG')", 4)} AS index_avg_close,
    {rnd("max(close) FILTER (code = 'MAX')", 4)} AS index_max_close FROM index_d GROUP BY ts""", digits=4)
def q_index_panel(spark, sf):
    return B.index_panel(index_d(spark, sf), ["AVG", "MAX"])


@query(f"""WITH {BARS}, {INDEX_D}, wide AS (SELECT ts, max(close) FILTER (code = 'AVG') AS a,
    max(close) FILTER (code = 'MAX') AS m FROM index_d GROUP BY ts),
  grid AS (SELECT ticker, b.ts, a, m FROM bars b ASOF LEFT JOIN wide w ON b.ts >= w.ts),
  out AS (SELECT ticker, ts, coalesce(ln(a / lag(a) OVER s), 0) AS index_avg_logret,
          coalesce(ln(m / lag(m) OVER s), 0) AS index_max_logret FROM grid {SERIES})
  SELECT {rounded(['index_avg_logret', 'index_max_logret'], ['ticker'])} FROM out""")
def q_index_logret_on_grid(spark, sf):
    panel = B.index_panel(index_d(spark, sf), ["AVG", "MAX"])
    return B.index_logret_on_grid(bars(spark, sf), panel)


OHLC = OHLCV[:4]


@query(f"""WITH {BARS} SELECT {rounded(OHLC, ['ticker'])} FROM bars
  WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' + INTERVAL {7 * 1440 * 12} MINUTE""")
def q_price_slice(spark, sf):
    return B.price_slice(bars(spark, sf), "1997-01-01", "1997-12-31", 7 * 1440, 12)


@query(f"""WITH {BARS} SELECT {rounded(OHLCV, ['ticker'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 60""")
def q_last_n_bars(spark, sf):
    return B.last_n_bars(bars(spark, sf), 60)


@query(f"""WITH {BARS} SELECT ticker, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  {rnd('arg_max(close, ts)')} AS last_close FROM bars GROUP BY ticker""")
def q_last_close(spark, sf):
    return B.last_close(bars(spark, sf))


@query(f"""WITH {BARS}, f AS (SELECT *, close / nullif(lag(close, 5) OVER s, 0) - 1 AS roc_5,
    close / nullif(lag(close, 20) OVER s, 0) - 1 AS roc_20 FROM bars {SERIES})
  SELECT {rounded(['roc_5', 'roc_20'], ['ticker'])} FROM f WHERE roc_5 IS NOT NULL AND roc_20 IS NOT NULL""")
def q_drop_null_rows(spark, sf):
    f = I.roc(bars(spark, sf), periods=(5, 20))
    return B.drop_null_rows(f, ["roc_5", "roc_20"]).select("ticker", "ts", "roc_5", "roc_20")


_FILL = f"""f AS (SELECT ticker, ts, close / nullif(lag(close, 20) OVER s, 0) - 1 AS roc_20,
    CASE WHEN day(ts) <= 7 THEN CAST(day(ts) AS DOUBLE) END AS dist FROM bars {SERIES})"""


@query(f"""WITH {BARS}, {_FILL}, out AS (SELECT ticker, ts, coalesce(last_value(dist IGNORE NULLS) OVER w, 0) AS dist,
    coalesce(roc_20, 0) AS roc_20 FROM f
    WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT {rounded(['dist', 'roc_20'], ['ticker'])} FROM out""")
def q_fill_policy(spark, sf):
    f = I.roc(bars(spark, sf), periods=(20,)).select(
        "ticker", "ts", "roc_20",
        F.when(F.day("ts") <= 7, F.day("ts").cast("double")).alias("dist"),
    )
    return B.fill_policy(f, carried=["dist"], zeroed=["roc_20"])


@query(f"""WITH {BARS}, {_FILL}, m AS (SELECT avg(roc_20) AS a, avg(dist) AS b FROM f WHERE ts < TIMESTAMP '1996-01-01'),
  out AS (SELECT ticker, ts, coalesce(roc_20, a) AS roc_20, coalesce(dist, b) AS dist FROM f, m)
  SELECT {rounded(['dist', 'roc_20'], ['ticker'])} FROM out""")
def q_fill_with_means(spark, sf):
    f = I.roc(bars(spark, sf), periods=(20,)).select(
        "ticker", "ts", "roc_20",
        F.when(F.day("ts") <= 7, F.day("ts").cast("double")).alias("dist"),
    )
    means = f.filter(F.col("ts") < F.lit("1996-01-01").cast("timestamp")).agg(
        F.avg("roc_20").alias("roc_20"), F.avg("dist").alias("dist")
    )
    return B.fill_with_means(f, means, ["roc_20", "dist"])

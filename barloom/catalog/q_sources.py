"""Queries of sources, sinks, ingest planning and the full panels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog import q_indicators  # noqa: F401  (registers the families)
from barloom.catalog.registry import ORACLES, query, rnd, rounded
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators.indicators import dummy
from barloom.plans import panels as S
from barloom.plans.feature_panel import feature_panel
from barloom.session import checkpoint_dir
from barloom.sources import incremental as N
from barloom.sources import landed as L

K = ["ticker"]
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
OHLCV = ["open", "high", "low", "close", "volume"]


def landing(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/landed/{uuid.uuid4().hex}/{name}"


_BARS = f"WITH {S.BARS} SELECT {rounded(OHLCV, K)} FROM bars"
_PLAIN = f"WITH {S.BARS} SELECT {rounded(OHLCV)} FROM bars"


@query(_PLAIN)
def q_scan_raw_csv(spark, sf):
    path = landing(spark, "bars_csv")
    text = S.bars(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *OHLCV)
    L.sink_raw_csv(text, path)
    return L.scan_raw_csv(spark, path)


@query(f"WITH {S.BARS} SELECT ticker, count(*) AS n, {rnd('sum(close)', 3)} AS sum_close FROM bars GROUP BY ticker", digits=3)
def q_sink_raw_csv(spark, sf):
    path = landing(spark, "bars_csv")
    L.sink_raw_csv(S.bars(spark, sf).select("ticker", "ts", *OHLCV), path)
    back = spark.read.option("header", True).schema("ticker string, ts string, open double, high double, low double, close double, volume double").csv(path)
    return back.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("close").alias("sum_close"))


@query(f"WITH {S.BARS} SELECT ticker, count(*) AS n, {rnd('sum(close)', 3)} AS sum_close FROM bars GROUP BY ticker", digits=3)
def q_sink_parquet(spark, sf):
    path = landing(spark, "bars_parquet")
    L.sink_parquet(S.bars(spark, sf), path)
    return L.scan_parquet(spark, path).groupBy("ticker").agg(
        F.count("*").alias("n"), F.sum("close").alias("sum_close")
    )


@query(_BARS)
def q_scan_parquet(spark, sf):
    path = landing(spark, "bars_parquet")
    S.bars(spark, sf).write.parquet(path)
    return L.scan_parquet(spark, path)


@query(_BARS)
def q_scan_ticker_files(spark, sf):
    """Lands the bars as CSV files per ticker, then reads the folder."""
    root = landing(spark, "moved")
    text = S.bars(spark, sf).select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *OHLCV)
    text.repartitionByRange("ticker", "ts").write.partitionBy("ticker").option("header", True).csv(root)
    return L.scan_ticker_files(spark, root, files="ticker=*/*.csv", ticker="ticker=([^/]+)/")


def envelopes(spark, sf):
    """One payload per order: its lines as a columns/data block, after a block without data."""
    line = F.to_json(F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_shipdate").cast("string")))
    rows = S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.collect_list(line)).alias("d"))
    return rows.select(
        "l_orderkey",
        F.concat(
            F.lit('{"metadata":{"version":["1"]},"lines":{"columns":["LINE","Part","shipdate"],"data":['),
            F.col("d"), F.lit("]}}"),
        ).alias("value"),
    )


@query("""SELECT l_orderkey, CAST(l_linenumber AS INT) AS line, l_partkey AS part FROM lineitem""")
def q_json_envelope_flatten(spark, sf):
    path = landing(spark, "envelopes")
    envelopes(spark, sf).write.parquet(path)
    out = L.flatten_envelope(spark.read.parquet(path), ["line", "part"], keep=["l_orderkey"])
    return out.select("l_orderkey", F.col("line").cast("int").alias("line"), F.col("part").cast("bigint").alias("part"))


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, {rnd("CAST(printf('%.2f', o_totalprice) AS DOUBLE) / 10")} AS value FROM orders""")
def q_fx_rate_parse(spark, sf):
    path = landing(spark, "fx_xml")
    rec = F.format_string(
        '<ValCurs><Record Date="%s" Id="X"><Nominal>10</Nominal><Value>%s</Value></Record></ValCurs>',
        F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.", ","),
    )
    S.table(spark, sf, "orders").select(rec.alias("value")).write.parquet(path)
    return L.parse_fx_rates(spark.read.parquet(path))


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, {rnd("CAST(printf('%.2f', o_totalprice) AS DOUBLE)")} AS key_rate
  FROM orders WHERE o_orderstatus <> 'P'""")
def q_key_rate_parse(spark, sf):
    path = landing(spark, "kr_xml")
    rate = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("<w:Rate>"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</w:Rate>"))).otherwise("")
    rec = F.concat(
        F.lit('<w:KR xmlns:w="http://example.org/w"><w:DT>'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("</w:DT>"), rate, F.lit("</w:KR>"),
    )
    S.table(spark, sf, "orders").select(rec.alias("value")).write.parquet(path)
    return L.parse_key_rates(spark.read.parquet(path))


@query(f"""WITH {S.CONC} SELECT ticker, metric, tradedate || ' 18:40:00' AS ts, {rnd('value')} AS value FROM conc""")
def q_session_timestamp(spark, sf):
    return L.session_timestamp(S.conc(spark, sf)).select("ticker", "metric", "ts", "value")


@query(f"""WITH {S.BARS}, o AS (SELECT ticker, ts - INTERVAL 3 HOUR AS ts, open, high, low, close, volume FROM bars) SELECT {rounded(OHLCV, K)} FROM o""")
def q_canonical_columns(spark, sf):
    # names and a zone as a download brings them
    named = S.bars(spark, sf).toDF("ticker", "ts", "Open", "High", "Low", "Close", "Volume")
    return L.canonical_columns(named.withColumn("Adj Close", F.col("Close")), zone="+03:00")


def feed(spark, sf):
    """Event rows delivered twice: the second delivery repeats all and changes a fifth."""
    e = S.event_rows(spark, sf).select("event_id", "ticker", "ts", "price")
    again = e.withColumn("price", F.when(F.col("event_id") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return e.withColumn("SYSTIME", F.lit("2024-02-01 00:00:00")), again.withColumn("SYSTIME", F.lit("2024-02-02 00:00:00"))


_FEED = f"""{S.EVENT_ROWS}, feed AS (SELECT event_id, ticker, price, '2024-02-01 00:00:00' AS s FROM event_rows UNION ALL
  SELECT event_id, ticker, CASE WHEN event_id % 5 = 0 THEN price + 1 ELSE price END, '2024-02-02 00:00:00' FROM event_rows)"""
_DEDUP = f"""WITH {_FEED} SELECT event_id, ticker, {rnd('price')} AS price, max(s) AS "SYSTIME" FROM feed GROUP BY event_id, ticker, feed.price"""


@query(_DEDUP)
def q_dedupe_rows(spark, sf):
    a, b = feed(spark, sf)
    return N.dedupe_rows(a.unionByName(b)).drop("ts")


@query(_DEDUP)
def q_incremental_merge(spark, sf):
    a, b = (x.withColumn("month", F.date_format("ts", "yyyy-MM")) for x in feed(spark, sf))
    path = landing(spark, "events")
    N.save_partitions(a, path, ["month"])
    N.merge_into(path, b, ["month"])
    return spark.read.schema(b.schema).parquet(path).drop("ts", "month")


_SPANS = f"{S.BARS}, spans AS (SELECT ticker, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM bars GROUP BY ticker)"
_CHUNKS = f"""{_SPANS}, chunks AS (SELECT ticker, CAST(s AS DATE) AS chunk_start, CAST(least(s + INTERVAL 3 MONTH, b) AS DATE) AS chunk_end
  FROM (SELECT ticker, b, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 3 MONTH)) AS s FROM spans))"""
_CH = "ticker, strftime(chunk_start, '%Y-%m-%d') AS chunk_start, strftime(chunk_end, '%Y-%m-%d') AS chunk_end"


def chunks(spark, sf):
    spans = S.bars(spark, sf).groupBy("ticker").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return N.month_chunks(spans, "a", "b", 3)


@query(f"WITH {_CHUNKS} SELECT {_CH} FROM chunks")
def q_month_chunks(spark, sf):
    return chunks(spark, sf)


@query(f"""WITH {_CHUNKS}, have AS (SELECT ticker, max(ts) AS newest FROM bars WHERE ts < TIMESTAMP '1998-01-01' AND ticker <> 'S1' GROUP BY ticker)
  SELECT {_CH} FROM chunks LEFT JOIN have USING (ticker) WHERE newest IS NULL OR newest < chunk_end - INTERVAL 1 DAY""")
def q_coverage_gaps(spark, sf):
    loaded = S.bars(spark, sf).filter((F.col("ts") < F.lit("1998-01-01").cast("timestamp")) & (F.col("ticker") != "S1"))
    return N.coverage_gaps(chunks(spark, sf), loaded)


@query("SELECT 'S' || s_suppkey AS ticker, product FROM supplier, (SELECT unnest(['tradestats', 'orderstats', 'obstats']) AS product)")
def q_job_matrix(spark, sf):
    keys = S.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"))
    return N.job_matrix(keys, ["tradestats", "orderstats", "obstats"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_missing_keys(spark, sf):
    want = S.table(spark, sf, "customer").select("c_custkey")
    have = S.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return N.missing_keys(want, have, ["c_custkey"])


@query(f"""WITH {S.EVENT_ROWS}, o AS (SELECT ticker AS source, count(*) AS n_rows, count(DISTINCT date_trunc('day', ts)) AS n_days, min(ts) AS a, max(ts) AS b FROM event_rows GROUP BY 1)
  SELECT source, n_rows, n_days, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_ts,
    {rnd('(n_rows / n_days)')} AS bars_per_day, {rnd('(n_rows / n_days / 105)')} AS coverage FROM o""")
def q_source_profile(spark, sf):
    return N.source_profile(S.event_rows(spark, sf).withColumnRenamed("ticker", "source"))


# --- full panels ------------------------------------------------------------

_FAMILIES = [
    "log_return", "fracdiff", "sma_distance", "ema_distance", "momentum", "rolling_volatility",
    "volume_profile", "bar_shape", "rsi", "natr", "garman_klass", "macd", "bollinger", "stochastic",
    "williams_r", "cci", "roc", "obv_zscore", "mfi", "hurst_rs",
]
_PANEL_SQL = "SELECT * FROM " + " JOIN ".join(
    f"({ORACLES[f]}) AS f{i}" + ("" if i == 0 else " USING (ticker, ts)") for i, f in enumerate(_FAMILIES)
)


@query(_PANEL_SQL, money=())
def q_indicator_panel(spark, sf):
    out = I.indicator_panel(S.bars(spark, sf), use_temporal=False)
    return out.drop(*OHLCV).withColumn("fracdiff_close", F.rint(F.col("fracdiff_close") * 1e4) / 1e4)


_FP = ["sma_20_rel", "rsi_14", "o", "f", "p", "index_avg_logret", "index_max_logret", "lr_h1", "lr_h6", "tid_S1"]


@query(f"""WITH {S.PANEL}, {S.MACRO_D}, {S.INDEX_D}, m AS (SELECT ts, last_value(o IGNORE NULLS) OVER w AS o, last_value(f IGNORE NULLS) OVER w AS f,
    last_value(p IGNORE NULLS) OVER w AS p FROM macro_raw WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  wide AS (SELECT ts, max(close) FILTER (code = 'AVG') AS a, max(close) FILTER (code = 'MAX') AS b FROM index_d GROUP BY ts),
  g1 AS (SELECT panel.*, o, f, p FROM panel ASOF LEFT JOIN m ON panel.ts >= m.ts),
  g2 AS (SELECT g1.*, a, b FROM g1 ASOF LEFT JOIN wide ON g1.ts >= wide.ts),
  g3 AS (SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, o, f, p, coalesce(ln(a / lag(a) OVER s), 0) AS index_avg_logret,
    coalesce(ln(b / lag(b) OVER s), 0) AS index_max_logret, lr_h1::DOUBLE AS lr_h1, lr_h6::DOUBLE AS lr_h6,
    CAST(ticker = 'S1' AS INT)::DOUBLE AS tid_S1 FROM g2 {S.SERIES})
  SELECT ticker, ts, sma_20_rel, rsi_14, {', '.join(f'{rnd(c, 5)} AS {c}' for c in _FP[2:])}
  FROM g3 JOIN ({ORACLES['rsi'].replace('1000000', '100000')}) r USING (ticker, ts) JOIN ({ORACLES['sma_distance'].replace('1000000', '100000')}) q USING (ticker, ts)""", digits=5)
def q_feature_panel(spark, sf):
    macro = S.macro_d(spark, sf)
    filled = B.macro_join_ffill({c: macro.filter(F.col(c).isNotNull()).select("ts", F.col(c).alias("value")) for c in "ofp"})
    fp = feature_panel(
        S.bars(spark, sf), macro=filled, indexes=B.index_panel(S.index_d(spark, sf), ["AVG", "MAX"]),
        horizons=list(S.PRED_HORIZONS), dummies=True,
    )
    return fp.frame.withColumn("tid_S1", dummy("S1")).select("ticker", "ts", *_FP)

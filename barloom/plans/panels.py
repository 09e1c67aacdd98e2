"""Market-shaped views of the driver's tables.

``TICKS``/``BARS``... hold the same definitions as SQL text for the oracles.
A ticker is a supplier and a bar is one week, so both the number of series and
the number of bars grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import resample_ohlcv, ticks_as_bars
from barloom.session import materialize



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- trades ---------------------------------------------------------------

def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("value"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    ).withColumn("seq", trade_order())


def trade_order() -> Column:
    """Trade order as one number: day, then order and line, then part."""
    day = F.unix_date(F.to_date("ts")).cast("decimal(6,0)")
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(16,0)")
    return (
        day * F.lit("1" + "0" * 28).cast("decimal(30,0)")
        + line * F.lit("1" + "0" * 12).cast("decimal(13,0)")
        + F.col("l_partkey").cast("decimal(12,0)")
    ).cast("decimal(38,0)")


TICKS = """ticks AS (
  SELECT 'S' || l_suppkey AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS qty, l_discount AS discount, l_extendedprice AS value,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return resample_ohlcv(
        ticks_as_bars(ticks(spark, sf)), 7 * 1440, order=F.col("seq"),
        start=F.date_trunc("week", F.col("ts")),
    )


BARS = f"""{TICKS}, bars AS (
  SELECT ticker, date_trunc('week', ts) AS ts,
         arg_min(price, row(ts, l_orderkey, l_linenumber, l_partkey, price)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, row(ts, l_orderkey, l_linenumber, l_partkey, price)) AS close,
         sum(qty) AS volume
  FROM ticks GROUP BY 1, date_trunc('week', ts))"""

# window names shared by the oracles
SERIES = "WINDOW s AS (PARTITION BY ticker ORDER BY ts)"


def days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per return flag and line status: few long series."""
    t = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey",
    ).withColumn("seq", trade_order())
    return resample_ohlcv(ticks_as_bars(t), 1440, order=F.col("seq"))


DAYS = """days AS (
  SELECT ticker, ts,
         arg_min(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS close,
         sum(qty) AS volume
  FROM (SELECT l_returnflag || l_linestatus AS ticker, date_trunc('day', l_shipdate) AS ts,
               l_extendedprice / l_quantity AS price, l_quantity AS qty,
               l_orderkey, l_linenumber, l_partkey FROM lineitem)
  GROUP BY ticker, ts)"""


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows with a price: bars and their logarithms need one above zero."""
    return event_rows(spark, sf).filter(F.col("price") > 0)


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All event rows."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        (1 + F.col("user_id") % 10).cast("double").alias("qty"),
        "event_id",
    )


EVENT_TICKS = """event_ticks AS (
  SELECT event_type AS ticker, ts, value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS qty, event_id
  FROM events WHERE value > 0)"""
EVENT_ROWS = EVENT_TICKS.replace("event_ticks", "event_rows").replace(" WHERE value > 0", "")


# --- daily side tables ----------------------------------------------------

def index_d(spark: SparkSession, sf: str) -> DataFrame:
    """Two index codes per order day: average and maximum order value."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("ts")).agg(
        F.avg("o_totalprice").alias("AVG"), F.max("o_totalprice").alias("MAX")
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("code"), F.col(c).alias("close")) for c in ("AVG", "MAX")]
    )
    return o.select("ts", F.explode(pairs).alias("p")).select("ts", "p.code", "p.close")


INDEX_D = """index_d AS (
  SELECT o_orderdate AS ts, 'AVG' AS code, avg(o_totalprice) AS close FROM orders GROUP BY o_orderdate
  UNION ALL SELECT o_orderdate, 'MAX', max(o_totalprice) FROM orders GROUP BY o_orderdate)"""


def macro_d(spark: SparkSession, sf: str) -> DataFrame:
    """One column per order status on the days it has orders of low priority; gaps."""
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    return o.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts")).agg(
        *[
            F.max(F.when(F.col("o_orderstatus") == c.upper(), F.col("o_totalprice"))).alias(c)
            for c in "ofp"
        ]
    )


MACRO_D = """macro_raw AS (
  SELECT o_orderdate AS ts, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o,
         max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p
  FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_orderdate)"""


# --- order-flow snapshots per supplier and day -----------------------------

def trade_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Trade-flow snapshot: a trade is a buy when its discount is at least 5%.

    A (ticker, day) seldom has two lines, so lines travel and not their wider partial sums.
    """
    t = ticks(spark, sf)
    tie = F.col("seq")
    buy = F.col("discount") >= 0.05

    def side(c):
        return {"b": F.sum(F.when(buy, c)), "s": F.sum(F.when(~buy, c))}

    vol, val, one = side(F.col("qty")), side(F.col("value")), side(F.lit(1))
    lines = t.drop("price", "seq").repartition("ticker", "ts").withColumns(
        {"price": F.col("value") / F.col("qty"), "seq": trade_order()}
    )
    out = lines.groupBy("ticker", "ts").agg(
        F.min_by("price", tie).alias("pr_open"),
        F.max("price").alias("pr_high"),
        F.min("price").alias("pr_low"),
        F.max_by("price", tie).alias("pr_close"),
        F.sum("qty").alias("vol"),
        F.sum("value").alias("val"),
        F.count("*").alias("trades"),
        F.stddev_pop("price").alias("pr_std"),
        *[F.coalesce(vol[s], F.lit(0.0)).alias(f"vol_{s}") for s in "bs"],
        *[F.coalesce(val[s], F.lit(0.0)).alias(f"val_{s}") for s in "bs"],
        *[F.coalesce(one[s], F.lit(0)).alias(f"trades_{s}") for s in "bs"],
    )
    out = out.withColumns(
        {
            "pr_vwap": F.col("val") / F.col("vol"),
            "pr_vwap_b": F.col("val_b") / F.nullif(F.col("vol_b"), F.lit(0.0)),
            "pr_vwap_s": F.col("val_s") / F.nullif(F.col("vol_s"), F.lit(0.0)),
            "pr_change": F.col("pr_close") - F.col("pr_open"),
            "disb": (F.col("vol_b") - F.col("vol_s")) / F.col("vol"),
        }
    )
    sector = t.groupBy("ts").agg((F.sum("value") / F.sum("qty")).alias("sec_pr_close"))
    return out.join(sector, "ts")


_SIDES = {"b": "discount >= 0.05", "s": "discount < 0.05"}


def _split(c: str, name: str, flags: dict[str, str]) -> str:
    return ", ".join(f"coalesce(sum({c}) FILTER ({w}), 0) AS {name}_{s}" for s, w in flags.items())


TRADE_FLOW = f"""{TICKS}, flow0 AS (
  SELECT ticker, ts, arg_min(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS pr_open,
         arg_max(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS pr_close,
         max(price) AS pr_high, min(price) AS pr_low,
         sum(qty) AS vol, sum(value) AS val, CAST(count(*) AS DOUBLE) AS trades, stddev_pop(price) AS pr_std,
         {_split('qty', 'vol', _SIDES)}, {_split('value', 'val', _SIDES)}, {_split('1.0::DOUBLE', 'trades', _SIDES)}
  FROM ticks GROUP BY ticker, ts),
trade_flow AS (SELECT *, val / vol AS pr_vwap, val_b / nullif(vol_b, 0) AS pr_vwap_b,
    val_s / nullif(vol_s, 0) AS pr_vwap_s, pr_close - pr_open AS pr_change, (vol_b - vol_s) / vol AS disb FROM flow0)"""


def order_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Order-flow snapshot: every line places, lines of pending orders cancel;
    priorities 1 and 2 are the buy side."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("value"), "l_orderkey",
    )
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_orderstatus") == "P").alias("cancelled"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("buy"),
    )
    j = lines.join(o, "l_orderkey")
    aggs = {}
    for act, cond in (("put", F.lit(True)), ("cancel", F.col("cancelled"))):
        for sfx, side in (("", F.lit(True)), ("_b", F.col("buy")), ("_s", ~F.col("buy"))):
            for unit, c in (("vol", F.col("qty")), ("val", F.col("value")), ("orders", F.lit(1.0))):
                aggs[f"{act}_{unit}{sfx}"] = F.coalesce(
                    F.sum(F.when(cond & side, c)), F.lit(0.0)
                )
    # lines travel and not their wider partial sums: a (ticker, day) seldom has two
    j = j.select("ticker", "ts", "qty", "value", "cancelled", "buy").repartition("ticker", "ts")
    out = j.groupBy("ticker", "ts").agg(*[a.alias(n) for n, a in aggs.items()])
    return out.withColumns(
        {
            f"{act}_vwap{s}": F.col(f"{act}_val{s}") / F.nullif(F.col(f"{act}_vol{s}"), F.lit(0.0))
            for act in ("put", "cancel") for s in ("", "_b", "_s")
        }
    )


_ACTS = {"put": "true", "cancel": "o_orderstatus = 'P'"}
_OSIDES = {
    "": "true", "_b": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "_s": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
}
_OAGG = ", ".join(
    f"coalesce(sum({c}) FILTER ({w} AND {s}), 0) AS {a}_{u}{sfx}"
    for a, w in _ACTS.items() for sfx, s in _OSIDES.items()
    for u, c in (("vol", "l_quantity"), ("val", "l_extendedprice"), ("orders", "1.0::DOUBLE"))
)
_OVWAP = ", ".join(
    f"{a}_val{s} / nullif({a}_vol{s}, 0) AS {a}_vwap{s}" for a in _ACTS for s in _OSIDES
)
ORDER_FLOW = f"""oflow0 AS (SELECT 'S' || l_suppkey AS ticker, l_shipdate AS ts, {_OAGG}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
order_flow AS (SELECT *, {_OVWAP} FROM oflow0)"""


def book(spark: SparkSession, sf: str) -> DataFrame:
    """Book snapshot per supplier and week: spreads from the price range, depth
    and distinct price levels by side."""
    t = ticks(spark, sf).withColumn("ts", F.date_trunc("week", F.col("ts")))
    # lines of a (ticker, week) meet once; one row per part and side, so levels are counted without a copy of the lines per side
    t = t.drop("price", "seq").repartition("ticker", "ts").withColumn("price", F.col("value") / F.col("qty"))
    parts = t.withColumn("buy", F.col("discount") >= 0.05).groupBy("ticker", "ts", "l_partkey", "buy").agg(
        F.sum("qty").alias("vol"), F.sum("value").alias("val"),
        F.max("price").alias("top"), F.min("price").alias("low"),
    )
    side = {"b": F.col("buy"), "s": ~F.col("buy")}
    out = parts.groupBy("ticker", "ts").agg(
        ((F.max("top") + F.min("low")) / 2).alias("mid_price"),
        (F.max("top") - F.min("low")).alias("spread_1mio"),
        *[F.count(F.when(c, F.col("l_partkey"))).alias(f"levels_{s}") for s, c in side.items()],
        *[
            F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0.0)).alias(f"{n}_{s}")
            for s, c in side.items() for n in ("vol", "val")
        ],
        *[F.max(F.when(c, F.col("top"))).alias(f"vwap_{s}_1mio") for s, c in side.items()],
    )
    return out.withColumns(
        {
            "spread_bbo": F.col("spread_1mio") / 4,
            "spread_lv10": F.col("spread_1mio") / 2,
            "vwap_b": F.col("val_b") / F.nullif(F.col("vol_b"), F.lit(0.0)),
            "vwap_s": F.col("val_s") / F.nullif(F.col("vol_s"), F.lit(0.0)),
            "imbalance_vol": (F.col("vol_b") - F.col("vol_s")) / (F.col("vol_b") + F.col("vol_s")),
            "imbalance_val": (F.col("val_b") - F.col("val_s")) / (F.col("val_b") + F.col("val_s")),
            "imbalance_vol_bbo": F.signum(F.col("vol_b") - F.col("vol_s")),
            "imbalance_val_bbo": F.signum(F.col("val_b") - F.col("val_s")),
        }
    )


BOOK_ONLY = f"""book0 AS (SELECT ticker, date_trunc('week', ts) AS ts, (max(price) + min(price)) / 2 AS mid_price,
    max(price) - min(price) AS spread_1mio,
    {', '.join(f'count(DISTINCT l_partkey) FILTER ({w}) AS levels_{s}' for s, w in _SIDES.items())},
    {_split('qty', 'vol', _SIDES)}, {_split('value', 'val', _SIDES)},
    {', '.join(f'max(price) FILTER ({w}) AS vwap_{s}_1mio' for s, w in _SIDES.items())}
  FROM ticks GROUP BY ticker, date_trunc('week', ts)),
book AS (SELECT *, spread_1mio / 4 AS spread_bbo, spread_1mio / 2 AS spread_lv10,
    val_b / nullif(vol_b, 0) AS vwap_b, val_s / nullif(vol_s, 0) AS vwap_s,
    (vol_b - vol_s) / (vol_b + vol_s) AS imbalance_vol, (val_b - val_s) / (val_b + val_s) AS imbalance_val,
    CAST(sign(vol_b - vol_s) AS DOUBLE) AS imbalance_vol_bbo, CAST(sign(val_b - val_s) AS DOUBLE) AS imbalance_val_bbo
  FROM book0)"""
BOOK = f"{TICKS}, {BOOK_ONLY}"


def conc(spark: SparkSession, sf: str) -> DataFrame:
    """Daily concentration per supplier, long: squared part shares at 18:40."""
    t = ticks(spark, sf).repartition("ticker", "ts")
    buy = F.col("discount") >= 0.05
    by_part = t.groupBy("ticker", "ts", "l_partkey").agg(
        F.sum("qty").alias("v"),
        F.coalesce(F.sum(F.when(buy, F.col("qty"))), F.lit(0.0)).alias("b"),
        F.coalesce(F.sum(F.when(~buy, F.col("qty"))), F.lit(0.0)).alias("s"),
    )
    daily = by_part.groupBy("ticker", "ts").agg(
        *[
            (F.sum(F.col(c) * F.col(c)) / F.nullif(F.sum(c) * F.sum(c), F.lit(0.0))).alias(n)
            for n, c in (("hhi_volume", "v"), ("hhi_buy", "b"), ("hhi_sell", "s"))
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("hhi_volume", "hhi_buy", "hhi_sell")
        ]
    )
    return daily.select(
        "ticker",
        F.date_format("ts", "yyyy-MM-dd").alias("tradedate"),
        F.lit("18:40:00").alias("tradetime"),
        F.explode(pairs).alias("p"),
    ).select("ticker", "tradedate", "tradetime", "p.metric", "p.value").filter(F.col("value").isNotNull())


CONC = """conc0 AS (SELECT 'S' || l_suppkey AS ticker, l_shipdate AS ts, l_partkey, sum(l_quantity) AS v,
    coalesce(sum(l_quantity) FILTER (l_discount >= 0.05), 0) AS b,
    coalesce(sum(l_quantity) FILTER (l_discount < 0.05), 0) AS s FROM lineitem GROUP BY 1, 2, 3),
conc1 AS (SELECT ticker, strftime(ts, '%Y-%m-%d') AS tradedate, '18:40:00' AS tradetime,
    sum(v * v) / nullif(sum(v) * sum(v), 0) AS hhi_volume, sum(b * b) / nullif(sum(b) * sum(b), 0) AS hhi_buy,
    sum(s * s) / nullif(sum(s) * sum(s), 0) AS hhi_sell FROM conc0 GROUP BY 1, 2),
conc AS (SELECT * FROM (UNPIVOT conc1 ON hhi_volume, hhi_buy, hhi_sell INTO NAME metric VALUE value) WHERE value IS NOT NULL)"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Position snapshots: line status is the session half, segment the group."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("tradedate"),
        F.when(F.col("l_linestatus") == "O", "10:00:00").otherwise("18:40:00").alias("tradetime"),
        (F.col("l_discount") >= 0.05).alias("long"),
        F.col("l_quantity").cast("bigint").alias("qty"), "l_orderkey",
    )
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "YUR").otherwise("FIZ").alias("clgroup"),
    )
    zero = F.lit(0).cast("bigint")
    out = lines.join(o, "l_orderkey").join(c, "o_custkey").groupBy(
        "ticker", "tradedate", "tradetime", "clgroup"
    ).agg(
        F.coalesce(F.sum(F.when(F.col("long"), F.col("qty"))), zero).alias("pos_long"),
        F.coalesce(-F.sum(F.when(~F.col("long"), F.col("qty"))), zero).alias("pos_short"),
        F.count_if("long").alias("pos_long_num"),
        F.count_if(~F.col("long")).alias("pos_short_num"),
    )
    return out.withColumn("pos", F.col("pos_long") + F.col("pos_short"))


POSITIONS = """pos0 AS (SELECT 'S' || l_suppkey AS ticker, strftime(l_shipdate, '%Y-%m-%d') AS tradedate,
    CASE WHEN l_linestatus = 'O' THEN '10:00:00' ELSE '18:40:00' END AS tradetime,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'YUR' ELSE 'FIZ' END AS clgroup,
    CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_discount >= 0.05), 0) AS BIGINT) AS pos_long,
    CAST(coalesce(-sum(CAST(l_quantity AS BIGINT)) FILTER (l_discount < 0.05), 0) AS BIGINT) AS pos_short,
    count(*) FILTER (l_discount >= 0.05) AS pos_long_num, count(*) FILTER (l_discount < 0.05) AS pos_short_num
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
pos AS (SELECT *, pos_long + pos_short AS pos FROM pos0)"""


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Trading calendar over the order days: holidays, transferred days, weekends."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("tradedate")).distinct()
    md = F.date_format("tradedate", "MM-dd")
    reason = (
        F.when(md.isin("01-01", "03-08"), "H")
        .when(md.isin("04-27", "11-02"), "T")
        .when(F.weekday("tradedate") >= 5, "W")
        .otherwise("N")
    )
    return d.withColumn("reason", reason).withColumn(
        "is_traded", (~F.col("reason").isin("H", "W")).cast("int")
    )


CALENDAR = """cal0 AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
cal1 AS (SELECT day, CASE WHEN strftime(day, '%m-%d') IN ('01-01', '03-08') THEN 'H'
    WHEN strftime(day, '%m-%d') IN ('04-27', '11-02') THEN 'T' WHEN isodow(day) >= 6 THEN 'W' ELSE 'N' END AS reason FROM cal0),
cal AS (SELECT *, CAST(reason NOT IN ('H', 'W') AS INT) AS is_traded FROM cal1)"""


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    """A payment where a supplier ships a line at the top discount."""
    return table(spark, sf, "lineitem").filter(F.col("l_discount") >= 0.1).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.col("l_shipdate").cast("timestamp").alias("registryclosedate"),
        F.col("l_quantity").alias("value"),
    )


DIVIDENDS = """divs AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day, l_quantity AS value
  FROM lineitem WHERE l_discount >= 0.1)"""


def expirations(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly expirations on order days, two assets."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    code = F.when(F.date_format("d", "MM-dd").isin("03-15", "09-15"), "GOLD").when(
        F.date_format("d", "MM-dd").isin("06-15", "12-15"), "SI"
    )
    return d.select(
        code.alias("asset_code"), F.date_format("d", "yyyy-MM-dd").alias("expiration_date")
    ).filter(F.col("asset_code").isNotNull())


EXPIRATIONS = """exps AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day,
    CASE WHEN strftime(o_orderdate, '%m-%d') IN ('03-15', '09-15') THEN 'GOLD' ELSE 'SI' END AS asset_code
  FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('03-15', '06-15', '09-15', '12-15'))"""


# --- predictions and outcomes ----------------------------------------------

# equal weights: the day of the month decides which horizon has the best mean
PRED_HORIZONS = {1: 0.8, 3: 0.8, 6: 0.8, 12: 0.8}
COST = 0.0005


def model_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Features, targets and prices of every bar from one set of halo blocks."""
    from barloom.operators import indicators as I
    from barloom.operators.blocks import over_blocks
    from barloom.operators.targets import label_columns

    def build(df, b):
        df = I.logret_sums.build(df, b, windows=(5,))
        df = I.rolling_volatility.build(df, b, windows=(12,))
        return df.withColumns(label_columns(b, list(PRED_HORIZONS), COST, COST))

    return over_blocks(materialize(bars(spark, sf)), build, back=14, ahead=12)


def predictions(
    spark: SparkSession, sf: str, kind: str = "long", panel: DataFrame | None = None
) -> DataFrame:
    """Deterministic stand-in for model output: (ts, ticker, horizon, mean, std)."""
    hs = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("k"))
            for h, k in PRED_HORIZONS.items()
        ]
    )
    rows = (
        (model_panel(spark, sf) if panel is None else panel)
        .filter(F.col("lr_5").isNotNull() & F.col("vol_12").isNotNull())
        .select("ts", "ticker", "lr_5", "vol_12", "volume", F.explode(hs).alias("h"))
    )
    cycle = F.pmod(F.day("ts") * F.col("h.horizon"), F.lit(7)) - 3
    score = F.col("h.k") * F.col("lr_5") + 0.1 * cycle
    if kind == "short":
        score = -score - 0.1
    elif kind == "meta":
        score = 0.5 * score + (F.col("volume") - 40.0) / 40.0
    return rows.select(
        "ts", "ticker", "h.horizon", (1.0 / (1.0 + F.exp(-score))).alias("mean"),
        (F.col("vol_12") / 4.0).alias("std"),
    )


def actuals(
    spark: SparkSession, sf: str, what: str = "lr_h", panel: DataFrame | None = None
) -> DataFrame:
    """Realised log-returns after costs (``lr_h``) or labels (``target_h``)."""
    from barloom.operators.targets import targets_long

    source = model_panel(spark, sf) if panel is None else panel
    return targets_long(source, list(PRED_HORIZONS), what)


_W12 = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
_W5 = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def _lr(h: int) -> str:
    return (
        f"CAST(ln(greatest(lead(close, {h}) OVER s * (1.0::DOUBLE - {COST}::DOUBLE)"
        f" / greatest(lead(open) OVER s * (1.0::DOUBLE + {COST}::DOUBLE), 1e-8), 1e-8)) AS FLOAT)"
    )


PANEL = f"""{BARS}, p0 AS (SELECT *, ln(close / nullif(lag(close) OVER s, 0)) AS lr_1,
    {', '.join(f"CASE WHEN lead(open) OVER s IS NOT NULL AND lead(close, {h}) OVER s IS NOT NULL THEN {_lr(h)} END AS lr_h{h}" for h in PRED_HORIZONS)}
  FROM bars WINDOW s AS (PARTITION BY ticker ORDER BY ts)),
panel AS MATERIALIZED (SELECT *, CASE WHEN count(lr_1) {_W5} = 5 THEN sum(lr_1) {_W5} END AS lr_5,
    CASE WHEN count(lr_1) {_W12} = 12 THEN stddev_samp(lr_1) {_W12} END AS vol_12,
    {', '.join(f"CAST(CASE WHEN lr_h{h} > 0 THEN 1 WHEN lr_h{h} IS NOT NULL THEN 0 END AS FLOAT) AS target_h{h}" for h in PRED_HORIZONS)}
  FROM p0)"""
PREDS = f"""{PANEL}, ks(horizon, k) AS (VALUES {', '.join(f'({h}, {k}::DOUBLE)' for h, k in PRED_HORIZONS.items())}),
pr AS MATERIALIZED (SELECT ts, ticker, horizon, k * lr_5 + 0.1::DOUBLE * ((day(ts) * horizon) % 7 - 3) AS score, vol_12 / 4 AS std, volume FROM panel, ks
       WHERE lr_5 IS NOT NULL AND vol_12 IS NOT NULL),
preds AS (SELECT ts, ticker, horizon, 1 / (1 + exp(-score)) AS mean, std FROM pr),
short_preds AS (SELECT ts, ticker, horizon, 1 / (1 + exp(-(-score - 0.1::DOUBLE))) AS mean, std FROM pr),
meta_preds AS (SELECT ts, ticker, horizon,
    1 / (1 + exp(-(0.5::DOUBLE * score + (volume - 40.0::DOUBLE) / 40.0::DOUBLE))) AS mean, std FROM pr),
both_preds AS (SELECT ts, ticker, horizon, 1 / (1 + exp(-score)) AS mean,
    1 / (1 + exp(-(0.5::DOUBLE * score + (volume - 40.0::DOUBLE) / 40.0::DOUBLE))) AS meta, std FROM pr),
actuals AS ({' UNION ALL '.join(f"SELECT ts, ticker, {h} AS horizon, CAST(lr_h{h} AS DOUBLE) AS actual FROM panel WHERE lr_h{h} IS NOT NULL" for h in PRED_HORIZONS)}),
labels_l AS (SELECT ts, ticker, horizon, CAST(actual > 0 AS INT)::DOUBLE AS actual FROM actuals)"""

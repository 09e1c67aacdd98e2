"""Queries of the per-series indicator families on weekly supplier bars."""

from __future__ import annotations


from barloom.catalog.registry import query, rounded
from barloom.operators import indicators as I
from barloom.plans.panels import BARS, SERIES, bars

KEYS = ["ticker"]


def guarded(fn: str, x: str, n: int) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {fn}({x}) {over} END"


def oracle(doubles, body: str, digits: int = 6, source: str = BARS) -> str:
    return f"WITH RECURSIVE {source}, out AS ({body}) SELECT {rounded(doubles, KEYS, digits=digits)} FROM out"


def simple(name: str, cols, exprs: dict[str, str], pre: str = "bars", **params):
    """Register a one-step family: output expressions over ``pre``."""
    body = "SELECT ticker, ts, " + ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    fam = getattr(I, name)

    def run(spark, sf):
        return fam(bars(spark, sf), **params).select("ticker", "ts", *cols)

    query(oracle(cols, f"{body} FROM {pre} {SERIES}"), name=name)(run)


simple("log_return", ["log_return"], {"log_return": "ln(close / nullif(lag(close) OVER s, 0))"})

simple(
    "sma_distance", [f"sma_{p}_rel" for p in (5, 10, 20, 50)],
    {f"sma_{p}_rel": f"close / {guarded('avg', 'close', p)} - 1" for p in (5, 10, 20, 50)},
)

simple(
    "momentum", [c for p in (3, 6, 12) for c in (f"mom_{p}", f"logret_{p}")],
    {
        **{f"mom_{p}": f"close / nullif(lag(close, {p}) OVER s, 0) - 1" for p in (3, 6, 12)},
        **{f"logret_{p}": f"ln(close / nullif(lag(close, {p}) OVER s, 0))" for p in (3, 6, 12)},
    },
)

LR = f"(SELECT *, ln(close / nullif(lag(close) OVER s, 0)) AS lr FROM bars {SERIES})"
_w = (12, 24, 48)
_vol = [f"{c}_{w}" for w in _w for c in ("vol", "rv_up", "rv_dn", "vol_asym")]
_parts = ", ".join(
    f"{guarded('stddev_samp', x, w)} AS {c}_{w}"
    for w in _w for c, x in (("vol", "lr"), ("rv_up", "up"), ("rv_dn", "dn"))
)
_asym = ", ".join(
    f"(rv_dn_{w} - rv_up_{w}) / (rv_up_{w} + rv_dn_{w} + 1e-9) AS vol_asym_{w}" for w in _w
)


@query(oracle(_vol, f"""SELECT *, {_asym} FROM (SELECT ticker, ts, {_parts} FROM (
  SELECT *, CASE WHEN lr IS NOT NULL THEN greatest(lr, 0) END AS up,
         CASE WHEN lr IS NOT NULL THEN least(lr, 0) END AS dn FROM {LR}))"""))
def q_rolling_volatility(spark, sf):
    return I.rolling_volatility(bars(spark, sf)).select("ticker", "ts", *_vol)


_prof = ["volume_log", *[c for w in _w for c in (f"volume_rel_{w}", f"volume_zscore_{w}")]]
_prof_sql = ", ".join(
    [f"coalesce(v / {guarded('avg', 'v', w)}, 1) AS volume_rel_{w}" for w in _w]
    + [
        f"coalesce((v - {guarded('avg', 'v', w)}) / ({guarded('stddev_samp', 'v', w)} + 1e-9), 0) AS volume_zscore_{w}"
        for w in _w
    ]
)


@query(oracle(_prof, f"""SELECT ticker, ts, ln(v + 1) AS volume_log, {_prof_sql}
  FROM (SELECT *, nullif(volume, 0) AS v FROM bars)"""))
def q_volume_profile(spark, sf):
    return I.volume_profile(bars(spark, sf)).select("ticker", "ts", *_prof)


simple(
    "bar_shape", ["shadow_upper", "shadow_lower", "body_dominance", "range_rel"],
    {
        "shadow_upper": "(high - greatest(open, close)) / nullif(close, 0)",
        "shadow_lower": "(least(open, close) - low) / nullif(close, 0)",
        "body_dominance": "abs(close - open) / (high - low + 1e-9)",
        "range_rel": "(high - low) / nullif(close, 0)",
    },
)

simple(
    "garman_klass", ["volatility_gk"],
    {
        "volatility_gk": "0.5 * pow(ln(high / nullif(low, 0)), 2)"
        " - (2 * ln(2) - 1) * pow(ln(close / nullif(open, 0)), 2)"
    },
)

simple(
    "natr", ["natr_14"],
    {"natr_14": f"{guarded('avg', 'tr', 14)} / close"},
    pre=f"""(SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr
             FROM bars {SERIES})""",
)

simple(
    "bollinger", ["bb_pct_b", "bb_bandwidth"],
    {
        "bb_pct_b": "(close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0)",
        "bb_bandwidth": "((m + 2 * sd) - (m - 2 * sd)) / nullif(m, 0)",
    },
    pre=f"""(SELECT *, {guarded('avg', 'close', 20)} AS m, {guarded('stddev_samp', 'close', 20)} AS sd FROM bars)""",
)

_hl = f"""(SELECT *, {guarded('max', 'high', 14)} AS top, {guarded('min', 'low', 14)} AS bot FROM bars)"""
simple(
    "stochastic", ["stoch_k", "stoch_d"],
    {"stoch_k": "k", "stoch_d": guarded("avg", "k", 3)},
    pre=f"(SELECT *, (close - bot) / nullif(top - bot, 0) AS k FROM {_hl})",
)
simple("williams_r", ["williams_r"], {"williams_r": "-(top - close) / nullif(top - bot, 0)"}, pre=_hl)

simple(
    "roc", [f"roc_{p}" for p in (5, 10, 20)],
    {f"roc_{p}": f"close / nullif(lag(close, {p}) OVER s, 0) - 1" for p in (5, 10, 20)},
)

simple(
    "cci", ["cci_20"],
    {
        "cci_20": "(tp - m) / (0.015 * nullif(list_sum(list_transform(f, lambda x: abs(x - m))) / 20, 0))"
    },
    pre=f"""(SELECT *, {guarded('avg', 'tp', 20)} AS m,
             CASE WHEN count(tp) OVER w = 20 THEN list(tp) OVER w END AS f
             FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars)
             WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
)

simple(
    "obv_zscore", ["obv_zscore"],
    {
        "obv_zscore": f"coalesce((obv - {guarded('avg', 'obv', 50)}) / ({guarded('stddev_samp', 'obv', 50)} + 1e-9), 0)"
    },
    pre="""(SELECT *, sum(flow) OVER (PARTITION BY ticker ORDER BY ts) AS obv FROM (
             SELECT *, volume * coalesce(sign(close - lag(close) OVER (PARTITION BY ticker ORDER BY ts)), 0) AS flow
             FROM bars))""",
)

simple(
    "mfi", ["mfi_14"],
    {
        "mfi_14": f"coalesce(100 - 100 / (1 + {guarded('sum', 'fin', 14)} / nullif({guarded('sum', 'fout', 14)}, 0)), 50) / 100"
    },
    pre="""(SELECT *, CASE WHEN d > 0 THEN tp * volume ELSE 0 END AS fin,
                      CASE WHEN d < 0 THEN tp * volume ELSE 0 END AS fout
            FROM (SELECT *, tp - lag(tp) OVER (PARTITION BY ticker ORDER BY ts) AS d
                  FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars)))""",
)

simple(
    "logret_sums", ["lr_1", "lr_5", "lr_15", "lr_30"],
    {"lr_1": "lr", **{f"lr_{w}": guarded("sum", "lr", w) for w in (5, 15, 30)}},
    pre=LR,
)

_taps = I.fracdiff_weights()[::-1]
_n = len(_taps)


@query(oracle(["fracdiff_close"], f"""SELECT ticker, ts,
    CASE WHEN count(close) OVER w = {_n} THEN
      list_inner_product(list(close) OVER w, {_taps}::DOUBLE[]) END AS fracdiff_close
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)""", 4),
    digits=4)
def q_fracdiff(spark, sf):
    return I.fracdiff(bars(spark, sf)).select("ticker", "ts", "fracdiff_close")


# exponential averages: the oracle walks each series row by row
_walk = """numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i FROM bars),
ema AS (
  SELECT ticker, ts, i, close, close AS e12, close AS e26 FROM numbered WHERE i = 0
  UNION ALL
  SELECT n.ticker, n.ts, n.i, n.close, e.e12 + (n.close - e.e12) * (2.0 / 13)::DOUBLE,
         e.e26 + (n.close - e.e26) * (2.0 / 27)::DOUBLE
  FROM ema e JOIN numbered n ON n.ticker = e.ticker AND n.i = e.i + 1)"""
_ema_bars = f"{BARS}, {_walk}"


@query(oracle(["ema_12_rel", "ema_26_rel"], """SELECT ticker, ts,
    CASE WHEN i >= 11 THEN close / e12 - 1 END AS ema_12_rel,
    CASE WHEN i >= 25 THEN close / e26 - 1 END AS ema_26_rel FROM ema""", source=_ema_bars))
def q_ema_distance(spark, sf):
    return I.ema_distance(bars(spark, sf)).select("ticker", "ts", "ema_12_rel", "ema_26_rel")


_rsi_walk = """steps AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS d,
    row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i FROM bars),
wilder AS (
  SELECT ticker, ts, i, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM steps WHERE i = 1
  UNION ALL
  SELECT n.ticker, n.ts, n.i, w.up + (greatest(n.d, 0) - w.up) * (1.0 / 14)::DOUBLE,
         w.dn + (greatest(-n.d, 0) - w.dn) * (1.0 / 14)::DOUBLE
  FROM wilder w JOIN steps n ON n.ticker = w.ticker AND n.i = w.i + 1)"""


@query(oracle(["rsi_14"], """SELECT s.ticker, s.ts,
    CASE WHEN s.i >= 14 THEN coalesce(100 - 100 / (1 + up / nullif(dn, 0)), 50) / 100 ELSE 0.5 END AS rsi_14
  FROM steps s LEFT JOIN wilder w USING (ticker, i)""", source=f"{BARS}, {_rsi_walk}"))
def q_rsi(spark, sf):
    return I.rsi(bars(spark, sf)).select("ticker", "ts", "rsi_14")


_macd_walk = f"""{_walk}, m AS (SELECT ticker, ts, i, (e12 - e26) / nullif(close, 0) AS macd FROM ema WHERE i >= 25),
sig AS (
  SELECT ticker, ts, i, macd, macd AS s FROM m WHERE i = 25
  UNION ALL
  SELECT m.ticker, m.ts, m.i, m.macd, g.s + (m.macd - g.s) * 0.2::DOUBLE
  FROM sig g JOIN m ON m.ticker = g.ticker AND m.i = g.i + 1)"""
_macd = ["macd", "macd_signal", "macd_hist"]


@query(oracle(_macd, """SELECT n.ticker, n.ts, macd, CASE WHEN n.i >= 33 THEN s END AS macd_signal,
    CASE WHEN n.i >= 33 THEN macd - s END AS macd_hist
  FROM numbered n LEFT JOIN sig USING (ticker, i)""", source=f"{BARS}, {_macd_walk}"))
def q_macd(spark, sf):
    return I.macd(bars(spark, sf)).select("ticker", "ts", *_macd)


_hurst_sql = f"""frames AS (
  SELECT ticker, ts, {guarded('stddev_samp', 'lr', 60)} AS sd, {guarded('avg', 'lr', 60)} AS m,
         CASE WHEN count(lr) OVER w = 60 THEN list(lr) OVER w END AS f
  FROM {LR} WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
points AS (SELECT ticker, ts, sd, m, unnest(f) AS x, generate_subscripts(f, 1) AS j FROM frames WHERE f IS NOT NULL),
devs AS (SELECT *, sum(x - m) OVER (PARTITION BY ticker, ts ORDER BY j) AS dev FROM points),
spans AS (SELECT ticker, ts, any_value(sd) AS sd, max(dev) - min(dev) AS r FROM devs GROUP BY ticker, ts)"""


@query(oracle(["hurst_60"], f"""SELECT frames.ticker, frames.ts,
    CASE WHEN spans.sd >= 1e-10 THEN ln(r / spans.sd + 1e-10) / ln(60) END AS hurst_60
  FROM frames LEFT JOIN spans USING (ticker, ts)""", source=f"{BARS}, {_hurst_sql}"))
def q_hurst_rs(spark, sf):
    return I.hurst_rs(bars(spark, sf)).select("ticker", "ts", "hurst_60")



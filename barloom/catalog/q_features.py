"""Queries of microstructure, positioning, calendar and cross-section features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query, rnd, rounded
from barloom.operators import calendars as E
from barloom.operators import cross_section as X
from barloom.operators import indicators as I
from barloom.operators import microstructure as M
from barloom.operators import positioning as P
from barloom.plans import panels as S

K = ["ticker"]


def div(n: str, d: str) -> str:
    return f"coalesce(({n}) / CASE WHEN abs({d}) > 1e-9 THEN {d} END, 0)"


# --- microstructure -------------------------------------------------------

TRADE_X = {
    **{f"aps_{u}_imb": div(f"{u}_b - {u}_s", u) for u in ("vol", "val", "trades")},
    **{f"aps_avg_size_{s}": div(f"vol_{s}", f"trades_{s}") for s in "bs"},
    "aps_disb": "coalesce(disb, 0)",
    "aps_vwap_premium": div("pr_vwap_b - pr_vwap_s", "pr_vwap"),
    "aps_intra_vol_bp": div("pr_std", "pr_vwap") + " * 1e4",
    "aps_pr_change_bp": div("pr_change", "pr_vwap") + " * 1e4",
}
ORDER_X = {
    **{
        f"aps_{a}_{u}_imb": div(f"{a}_{u}_b - {a}_{u}_s", f"{a}_{u}")
        for a in ("put", "cancel") for u in ("vol", "val", "orders")
    },
    **{
        f"aps_{a}_vwap_premium": div(f"{a}_vwap_b - {a}_vwap_s", f"{a}_vwap")
        for a in ("put", "cancel")
    },
    "aps_put_avg_size": div("put_vol", "put_orders"),
    **{
        f"aps_cancel_ratio_{u}": div(f"cancel_{u}", f"(put_{u} + cancel_{u})")
        for u in ("orders", "vol")
    },
    **{f"aps_cancel_rate_{s}": div(f"cancel_orders_{s}", f"put_orders_{s}") for s in "bs"},
}
BOOK_X = {
    **{f"aps_spread_{d}_bp": div(f"spread_{d}", "mid_price") + " * 1e4" for d in ("bbo", "lv10", "1mio")},
    **{f"aps_imb_{u}_bbo": f"coalesce(imbalance_{u}_bbo, 0)" for u in ("vol", "val")},
    **{f"aps_imb_{u}_full": f"coalesce(imbalance_{u}, 0)" for u in ("vol", "val")},
    "aps_levels_imb": div("levels_b - levels_s", "(levels_b + levels_s)"),
    "aps_levels_total": "coalesce(CAST(levels_b + levels_s AS DOUBLE), 0)",
    **{f"aps_depth_{u}_imb": div(f"{u}_b - {u}_s", f"({u}_b + {u}_s)") for u in ("vol", "val")},
    "aps_depth_imb_1mio": div("vwap_b_1mio - vwap_s_1mio", "mid_price"),
    "aps_impact_b_1mio_bp": div("vwap_b_1mio - mid_price", "mid_price") + " * 1e4",
    "aps_impact_s_1mio_bp": div("mid_price - vwap_s_1mio", "mid_price") + " * 1e4",
    "aps_resting_vwap_premium_bp": div("vwap_b - vwap_s", "mid_price") + " * 1e4",
}


def block(exprs: dict[str, str], source: str) -> str:
    return f"SELECT ticker, ts, {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {source}"


@query(f"WITH {S.TRADE_FLOW}, out AS ({block(TRADE_X, 'trade_flow')}) SELECT {rounded(list(TRADE_X), K)} FROM out")
def q_tradestats_features(spark, sf):
    return M.tradestats_features(S.trade_flow(spark, sf))


@query(f"WITH {S.ORDER_FLOW}, out AS ({block(ORDER_X, 'order_flow')}) SELECT {rounded(list(ORDER_X), K)} FROM out")
def q_orderstats_features(spark, sf):
    return M.orderstats_features(S.order_flow(spark, sf))


@query(f"WITH {S.BOOK}, out AS ({block(BOOK_X, 'book')}) SELECT {rounded(list(BOOK_X), K)} FROM out")
def q_obstats_features(spark, sf):
    return M.obstats_features(S.book(spark, sf))


_OTT = f"""ott AS (SELECT ticker, ts, {div('coalesce(put_orders, 0)', 'coalesce(trades, 0)')} AS aps_order_to_trade
  FROM order_flow FULL JOIN trade_flow USING (ticker, ts))"""


@query(f"WITH {S.TRADE_FLOW}, {S.ORDER_FLOW}, {_OTT} SELECT {rounded(['aps_order_to_trade'], K)} FROM ott")
def q_order_to_trade(spark, sf):
    return M.order_to_trade(S.order_flow(spark, sf), S.trade_flow(spark, sf))


HHI = ["hhi_volume", "hhi_buy", "hhi_sell"]
_H_OUT = [f"aps_hi2_{h}" for h in HHI]
_CONC = f"""daily AS (SELECT ticker, date_trunc('day', CAST(tradedate || ' ' || tradetime AS TIMESTAMP)) + INTERVAL 1 DAY AS ts,
    {', '.join(f"max(value) FILTER (metric = '{h}') AS {h}" for h in HHI)} FROM conc GROUP BY 1, 2),
  hi2 AS (SELECT b.ticker, b.ts, {', '.join(f'coalesce({h}, 0) AS aps_hi2_{h}' for h in HHI)}
    FROM GRID b ASOF LEFT JOIN daily d ON b.ticker = d.ticker AND b.ts >= d.ts)"""


@query(f"WITH {S.BARS}, {S.CONC}, {_CONC.replace('GRID', 'bars')} SELECT {rounded(_H_OUT, K)} FROM hi2")
def q_concentration_asof(spark, sf):
    return M.concentration_asof(S.conc(spark, sf), S.bars(spark, sf), HHI)


_ALL = [*TRADE_X, *ORDER_X, *BOOK_X, "aps_order_to_trade"]
_PANEL = f"""t AS ({block(TRADE_X, 'trade_flow')}), o AS ({block(ORDER_X, 'order_flow')}), k AS ({block(BOOK_X, 'book')}),
  {_OTT}, panel AS (SELECT ticker, ts, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ALL)}
    FROM t FULL JOIN o USING (ticker, ts) FULL JOIN k USING (ticker, ts) FULL JOIN ott USING (ticker, ts))"""


@query(f"""WITH {S.TRADE_FLOW}, {S.ORDER_FLOW}, {S.BOOK_ONLY}, {_PANEL}, {S.CONC}, {_CONC.replace('GRID', 'panel')}
  SELECT {rounded([*_ALL, *_H_OUT], K)} FROM panel JOIN hi2 USING (ticker, ts)""")
def q_microstructure_panel(spark, sf):
    return M.microstructure_panel(
        trades=S.trade_flow(spark, sf), orders=S.order_flow(spark, sf), book=S.book(spark, sf),
        concentration=S.conc(spark, sf), metrics=HHI,
    )


# --- positioning ----------------------------------------------------------

POS = list(P.POSITIONS)
_CLOSE = f"""daily AS (SELECT ticker, CAST(tradedate AS DATE) AS day, clgroup,
    {', '.join(f'arg_max({p}, tradetime) AS {p}' for p in POS)} FROM pos GROUP BY 1, 2, 3)"""
_WIDE = f"""wide AS (SELECT ticker, day, {', '.join(f"max({p}) FILTER (clgroup = '{g}') AS {p}_{g}" for p in POS for g in P.GROUPS)}
    FROM daily GROUP BY ticker, day)"""


def _pos_cols(g: str) -> str:
    n = f"futoi_{g.lower()}"
    return f"""CAST(pos_{g} AS DOUBLE) AS {n}_pos,
      CAST(coalesce(pos_{g} - lag(pos_{g}) OVER d, 0) AS DOUBLE) AS {n}_pos_d1,
      CAST(coalesce(pos_{g} - lag(pos_{g}, 5) OVER d, 0) AS DOUBLE) AS {n}_pos_d5,
      coalesce((pos_long_{g} - abs(pos_short_{g})) / nullif(CAST(pos_long_{g} + abs(pos_short_{g}) AS DOUBLE), 0), 0) AS {n}_imbalance"""


_FEAT = f"""feat AS (SELECT ticker, day, {_pos_cols('YUR')}, {_pos_cols('FIZ')} FROM wide
  WINDOW d AS (PARTITION BY ticker ORDER BY day)),
  smart AS (SELECT *, futoi_yur_pos - futoi_fiz_pos AS futoi_smart_divergence,
            futoi_yur_imbalance - futoi_fiz_imbalance AS futoi_smart_imbalance_diff FROM feat)"""
_F_COLS = [f"futoi_{g}_{c}" for g in ("yur", "fiz") for c in ("pos", "pos_d1", "pos_d5", "imbalance")]
_S_COLS = ["futoi_smart_divergence", "futoi_smart_imbalance_diff"]
_DAY = "strftime(day, '%Y-%m-%d') AS day"


@query(f"WITH {S.POSITIONS}, {_CLOSE} SELECT ticker, {_DAY}, clgroup, {', '.join(POS)} FROM daily")
def q_positioning_daily_close(spark, sf):
    return P.positioning_daily_close(S.positions(spark, sf))


@query(f"WITH {S.POSITIONS}, {_CLOSE}, {_WIDE} SELECT ticker, {_DAY}, {', '.join(f'CAST({p}_{g} AS DOUBLE) AS {p}_{g}' for p in POS for g in P.GROUPS)} FROM wide")
def q_positioning_pivot(spark, sf):
    wide = P.positioning_pivot(P.positioning_daily_close(S.positions(spark, sf)))
    cols = [F.col(f"{p}_{g}").cast("double").alias(f"{p}_{g}") for p in POS for g in P.GROUPS]
    return wide.select("ticker", "day", *cols)


@query(f"WITH {S.POSITIONS}, {_CLOSE}, {_WIDE}, {_FEAT} SELECT ticker, {_DAY}, {', '.join(f'{rnd(c)} AS {c}' for c in _F_COLS)} FROM feat")
def q_positioning_features(spark, sf):
    return P.positioning_features(P.positioning_pivot(P.positioning_daily_close(S.positions(spark, sf))))


@query(f"WITH {S.POSITIONS}, {_CLOSE}, {_WIDE}, {_FEAT} SELECT ticker, {_DAY}, {', '.join(f'{rnd(c)} AS {c}' for c in _S_COLS)} FROM smart")
def q_smart_divergence(spark, sf):
    return P.build_positioning(S.positions(spark, sf)).select("ticker", "day", *_S_COLS)


@query(f"""WITH {S.BARS}, {S.POSITIONS}, {_CLOSE}, {_WIDE}, {_FEAT}, g AS (SELECT b.ticker, b.ts,
    {', '.join(f'coalesce({c}, 0) AS {c}' for c in _F_COLS + _S_COLS)}
    FROM bars b ASOF LEFT JOIN smart s ON b.ticker = s.ticker AND b.ts >= s.day)
  SELECT {rounded(_F_COLS + _S_COLS, K)} FROM g""")
def q_positioning_asof(spark, sf):
    return P.positioning_asof(P.build_positioning(S.positions(spark, sf)), S.bars(spark, sf))


@query("""SELECT event_type AS secid, upper(left(event_type, 3)) AS spot, count(*) AS n FROM events GROUP BY 1, 2""")
def q_futures_to_spot(spark, sf):
    e = S.table(spark, sf, "events").withColumnRenamed("event_type", "secid")
    kinds = [r.secid for r in e.select("secid").distinct().collect()]  # the five kinds of events
    return P.futures_to_spot(e, mapping={k: k[:3].upper() for k in kinds}).groupBy("secid", "spot").agg(
        F.count("*").alias("n")
    )


# --- calendar -------------------------------------------------------------

_NEXT = "(SELECT min({v}) FROM {t} e WHERE e.day >= CAST({d} AS DATE))"


@query(f"""WITH {S.BARS}, {S.CALENDAR}, d AS (SELECT DISTINCT ts FROM bars), h AS (SELECT day FROM cal WHERE reason = 'H'),
  f AS (SELECT d.ts, coalesce(is_traded, 1) AS cal_is_traded, CAST(coalesce(reason = 'H', false) AS INT) AS cal_is_holiday,
    CAST(coalesce(reason = 'T', false) AS INT) AS cal_is_transferred,
    CAST(coalesce((SELECT min(day) FROM h WHERE day >= CAST(d.ts AS DATE)) - CAST(d.ts AS DATE), 0) AS INT) AS cal_days_to_holiday,
    CAST(coalesce(CAST(d.ts AS DATE) - (SELECT max(day) FROM h WHERE day <= CAST(d.ts AS DATE)), 0) AS INT) AS cal_days_since_holiday
    FROM d LEFT JOIN cal ON cal.day = CAST(d.ts AS DATE))
  SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, cal_is_traded, cal_is_holiday, cal_is_transferred,
    cal_days_to_holiday, cal_days_since_holiday FROM bars JOIN f USING (ts)""")
def q_trading_day_flags(spark, sf):
    b = S.bars(spark, sf).select("ticker", "ts")
    return E.trading_day_flags(b, S.calendar(spark, sf))


_DIV = """ev AS (SELECT ticker, day, max(value) AS value FROM divs GROUP BY 1, 2)"""


@query(f"""WITH {S.BARS}, {S.DIVIDENDS}, {_DIV}, n AS (
    SELECT b.ticker, b.ts, CAST(coalesce(e.day - CAST(b.ts AS DATE), 0) AS INT) AS days_to_event
    FROM bars b ASOF LEFT JOIN ev e ON b.ticker = e.ticker AND CAST(b.ts AS DATE) <= e.day)
  SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, days_to_event FROM n""")
def q_days_to_next_event(spark, sf):
    b = S.bars(spark, sf).select("ticker", "ts")
    return E.days_to_next_event(b, S.dividends(spark, sf), "registryclosedate", key=["ticker"])


@query(f"""WITH {S.BARS}, {S.DIVIDENDS}, {_DIV}, n AS (
    SELECT b.ticker, b.ts, CAST(coalesce(CAST(b.ts AS DATE) - e.day, 0) AS INT) AS days_since_event
    FROM bars b ASOF LEFT JOIN ev e ON b.ticker = e.ticker AND CAST(b.ts AS DATE) >= e.day)
  SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, days_since_event FROM n""")
def q_days_since_event(spark, sf):
    b = S.bars(spark, sf).select("ticker", "ts")
    return E.days_since_event(b, S.dividends(spark, sf), "registryclosedate", key=["ticker"])


@query(f"""WITH {S.BARS}, {S.DIVIDENDS}, {_DIV}, a AS (SELECT b.ticker, b.ts, b.close, e.day AS nd, e.value AS nv
    FROM bars b ASOF LEFT JOIN ev e ON b.ticker = e.ticker AND CAST(b.ts AS DATE) <= e.day),
  p AS (SELECT a.*, e.day AS pd, e.value AS pv FROM a ASOF LEFT JOIN ev e ON a.ticker = e.ticker AND CAST(a.ts AS DATE) >= e.day),
  f AS (SELECT ticker, ts, close, CAST(coalesce(nd - CAST(ts AS DATE), 0) AS INT) AS div_days_to_ex,
    CAST(coalesce(CAST(ts AS DATE) - pd, 0) AS INT) AS div_days_since_ex, coalesce(pv, 0) AS div_value_last,
    coalesce(nv, 0) AS div_value_next FROM p)
  SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, div_days_to_ex, div_days_since_ex,
    CAST(div_days_to_ex = 0 OR div_days_since_ex = 0 AS INT) AS div_is_ex_day,
    {', '.join(f'{rnd(c)} AS {c}' for c in ('div_value_last', 'div_value_next'))},
    {rnd('(div_value_last / close)')} AS div_yield_last, {rnd('(div_value_next / close)')} AS div_yield_next FROM f""")
def q_dividend_features(spark, sf):
    b = S.bars(spark, sf).select("ticker", "ts", "close")
    return E.dividend_features(b, S.dividends(spark, sf), key=["ticker"], price="close").drop("close")


@query(f"""WITH {S.BARS}, {S.EXPIRATIONS}, x AS (SELECT DISTINCT day FROM exps WHERE asset_code = 'GOLD'),
  d AS (SELECT ts, CAST(coalesce(min(x.day) - CAST(ts AS DATE), 0) AS INT) AS n
        FROM (SELECT DISTINCT ts FROM bars) LEFT JOIN x ON x.day >= CAST(ts AS DATE) GROUP BY ts)
  SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, n AS cal_days_to_expiration FROM bars JOIN d USING (ts)""")
def q_expiration_distance(spark, sf):
    b = S.bars(spark, sf).select("ticker", "ts")
    return E.expiration_distance(b, S.expirations(spark, sf), asset_code="GOLD")


@query(f"""WITH {S.EVENT_ROWS}, f AS (SELECT event_id,
    least(1, greatest(0, (hour(ts) * 60 + minute(ts) - 420) / 525.0::DOUBLE)) AS frac, isodow(ts) - 1 AS dow, day(ts) AS dom FROM event_rows)
  SELECT event_id, {', '.join(f"{rnd(f'{g}(2 * pi() * {x})')} AS {n}" for n, g, x in (
      ('time_sin_daily', 'sin', 'frac'), ('time_cos_daily', 'cos', 'frac'), ('dow_sin', 'sin', 'dow / 7.0::DOUBLE'),
      ('dow_cos', 'cos', 'dow / 7.0::DOUBLE'), ('dom_sin', 'sin', 'dom / 31.0::DOUBLE'), ('dom_cos', 'cos', 'dom / 31.0::DOUBLE')))} FROM f""")
def q_cyclic_time(spark, sf):
    out = I.cyclic_time(S.event_rows(spark, sf))
    return out.drop("ticker", "ts", "price", "qty")


# --- cross section --------------------------------------------------------

@query(f"WITH {S.BARS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ticker, {rnd('max(close)')} AS close FROM bars GROUP BY bars.ts, ticker")
def q_panel_wide(spark, sf):
    """The cells of the wide panel."""
    return X.panel_cells(X.panel_wide(S.bars(spark, sf), "close"), "close")


@query(f"""WITH {S.BARS}
  SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ticker AS tid, 1.0::DOUBLE AS value, CAST(ticker = 'S1' AS INT)::DOUBLE AS "tid_S1" FROM bars""")
def q_ticker_dummies(spark, sf):
    """The entries of the sparse one-hot vectors, and one indicator read from them."""
    rows = I.ticker_dummies(S.bars(spark, sf).select("ticker", "ts"))
    return rows.select("ticker", "ts", I.dummy("S1"), F.explode("tid").alias("tid", "value"))


_ROC = f"""r AS (SELECT ticker, ts, volume, close / nullif(lag(close, 5) OVER s, 0) - 1 AS roc_5 FROM bars {S.SERIES})"""
_XN = "count({c}) OVER x"


def _xs(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR count({c}) OVER x < 2 THEN 0.5 ELSE
      (rank() OVER (PARTITION BY ts ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0 - 1)
      / (count({c}) OVER x - 1)::DOUBLE END AS {c}_xrank,
    CASE WHEN {c} IS NULL OR stddev_pop({c}) OVER x < 1e-9 THEN 0 ELSE
      ({c} - avg({c}) OVER x) / stddev_pop({c}) OVER x END AS {c}_xzscore,
    coalesce({c} / nullif(avg({c}) OVER x, 0) - 1, 0) AS {c}_xrel, coalesce({c} - avg({c}) OVER x, 0) AS {c}_xdiff"""


_XS_SQL = f"WITH {S.BARS}, {_ROC}, out AS (SELECT ticker, ts, {_xs('roc_5')}, {_xs('volume')} FROM r WINDOW x AS (PARTITION BY ts))"


def _roc(spark, sf):
    return I.roc(S.bars(spark, sf), periods=(5,)).select("ticker", "ts", "roc_5", "volume")


def _xs_out(df, *cols):
    return df.select("ticker", "ts", *cols)


@query(f"{_XS_SQL} SELECT {rounded(['roc_5_xrank'], K)} FROM out")
def q_xs_rank(spark, sf):
    return _xs_out(X.xs_rank(_roc(spark, sf), "roc_5"), "roc_5_xrank")


@query(f"{_XS_SQL} SELECT {rounded(['roc_5_xzscore'], K)} FROM out")
def q_xs_zscore(spark, sf):
    return _xs_out(X.xs_zscore(_roc(spark, sf), "roc_5"), "roc_5_xzscore")


@query(f"{_XS_SQL} SELECT {rounded(['volume_xrel', 'roc_5_xrel'], K)} FROM (SELECT ticker, ts, volume_xrel, roc_5_xdiff AS roc_5_xrel FROM out)")
def q_xs_relative(spark, sf):
    df = X.xs_relative(_roc(spark, sf), "volume", "ratio")
    return _xs_out(X.xs_relative(df, "roc_5", "diff"), "volume_xrel", "roc_5_xrel")


_XF = [f"{c}_{k}" for c in ("roc_5", "volume") for k in ("xrank", "xzscore")] + ["volume_xrel"]


@query(f"{_XS_SQL} SELECT {rounded(_XF, K)} FROM out")
def q_xs_features(spark, sf):
    df = X.xs_features(_roc(spark, sf), ["roc_5", "volume"])
    return _xs_out(df, *_XF)


# --- more per-series features ---------------------------------------------

def _g(fn: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


_SEC = ["sec_rel_strength", "sec_lr_1", "sec_lr_5", "sec_lr_15", "sec_lr_residual"]


@query(f"""WITH {S.BARS}, sec AS (SELECT date_trunc('week', ts) AS ts, sum(value) / sum(qty) AS sec_pr_close FROM ticks GROUP BY 1),
  j AS (SELECT * FROM bars JOIN sec USING (ts)),
  l AS (SELECT *, ln(sec_pr_close / lag(sec_pr_close) OVER s) AS slr, ln(close / lag(close) OVER s) AS olr FROM j {S.SERIES}),
  out AS (SELECT ticker, ts, coalesce(close / nullif(sec_pr_close, 0), 1) - 1 AS sec_rel_strength, coalesce(slr, 0) AS sec_lr_1,
    coalesce({_g('sum', 'slr', 5)}, 0) AS sec_lr_5, coalesce({_g('sum', 'slr', 15)}, 0) AS sec_lr_15,
    coalesce(olr - slr, 0) AS sec_lr_residual FROM l)
  SELECT {rounded(_SEC, K)} FROM out""")
def q_sector_relative(spark, sf):
    sector = S.ticks(spark, sf).groupBy(F.date_trunc("week", F.col("ts")).alias("ts")).agg(
        (F.sum("value") / F.sum("qty")).alias("sec_pr_close")
    )
    return I.sector_relative(S.bars(spark, sf).join(sector, "ts")).select("ticker", "ts", *_SEC)


@query(f"""WITH {S.BARS}, out AS (SELECT ticker, ts, {', '.join(
    f"({c} - {_g('avg', c, 60)}) / sqrt({_g('var_pop', c, 60)} + 1e-5) AS {c}_norm" for c in ('close', 'volume'))} FROM bars)
  SELECT {rounded(['close_norm', 'volume_norm'], K)} FROM out""")
def q_window_instance_norm(spark, sf):
    return I.window_instance_norm(S.bars(spark, sf), window=60).select(
        "ticker", "ts", "close_norm", "volume_norm"
    )


@query(f"WITH {S.TRADE_FLOW}, out AS (SELECT ticker, ts, {div('vol_b', 'vol_s')} AS ratio FROM trade_flow) SELECT {rounded(['ratio'], K)} FROM out")
def q_safe_div(spark, sf):
    from barloom.functions.columns import safe_div

    return S.trade_flow(spark, sf).select("ticker", "ts", safe_div("vol_b", "vol_s").alias("ratio"))

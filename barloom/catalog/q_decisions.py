"""Queries of thresholds and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.q_evaluation import HS, J, JL, TS, joined, sel
from barloom.catalog.registry import query, rnd
from barloom.operators import signals as G
from barloom.operators.isotonic import isotonic_calibrate
from barloom.operators import thresholds as T
from barloom.plans import panels as S
from barloom.session import materialize

COST = 0.001


@query(f"""WITH {S.PREDS}, o AS (SELECT horizon, count(*) FILTER (actual > 0) AS n_pos, avg(actual) FILTER (actual > 0) AS g FROM actuals GROUP BY horizon)
  SELECT horizon, n_pos, {rnd('CASE WHEN n_pos < 5 THEN 0.005::DOUBLE ELSE greatest(g, 1e-4) END')} AS gain FROM o""")
def q_expected_gain(spark, sf):
    return T.expected_gain(S.actuals(spark, sf), ["horizon"])


_BAYES = "least(0.95::DOUBLE, greatest(0.51::DOUBLE, {c}::DOUBLE / ({c}::DOUBLE + greatest(g, 1e-4))))"


@query(f"""WITH {S.PREDS}, o AS (SELECT horizon, avg(actual) FILTER (actual > 0) AS g FROM actuals GROUP BY horizon)
  SELECT horizon, {rnd(_BAYES.format(c=0.3))} AS threshold FROM o""")
def q_bayes_threshold(spark, sf):
    return T.expected_gain(S.actuals(spark, sf), ["horizon"]).select(
        "horizon", T.bayes_threshold("gain", 0.3).alias("threshold")
    )


@query(f"""WITH {J}, t AS (SELECT avg(actual) FILTER (actual > 0) AS g FROM j), u AS (SELECT g AS gain, {_BAYES.format(c=0.001)} AS threshold FROM t),
  o AS (SELECT gain, threshold, count(*) FILTER (mean >= threshold) AS n_signals, coalesce(avg(actual) FILTER (mean >= threshold), 0) AS avg_actual,
    coalesce(avg(CAST(actual > 0 AS INT)) FILTER (mean >= threshold), 0) AS win_rate FROM j, u GROUP BY ALL)
  SELECT n_signals, {sel(['gain', 'threshold', 'avg_actual', 'win_rate'])} FROM o""")
def q_calibrate_bayes(spark, sf):
    return T.calibrate_bayes(joined(spark, sf), COST)


@query(f"""WITH {JL}, x AS (SELECT *, round_even(mean * 1000, 0) / 1000 AS x FROM j),
  e AS (SELECT horizon FROM j GROUP BY horizon HAVING count(*) >= 100 AND min(actual) < max(actual)),
  d AS (SELECT horizon, x, count(*) AS n, sum(actual) AS y FROM x SEMI JOIN e USING (horizon) GROUP BY ALL),
  c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM d WINDOW w AS (PARTITION BY horizon ORDER BY x)),
  m AS (SELECT a.horizon, a.i AS ai, b.i AS bi, min((b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.horizon, a.i ORDER BY b.i DESC) AS v
    FROM c a JOIN c b ON a.horizon = b.horizon AND a.i <= b.i),
  f AS (SELECT horizon, bi AS i, max(v) AS v FROM m GROUP BY ALL),
  o AS (SELECT ts, ticker, x.horizon, coalesce(v, mean) AS mean FROM x LEFT JOIN c ON c.horizon = x.horizon AND c.x = x.x
    LEFT JOIN f ON f.horizon = c.horizon AND f.i = c.i)
  SELECT ticker, {TS}, horizon, {sel(['mean'])} FROM o""")
def q_isotonic_calibrate(spark, sf):
    """Scores at three digits replaced by their isotonic frequencies, horizon by horizon."""
    rows = materialize(joined(spark, sf, "target_h"))
    return isotonic_calibrate(rows, rows, digits=3).select("ticker", "ts", "horizon", "mean")


_QS = list(T.GAIN_QUANTILES)


@query(f"""WITH {J}, q AS (SELECT unnest({_QS}::DOUBLE[]) AS q, unnest(quantile_cont(mean, {_QS}::DOUBLE[])) AS t FROM j),
  a AS (SELECT q, greatest(t, 1e-5) AS threshold, count(*) AS n_signals, avg(actual) AS avg_actual, avg(CAST(actual > 0 AS INT)) AS win_rate
        FROM j JOIN q ON mean >= greatest(t, 1e-5) GROUP BY q, t),
  p AS (SELECT coalesce(min(q) FILTER (avg_actual >= 0.002), arg_max(q, row(avg_actual, -q))) AS q FROM a)
  SELECT n_signals, {sel(['threshold', 'avg_actual', 'win_rate'])} FROM a JOIN p USING (q)""")
def q_calibrate_quantile(spark, sf):
    return T.calibrate_quantile(joined(spark, sf), COST)


def _conf(src: str, score: str, thr: str, where: str = "true") -> str:
    return f"""WITH {src}, s AS (SELECT {score} AS s FROM j WHERE {where}),
  n AS (SELECT count(*) AS n, least(1.0::DOUBLE, (1 - 0.1::DOUBLE) * (1 + 1.0::DOUBLE / count(*))) AS level FROM s),
  r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM s),
  e AS (SELECT n, level * (n - 1) AS pos FROM n),
  v AS (SELECT any_value(n) AS n, any_value(pos) AS pos, max(s) FILTER (i = floor(pos)) AS lo, max(s) FILTER (i = least(ceil(pos), n - 1)) AS hi FROM r, e),
  q AS (SELECT n, lo + (hi - lo) * (pos - floor(pos)) AS q FROM v)
  SELECT {rnd('q')} AS quantile, {rnd(thr)} AS threshold, n AS n_calibration FROM q"""


@query(_conf(JL, "abs(mean - actual)", "greatest(q, 1 - q)"))
def q_conformal_two_sided(spark, sf):
    return T.conformal_two_sided(joined(spark, sf, "target_h"))


_DIRECTIONAL = _conf(JL, "1 - mean", "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - q))", "actual >= 0.5")


@query(_DIRECTIONAL)
def q_conformal_directional(spark, sf):
    return T.conformal_directional(joined(spark, sf, "target_h"))


BEST = """best AS (SELECT ts, ticker, horizon, mean, std FROM (SELECT *, row_number() OVER (PARTITION BY ts, ticker ORDER BY mean DESC, horizon) AS rn FROM preds) WHERE rn = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mean DESC, ticker) AS rk, max(mean) OVER (PARTITION BY ts) AS top FROM best)"""
_OUT = f"SELECT ticker, {TS}, horizon, {sel(['mean', 'std'])}, CASE WHEN b THEN 'BUY' ELSE 'HOLD' END AS action, CAST(b AS INT) AS signal"


@query(f"WITH {S.PREDS}, {BEST} SELECT ticker, {TS}, horizon, {sel(['mean', 'std'])} FROM best")
def q_best_horizon(spark, sf):
    return G.best_horizon(S.predictions(spark, sf))


@query(f"""WITH {JL}, {BEST}, s AS (SELECT 1 - mean AS s FROM j WHERE actual >= 0.5),
  e AS (SELECT count(*) AS n, least(1.0::DOUBLE, (1 - 0.1::DOUBLE) * (1 + 1.0::DOUBLE / count(*))) * (count(*) - 1) AS pos FROM s),
  r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM s),
  v AS (SELECT any_value(pos) AS pos, max(s) FILTER (i = floor(pos)) AS lo, max(s) FILTER (i = least(ceil(pos), n - 1)) AS hi FROM r, e),
  q AS (SELECT 1 - (lo + (hi - lo) * (pos - floor(pos))) AS t FROM v),
  o AS (SELECT *, rk <= 5 AND mean > t AS b FROM ranked, q) {_OUT} FROM o""")
def q_conformal_signals(spark, sf):
    both = materialize(joined(spark, sf, "target_h"))
    c = T.conformal_directional(both)
    return G.conformal_signals(S.predictions(spark, sf), c)


@query(f"""WITH {S.PREDS}, n AS (SELECT count(DISTINCT horizon) AS n FROM preds)
  SELECT n AS n_horizons, {rnd('pow(0.55::DOUBLE, 1.0::DOUBLE / n)')} AS sidak, {rnd('(1 - 0.45::DOUBLE / n)')} AS bonferroni,
    0.55::DOUBLE AS none, {rnd('0.0005::DOUBLE * 1.5::DOUBLE')} AS regression FROM n""")
def q_effective_threshold(spark, sf):
    n = S.predictions(spark, sf).agg(F.countDistinct("horizon").alias("n_horizons"))
    c = F.col("n_horizons")
    return n.select(
        c,
        G.effective_threshold(0.55, c).alias("sidak"),
        G.effective_threshold(0.55, c, correction="bonferroni").alias("bonferroni"),
        G.effective_threshold(0.55, c, correction="none").alias("none"),
        G.effective_threshold(0.0005, c, mode="regression").alias("regression"),
    )


@query(f"""WITH {S.PREDS}, {BEST}, t AS (SELECT pow(0.2::DOUBLE, 1.0::DOUBLE / count(DISTINCT horizon)) AS t FROM preds),
  o AS (SELECT *, top > t AND rk <= 5 AND mean >= t AND std <= 0.25 AS b FROM ranked, t) {_OUT} FROM o""")
def q_two_stage_signals(spark, sf):
    return G.two_stage_signals(S.predictions(spark, sf), threshold=0.2)


@query(f"""WITH {S.PREDS} SELECT horizon, count(*) AS n, {rnd('quantile_cont(mean, 0.95)')} AS threshold FROM preds GROUP BY horizon""")
def q_topk_threshold(spark, sf):
    return T.topk_threshold(S.predictions(spark, sf), 5.0)


_SW = list(T.PNL_SWEEP)


@query(f"""WITH {J}, s AS (SELECT unnest({_SW}::DOUBLE[]) AS threshold, generate_subscripts({_SW}, 1) AS i),
  h AS (SELECT DISTINCT horizon FROM j),
  a AS (SELECT h.horizon, threshold, i, count(j.mean) AS n_trades, avg(actual) - 0.001::DOUBLE AS x
        FROM h CROSS JOIN s LEFT JOIN j ON j.horizon = h.horizon AND mean > threshold GROUP BY 1, 2, 3),
  b AS (SELECT *, CASE WHEN n_trades >= 100 THEN x END AS mean_pnl FROM a),
  c AS (SELECT horizon, coalesce(arg_max(i, row(mean_pnl, -i)) FILTER (mean_pnl IS NOT NULL), 1) AS best FROM b GROUP BY horizon)
  SELECT horizon, {rnd('threshold')} AS threshold, n_trades, {rnd('mean_pnl')} AS mean_pnl, CAST(i = best AS INT) AS chosen FROM b JOIN c USING (horizon)""")
def q_max_pnl_threshold(spark, sf):
    return T.max_pnl_threshold(joined(spark, sf), group=["horizon"])


@query(f"WITH {S.PREDS}, {BEST}, o AS (SELECT *, rk <= 5 AND mean > 0.6 AS b FROM ranked) {_OUT} FROM o")
def q_threshold_signals(spark, sf):
    return G.threshold_signals(S.predictions(spark, sf), 0.6)


@query(f"""WITH {S.PREDS}, o AS (SELECT *, mean > 0.6 AND row_number() OVER (PARTITION BY ts ORDER BY mean DESC, ticker) <= 5 AS b
  FROM preds WHERE horizon = 6) {_OUT} FROM o""")
def q_horizon_signals(spark, sf):
    return G.threshold_signals(S.predictions(spark, sf), 0.6, horizon=6)


_MERGED = f"""{S.PREDS}, merged AS (SELECT p.mean AS "primary", m.mean AS meta, actual AS lr FROM preds p
  JOIN meta_preds m USING (ts, ticker, horizon) JOIN actuals USING (ts, ticker, horizon) WHERE horizon = 6)"""
_MP = list(T.META_PERCENTILES)


def merged(spark, sf, horizon=6):
    panel = materialize(S.model_panel(spark, sf))
    return T.join_primary_meta(
        S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "meta", panel),
        S.actuals(spark, sf, panel=panel), horizon,
    )


def _joint(prim: str) -> str:
    return f"""WITH {_MERGED}, pg AS ({prim}),
  mt AS ({' UNION ALL '.join(f"SELECT {p}::DOUBLE AS meta_pct, {i} AS mi, quantile_cont(meta, {1 - p / 100}) AS t_meta FROM merged" for i, p in enumerate(_MP, 1))}),
  g AS (SELECT *, (pi - 1) * 7 + mi AS step FROM pg, mt),
  a AS (SELECT step, primary_pct, meta_pct, t_primary, t_meta, count(lr) AS n_trades, avg(lr) - 0.001::DOUBLE AS mean_pnl
        FROM g LEFT JOIN merged ON "primary" > t_primary AND meta > t_meta GROUP BY ALL),
  c AS (SELECT coalesce(arg_max(step, row(mean_pnl, -step)) FILTER (mean_pnl IS NOT NULL AND n_trades >= 50),
        arg_max(step, row(mean_pnl, -step)) FILTER (mean_pnl IS NOT NULL)) AS best FROM a)
  SELECT primary_pct, meta_pct, n_trades, {sel(['t_primary', 't_meta', 'mean_pnl'])}, CAST(step = best AS INT) AS chosen FROM a, c"""


_PT = list(T.PRIMARY_THRESHOLDS)


@query(_joint(f"SELECT unnest({_PT}::DOUBLE[]) AS t_primary, generate_subscripts({_PT}, 1) AS pi, NULL::DOUBLE AS primary_pct"))
def q_joint_threshold_grid(spark, sf):
    m = merged(spark, sf)
    return T.joint_threshold_grid(m)


_PP = [5.0, 10.0, 20.0]


@query(_joint(" UNION ALL ".join(
    f'SELECT quantile_cont("primary", {1 - p / 100}) AS t_primary, {i} AS pi, {p}::DOUBLE AS primary_pct FROM merged'
    for i, p in enumerate(_PP, 1))))
def q_joint_percentile_grid(spark, sf):
    m = merged(spark, sf)
    return T.joint_threshold_grid(m, primary_percentiles=_PP)


@query(f"""WITH {S.PREDS}, o AS (SELECT * FROM both_preds)
  SELECT ticker, {TS}, horizon, {sel(['mean', 'meta', 'std'])}, CASE WHEN mean > 0.55 AND meta > 0.5 THEN 'BUY' ELSE 'HOLD' END AS action FROM o""")
def q_primary_meta_filter(spark, sf):
    panel = materialize(S.model_panel(spark, sf))
    return G.primary_meta_filter(
        S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "meta", panel), 0.55, 0.5
    )


CONS = f"""{S.PREDS}, {BEST}, cons AS MATERIALIZED (SELECT b.ts, ticker, horizon, b.mean AS p_long, b.std AS p_long_std, s.mean AS p_short, s.std AS p_short_std
  FROM best b JOIN short_preds s USING (ts, ticker, horizon)),
dec AS (SELECT *, p_long > 0.5 AS long_signal, p_short > 0.5 AS short_signal, p_long > 0.5 AND NOT p_short > 0.5 AS open_long,
  p_short > 0.5 AND NOT p_long > 0.5 AS close_long FROM cons)"""
_PC = ["p_long", "p_long_std", "p_short", "p_short_std"]
_DC = ["long_signal", "short_signal", "open_long", "close_long"]


def consensus(spark, sf):
    panel = materialize(S.model_panel(spark, sf))
    return G.consensus_frame(
        S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "short", panel)
    )


@query(f"WITH {CONS} SELECT ticker, {TS}, horizon, {sel(_PC)} FROM cons")
def q_consensus_frame(spark, sf):
    return consensus(spark, sf)


@query(f"WITH {CONS} SELECT ticker, {TS}, horizon, {sel(_PC)}, {', '.join(f'CAST({d} AS INT) AS {d}' for d in _DC)} FROM dec")
def q_consensus_decisions(spark, sf):
    return G.consensus_decisions(consensus(spark, sf), 0.5, 0.5)


@query(f"""WITH {CONS}, o AS (SELECT count(*) AS n_bars, count(*) FILTER (open_long) AS n_open_long, count(*) FILTER (close_long) AS n_close_long,
    avg(CAST(open_long AS INT)) AS frac_open_long, avg(CAST(close_long AS INT)) AS frac_close_long, max(p_long) AS p_long_max,
    max(p_short) AS p_short_max, avg(p_long) AS p_long_mean, avg(p_short) AS p_short_mean FROM dec)
  SELECT n_bars, n_open_long, n_close_long, {sel(['frac_open_long', 'frac_close_long', 'p_long_max', 'p_short_max', 'p_long_mean', 'p_short_mean'])} FROM o""")
def q_consensus_summary(spark, sf):
    return G.consensus_summary(G.consensus_decisions(consensus(spark, sf), 0.5, 0.5))


@query(f"""WITH {S.PREDS}, o AS (SELECT ts, ticker, horizon, CAST(least(0.2::DOUBLE, greatest(0.0::DOUBLE,
    greatest(0, mean - 0.5::DOUBLE) / 0.5::DOUBLE * (greatest(0, meta - 0.5::DOUBLE) / 0.5::DOUBLE) * 0.5::DOUBLE)) AS FLOAT)::DOUBLE AS size_fraction
    FROM both_preds)
  SELECT ticker, {TS}, horizon, {rnd('size_fraction')} AS size_fraction FROM o""")
def q_kelly_size(spark, sf):
    panel = materialize(S.model_panel(spark, sf))
    both = G.primary_meta_filter(
        S.predictions(spark, sf, panel=panel), S.predictions(spark, sf, "meta", panel), 0.55, None
    )
    return G.kelly_size(both).select("ts", "ticker", "horizon", "size_fraction")


_FN = ["share_both", "mean_max", "std_max", "mean_p50", "mean_p90", "mean_p99", "std_p50", "std_p90"]


@query(f"""WITH {S.PREDS}, {BEST}, o AS (SELECT count(*) AS n_best, count(*) FILTER (mean > 0.6) AS n_above, count(*) FILTER (std <= 0.2) AS n_calm,
    count(*) FILTER (mean > 0.6 AND std <= 0.2) AS n_both, avg(CAST(mean > 0.6 AND std <= 0.2 AS INT)) AS share_both, max(mean) AS mean_max, max(std) AS std_max,
    quantile_cont(mean, 0.5) AS mean_p50, quantile_cont(mean, 0.9) AS mean_p90, quantile_cont(mean, 0.99) AS mean_p99,
    quantile_cont(std, 0.5) AS std_p50, quantile_cont(std, 0.9) AS std_p90 FROM best)
  SELECT (SELECT count(*) FROM preds) AS n_predictions, (SELECT count(*) FROM ranked WHERE rk <= 5 AND mean > 0.6) AS n_buy,
    n_best, n_above, n_calm, n_both, {sel(_FN)} FROM o""")
def q_signal_funnel(spark, sf):
    p = materialize(S.predictions(spark, sf))
    return G.signal_funnel(p, G.threshold_signals(p, 0.6), threshold=0.6, std_cap=0.2)


@query(f"WITH {S.PREDS}, {BEST} SELECT ticker, count(*) AS n_buy FROM ranked WHERE rk <= 5 AND mean > 0.6 GROUP BY ticker")
def q_buys_per_ticker(spark, sf):
    return G.buys_per_ticker(G.threshold_signals(S.predictions(spark, sf), 0.6))


@query(f"""WITH {S.PREDS}, {BEST}, a AS (SELECT ts, ticker, horizon AS best_horizon, mean AS expected_return, std AS uncertainty,
    CASE WHEN std > 1e-9 THEN mean / std ELSE 0 END AS alert_strength,
    row_number() OVER (PARTITION BY ts ORDER BY mean DESC, ticker) AS rank FROM best)
  SELECT ticker, {TS}, best_horizon, CAST(rank AS INT) AS rank, {sel(['expected_return', 'uncertainty', 'alert_strength'])},
    CAST(expected_return >= 0.6 AND uncertainty <= 0.2 AND alert_strength >= 2 AS INT) AS alert FROM a""")
def q_alerts(spark, sf):
    return G.alerts(S.predictions(spark, sf), min_return=0.6, max_std=0.2)


_FB = ["close", "pred_close", "upper_close", "lower_close"]


@query(f"""WITH {S.PREDS}, {BEST}, o AS (SELECT b.ts, b.ticker, horizon, close, close * exp((mean - 0.5::DOUBLE) / 50 * horizon) AS pred_close,
    close * exp(((mean - 0.5::DOUBLE) / 50 + std / 50) * horizon) AS upper_close, close * exp(((mean - 0.5::DOUBLE) / 50 - std / 50) * horizon) AS lower_close
  FROM best b JOIN bars USING (ts, ticker)) SELECT ticker, {TS}, horizon, {sel(_FB, 5)} FROM o""", digits=5)
def q_forecast_band(spark, sf):
    p = S.predictions(spark, sf).withColumns(
        {"mean": (F.col("mean") - 0.5) / 50, "std": F.col("std") / 50}
    )
    return G.forecast_band(p, S.bars(spark, sf))

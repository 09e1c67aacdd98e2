"""Queries of prediction tables and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query, rnd
from barloom.operators import predictions as H
from barloom.plans import panels as S
from barloom.session import materialize

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
HS = list(S.PRED_HORIZONS)


def joined(spark, sf, what="lr_h"):
    panel = materialize(S.model_panel(spark, sf))
    return H.with_actuals(
        S.predictions(spark, sf, panel=panel), S.actuals(spark, sf, what, panel=panel)
    )


J = f"{S.PREDS}, j AS (SELECT * FROM preds JOIN actuals USING (ts, ticker, horizon))"
JL = f"{S.PREDS}, j AS (SELECT * FROM preds JOIN labels_l USING (ts, ticker, horizon))"


def sel(cols, digits=6):
    return ", ".join(f"{rnd(c, digits)} AS {c}" for c in cols)


# passes: ten jittered copies of every prediction
def passes(spark, sf, n=10):
    p = S.predictions(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    jitter = (F.pmod(F.col("i") * 7919 + F.col("horizon") * 104729, F.lit(1000)) / 1000.0 - 0.5) * 0.2
    logit = F.log(F.col("mean") / (1 - F.col("mean"))) + jitter
    return p.select("ts", "ticker", "horizon", "i", logit.alias("logit"))


PASSES = f"""{S.PREDS}, passes AS (SELECT ts, ticker, horizon, i, ln(mean / (1 - mean))
    + (((i * 7919 + horizon * 104729) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 0.2::DOUBLE AS logit
  FROM preds, (SELECT unnest(range(10)) AS i))"""


@query(f"""WITH {PASSES}, m AS (SELECT ts, ticker, horizon, avg(1 / (1 + exp(-logit))) AS mean,
    stddev_pop(1 / (1 + exp(-logit))) AS std FROM passes GROUP BY 1, 2, 3)
  SELECT ticker, {TS}, horizon, {sel(['mean', 'std'])} FROM m""")
def q_sample_moments(spark, sf):
    return H.sample_moments(passes(spark, sf))


@query(f"""WITH {PASSES}, m AS (SELECT ts, ticker, horizon, avg(1 / (1 + exp(-logit))) AS mean,
    stddev_samp(1 / (1 + exp(-logit))) AS std FROM passes GROUP BY 1, 2, 3)
  SELECT ticker, {TS}, horizon, {sel(['mean', 'std'])} FROM m""")
def q_deep_ensemble_moments(spark, sf):
    return H.sample_moments(passes(spark, sf), sample=True)


@query(f"""WITH {S.PREDS}, m AS (SELECT * FROM preds UNION ALL SELECT * FROM short_preds UNION ALL SELECT * FROM meta_preds),
  o AS (SELECT ts, ticker, horizon, avg(mean) AS mean, stddev_pop(mean) AS std FROM m GROUP BY 1, 2, 3)
  SELECT ticker, {TS}, horizon, {sel(['mean', 'std'])} FROM o""")
def q_ensemble_moments(spark, sf):
    panel = materialize(S.model_panel(spark, sf))
    members = [S.predictions(spark, sf, k, panel) for k in ("long", "short", "meta")]
    return H.ensemble_moments(members[0].unionByName(members[1]).unionByName(members[2]))


@query(f"WITH {S.PREDS} SELECT ticker, {TS}, horizon, {sel(['mean', 'std'])} FROM preds")
def q_predictions_long(spark, sf):
    p = S.model_panel(spark, sf).filter("lr_5 IS NOT NULL AND vol_12 IS NOT NULL")
    arrays = p.select(
        "ts", "ticker",
        F.array(*[1 / (1 + F.exp(-(k * F.col("lr_5") + 0.1 * (F.pmod(F.day("ts") * h, F.lit(7)) - 3)))) for h, k in S.PRED_HORIZONS.items()]).alias("mean"),
        F.array(*[F.col("vol_12") / 4 for _ in HS]).alias("std"),
    )
    return H.predictions_long(arrays, HS)


_PW = [f"primary_h{h}" for h in HS]


@query(f"""WITH {S.PREDS}, w AS (SELECT ts, ticker, {', '.join(f'avg(mean) FILTER (horizon = {h}) AS primary_h{h}' for h in HS)}
    FROM preds GROUP BY ts, ticker)
  SELECT ticker, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rnd('close')} AS close, {sel(_PW)}
  FROM bars LEFT JOIN w USING (ts, ticker)""")
def q_primary_wide_join(spark, sf):
    b = S.bars(spark, sf).select("ts", "ticker", "close")
    return H.primary_wide_join(b, S.predictions(spark, sf), HS)


@query(f"""WITH {JL}, r AS (SELECT horizon, CAST(actual >= 0.5 AS INT) AS y,
    rank() OVER (PARTITION BY horizon ORDER BY mean) + (count(*) OVER (PARTITION BY horizon, mean) - 1) / 2.0::DOUBLE AS rk FROM j),
  a AS (SELECT horizon, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg, sum(rk * y) AS s FROM r GROUP BY horizon)
  SELECT horizon, n_pos, n_neg, {rnd('((s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg))')} AS auc FROM a""")
def q_auc(spark, sf):
    return H.auc(joined(spark, sf, "target_h"))


_LL = ["logloss", "prior", "logloss_baseline", "lift"]


@query(f"""WITH {JL}, c AS (SELECT horizon, least(1 - 1e-7, greatest(1e-7, mean)) AS p, actual AS y FROM j),
  a AS (SELECT horizon, count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS logloss, avg(y) AS prior FROM c GROUP BY horizon),
  b AS (SELECT *, -(prior * ln(prior) + (1 - prior) * ln(1 - prior)) AS logloss_baseline FROM a),
  o AS (SELECT *, logloss_baseline - logloss AS lift FROM b)
  SELECT horizon, n, {sel(_LL)} FROM o""")
def q_log_loss(spark, sf):
    return H.log_loss(joined(spark, sf, "target_h"))


_PN = ["loss_real", "loss_null_mean", "loss_null_std", "loss_null_min", "p_value"]


@query(f"""WITH {JL}, i AS (SELECT horizon, actual AS y, ln(mean / (1 - mean)) AS odds, ln(1 - mean) AS base,
    row_number() OVER (PARTITION BY horizon ORDER BY ts, ticker) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS n FROM j),
  t AS (SELECT horizon, any_value(n) AS n, -(sum(y * odds) + sum(base)) / any_value(n) AS loss_real, sum(base) AS b FROM i GROUP BY horizon),
  hashed AS (SELECT horizon, k, y, row_number() OVER (PARTITION BY horizon, k ORDER BY md5(k || ':' || i)) - 1 AS i FROM i, (SELECT unnest(range(20)) AS k)),
  moved AS (SELECT horizon, k, i FROM hashed WHERE y = 1),
  s AS (SELECT horizon, k, sum(odds) AS s FROM moved JOIN (SELECT horizon, i, odds FROM i) USING (horizon, i) GROUP BY horizon, k),
  z AS (SELECT horizon, t.n, loss_real, -(s + b) / t.n AS loss FROM s JOIN t USING (horizon)),
  o AS (SELECT horizon, any_value(n) AS n, any_value(loss_real) AS loss_real, avg(loss) AS loss_null_mean, stddev_pop(loss) AS loss_null_std,
        min(loss) AS loss_null_min, (1 + count(*) FILTER (loss <= loss_real)) / 21.0::DOUBLE AS p_value FROM z GROUP BY horizon)
  SELECT horizon, n, {sel(_PN)} FROM o""")
def q_permutation_null(spark, sf):
    return H.permutation_null(joined(spark, sf, "target_h"), 20)


_PQ = ["mean_p", "max_p", "mean_std", "max_std", "share_above_50", "share_above_60", "p50", "p75", "p90", "p99"]


@query(f"""WITH {S.PREDS}, o AS (SELECT horizon, count(*) AS n, avg(mean) AS mean_p, max(mean) AS max_p, avg(std) AS mean_std, max(std) AS max_std,
    count(*) FILTER (mean > 0.5) AS n_above_50, count(*) FILTER (mean > 0.6) AS n_above_60,
    avg(CAST(mean > 0.5 AS INT)) AS share_above_50, avg(CAST(mean > 0.6 AS INT)) AS share_above_60,
    quantile_cont(mean, 0.5) AS p50, quantile_cont(mean, 0.75) AS p75, quantile_cont(mean, 0.9) AS p90, quantile_cont(mean, 0.99) AS p99
  FROM preds GROUP BY horizon) SELECT horizon, n, n_above_50, n_above_60, {sel(_PQ)} FROM o""")
def q_prediction_quantiles(spark, sf):
    return H.prediction_quantiles(S.predictions(spark, sf))


@query(f"""WITH {JL}, o AS (SELECT horizon, avg(actual) AS p_up, avg(mean) AS mean_p, avg(mean) - avg(actual) AS bias FROM j GROUP BY horizon)
  SELECT horizon, {sel(['p_up', 'mean_p', 'bias'])} FROM o""")
def q_prior_bias(spark, sf):
    return H.prior_bias(joined(spark, sf, "target_h"))


@query(f"""WITH {JL}, o AS (SELECT horizon, max(mean) - min(mean) AS range, avg(std) AS mean_std FROM preds GROUP BY horizon),
  l AS (SELECT horizon, avg(CAST(mean < 0.5 AS INT)) AS alpha FROM j WHERE actual >= 0.5 GROUP BY horizon)
  SELECT horizon, {sel(['range', 'mean_std', 'alpha'])}, CAST(range >= 0.15 AS INT) AS range_ok, CAST(mean_std >= 0.02 AS INT) AS std_ok,
    CAST(alpha BETWEEN 0.05 AND 0.45 AS INT) AS alpha_ok FROM o LEFT JOIN l USING (horizon)""")
def q_acceptance_checks(spark, sf):
    """The level checked is the share of positive outcomes that a cut at one half misses."""
    known = joined(spark, sf, "target_h")
    missed = known.filter("actual >= 0.5").groupBy("horizon").agg(F.avg((F.col("mean") < 0.5).cast("int")).alias("alpha"))
    return H.acceptance_checks(S.predictions(spark, sf), missed)


def _ranks(x: str) -> str:
    return f"rank() OVER (PARTITION BY horizon ORDER BY {x}) + (count(*) OVER (PARTITION BY horizon, {x}) - 1) / 2.0::DOUBLE"


@query(f"""WITH {J}, r AS (SELECT horizon, {_ranks('mean')} AS a, {_ranks('actual')} AS b FROM j),
  o AS (SELECT horizon, corr(a, b) AS rank_ic FROM r GROUP BY horizon)
  SELECT horizon, {rnd('rank_ic')} AS rank_ic, {rnd('least(0.3::DOUBLE, greatest(-0.3::DOUBLE, rank_ic))')} AS rank_ic_clipped FROM o""")
def q_rank_ic(spark, sf):
    return H.rank_ic(joined(spark, sf))


@query(f"""WITH {J}, p AS (SELECT horizon, (2 * mean - 1) * actual - 0.001::DOUBLE * abs(2 * mean - 1) AS x FROM j),
  o AS (SELECT horizon, avg(x) AS mean_pnl, stddev_pop(x) AS std_pnl, avg(x) / greatest(stddev_pop(x), 1e-9) AS sharpe FROM p GROUP BY horizon)
  SELECT horizon, {sel(['mean_pnl', 'std_pnl', 'sharpe'])} FROM o""")
def q_signal_sharpe(spark, sf):
    return H.signal_sharpe(joined(spark, sf), 0.001)


@query(f"""WITH {S.PREDS}, l AS (SELECT lag(mean) OVER (PARTITION BY ts, ticker ORDER BY horizon) - mean AS d FROM preds)
  SELECT count(d) AS n_pairs, {rnd('avg(pow(greatest(d, 0), 2))')} AS penalty FROM l WHERE d IS NOT NULL""")
def q_horizon_monotonicity(spark, sf):
    return H.horizon_monotonicity(S.predictions(spark, sf))

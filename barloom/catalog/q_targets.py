"""Queries of targets, splits, scaling, folds and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query, rnd, rounded
from barloom.operators import splits as G
from barloom.operators import targets as T
from barloom.plans import panels as S
from barloom.session import materialize

K = ["ticker"]
H = list(S.PRED_HORIZONS)
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


_NLR = [f"target_h{h}" for h in (6, 12)]


@query(f"""WITH {S.BARS}, o AS (SELECT ticker, ts, {', '.join(f"(ln(nullif(lead(close, {h}) OVER s, 0)) - ln(nullif(close, 0))) / {h} AS target_h{h}" for h in (6, 12))}
  FROM bars {S.SERIES}) SELECT {rounded(_NLR, K)} FROM o""")
def q_norm_log_return(spark, sf):
    return T.norm_log_return(S.bars(spark, sf), (6, 12)).select("ticker", "ts", *_NLR)


_LAB = [c for h in H for c in (f"target_h{h}", f"lr_h{h}")]


@query(f"WITH {S.PANEL} SELECT {rounded(_LAB, K, digits=5)} FROM panel", digits=5)
def q_cost_labels_long(spark, sf):
    return T.cost_labels_long(
        S.bars(spark, sf), H, entry_cost=S.COST, exit_cost=S.COST
    ).select("ticker", "ts", *_LAB)


def _short(h: int) -> str:
    return f"""CASE WHEN lead(open) OVER s IS NOT NULL AND lead(close, {h}) OVER s IS NOT NULL THEN
      CAST(ln(greatest(greatest(lead(open) OVER s * (1.0::DOUBLE - {S.COST}::DOUBLE), 1e-8)
        / greatest(lead(close, {h}) OVER s * (1.0::DOUBLE + {S.COST}::DOUBLE), 1e-8), 1e-8)) AS FLOAT) END AS lr_h{h}"""


@query(f"""WITH {S.BARS}, o AS (SELECT ticker, ts, {', '.join(_short(h) for h in H)} FROM bars {S.SERIES}),
  l AS (SELECT *, {', '.join(f"CAST(CASE WHEN lr_h{h} > 0 THEN 1 WHEN lr_h{h} IS NOT NULL THEN 0 END AS FLOAT) AS target_h{h}" for h in H)} FROM o)
  SELECT {rounded(_LAB, K, digits=5)} FROM l""", digits=5)
def q_cost_labels_short(spark, sf):
    return T.cost_labels_short(
        S.bars(spark, sf), H, entry_cost=S.COST, exit_cost=S.COST
    ).select("ticker", "ts", *_LAB)


@query(f"""WITH {S.PANEL}, o AS (SELECT ticker, ts, target_h3 * 0.9::DOUBLE + (1 - target_h3) * 0.1::DOUBLE AS target_h3 FROM panel)
  SELECT {rounded(['target_h3'], K, digits=5)} FROM o""", digits=5)
def q_label_smoothing(spark, sf):
    return T.cost_labels(
        S.bars(spark, sf), (3,), entry_cost=S.COST, exit_cost=S.COST, label_smoothing=0.1
    ).select("ticker", "ts", "target_h3")


_META = [f"meta_target_h{h}" for h in H]


@query(f"""WITH {S.PANEL}, o AS (SELECT ticker, ts, {', '.join(f"CAST(CASE WHEN lr_h{h} IS NOT NULL THEN CAST(lr_h{h} > 0.002::DOUBLE AS INT) END AS FLOAT) AS meta_target_h{h}" for h in H)} FROM panel)
  SELECT {rounded(_META, K)} FROM o""")
def q_meta_target(spark, sf):
    return T.meta_target(S.model_panel(spark, sf), H).select("ticker", "ts", *_META)


_SPLIT = """times AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel)),
split AS (SELECT panel.*, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train' WHEN i < floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM panel JOIN times USING (ts))"""
_PURGED = """purged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, split ORDER BY ts DESC) AS back FROM split)
  WHERE split = 'test' OR back > 12)"""


def split_panel(spark, sf):
    return G.chrono_split(materialize(S.model_panel(spark, sf)))


@query(f"WITH {S.PANEL}, {_SPLIT} SELECT ticker, {TS}, split FROM split")
def q_chrono_split(spark, sf):
    return split_panel(spark, sf).select("ticker", "ts", "split")


@query(f"WITH {S.PANEL}, {_SPLIT}, {_PURGED} SELECT ticker, {TS}, split FROM purged")
def q_purge_tail(spark, sf):
    return G.purge_tail(split_panel(spark, sf), 12).select("ticker", "ts", "split")


_FEAT = ["close", "volume", "lr_5", "vol_12"]
_FIT = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) <= 1e-12 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _FEAT)


@query(f"""WITH {S.PANEL}, {_SPLIT}, fit AS (SELECT {_FIT} FROM split WHERE split = 'train'), t AS (
  {' UNION ALL '.join(f'''SELECT '{c}' AS "column", m_{c} AS mean, s_{c} AS std FROM fit''' for c in _FEAT)})
  SELECT "column", {rnd('mean', 5)} AS mean, {rnd('std', 5)} AS std FROM t""", digits=5)
def q_scaler_fit(spark, sf):
    return G.scaler_fit(split_panel(spark, sf).filter("split = 'train'"), _FEAT)


@query(f"""WITH {S.PANEL}, {_SPLIT}, fit AS (SELECT {_FIT} FROM split WHERE split = 'train'),
  o AS (SELECT ticker, ts, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _FEAT)} FROM split, fit)
  SELECT {rounded(_FEAT, K)} FROM o""")
def q_scaler_transform(spark, sf):
    df = materialize(split_panel(spark, sf))
    params = G.scaler_fit(df.filter("split = 'train'"), _FEAT)
    return G.scaler_transform(df, params, _FEAT).select("ticker", "ts", *_FEAT)


_WIN = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {S.PANEL}, o AS (SELECT ticker, ts, count(lr_5) {_WIN} AS n, sum(CAST(close AS FLOAT)::DOUBLE) {_WIN} AS sum_close,
    sum(CAST(lr_5 AS FLOAT)::DOUBLE) {_WIN} AS sum_lr, target_h3, target_h6 FROM panel)
  SELECT ticker, {TS}, 16 AS n_rows, {rnd('sum_close', 3)} AS sum_close, {rnd('sum_lr', 3)} AS sum_lr,
    target_h3::DOUBLE AS y3, target_h6::DOUBLE AS y6 FROM o WHERE n = 16 AND target_h3 IS NOT NULL AND target_h6 IS NOT NULL""", digits=3)
def q_sliding_windows(spark, sf):
    w = G.sliding_windows(S.model_panel(spark, sf), ["close", "lr_5"], ["target_h3", "target_h6"], 16)

    def total(j):
        return F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r[j].cast("double"))

    return w.select(
        "ticker", "ts", F.size("x").alias("n_rows"), total(0).alias("sum_close"), total(1).alias("sum_lr"),
        F.col("y")[0].cast("double").alias("y3"), F.col("y")[1].cast("double").alias("y6"),
    )


@query(f"""WITH {S.PANEL}, {_SPLIT}, l AS ({' UNION ALL '.join(f"SELECT split, {h} AS horizon, target_h{h} AS y FROM split" for h in H)})
  SELECT split, horizon, count(*) AS n, {rnd('avg(CASE WHEN y >= 0.5 THEN 1.0::DOUBLE ELSE 0 END)')} AS p_up
  FROM l WHERE y IS NOT NULL GROUP BY split, horizon""")
def q_class_priors(spark, sf):
    return G.class_priors(split_panel(spark, sf), H)


_WS = ["w_pos", "w_neg", "pos_weight", "pos_weight_plain"]


@query(f"""WITH {S.PREDS}, c AS (SELECT horizon, count(*) FILTER (actual >= 0.5) AS n_pos, count(*) FILTER (actual < 0.5) AS n_neg,
    least(0.95, greatest(0.05, avg(actual))) AS p FROM labels_l GROUP BY horizon),
  w AS (SELECT *, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, greatest(n_pos, 1))) AS a,
    (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, greatest(n_neg, 1))) AS b FROM c),
  o AS (SELECT horizon, n_pos, n_neg, 2 * a / (a + b) AS w_pos, 2 * b / (a + b) AS w_neg, a / b AS pos_weight, (1 - p) / p AS pos_weight_plain FROM w)
  SELECT horizon, n_pos, n_neg, {', '.join(f'{rnd(c)} AS {c}' for c in _WS)} FROM o""")
def q_class_weights(spark, sf):
    return G.class_weights(S.actuals(spark, sf, "target_h"))


@query(f"""WITH {S.PREDS} SELECT horizon, {rnd('greatest(2 * quantile_cont(abs(actual), 0.5), 1e-4)')} AS robust_scale
  FROM actuals GROUP BY horizon""")
def q_robust_scale(spark, sf):
    return G.robust_scale(S.actuals(spark, sf), "actual")


@query(f"""WITH {S.BARS}, r AS (SELECT ticker, ts, row_number() OVER (ORDER BY ts, ticker) - 1 AS i, count(*) OVER () AS n FROM bars)
  SELECT ticker, {TS}, CAST(CASE WHEN i >= n - 5 * (n // 6) THEN (i - (n - 5 * (n // 6))) // (n // 6) END AS DOUBLE) AS fold FROM r""")
def q_forward_folds(spark, sf):
    f = G.forward_folds(S.bars(spark, sf).select("ticker", "ts"))
    return f.withColumn("fold", F.col("fold").cast("double"))


@query(f"""WITH {S.PANEL} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_discrepancies FROM panel WHERE lr_h6 IS NOT NULL""")
def q_label_audit(spark, sf):
    return T.label_audit(
        S.model_panel(spark, sf), 6, entry_cost=S.COST, exit_cost=S.COST
    ).drop("max_diff")


@query(f"WITH {S.PREDS} SELECT ticker, {TS}, horizon, {rnd('actual', 5)} AS actual FROM actuals", digits=5)
def q_targets_long(spark, sf):
    return S.actuals(spark, sf)


@query(f"""WITH {S.PREDS} SELECT ticker, {TS}, horizon, {rnd('actual', 5)} AS actual
  FROM (SELECT ts, ticker, horizon FROM preds) JOIN actuals USING (ts, ticker, horizon)""", digits=5)
def q_attach_targets(spark, sf):
    return T.attach_targets(S.predictions(spark, sf), S.model_panel(spark, sf), H)


@query(f"""WITH {S.PANEL} SELECT ticker, {TS}, {rnd('lr_5')} AS lr_5, {rnd('vol_12')} AS vol_12,
  CAST(target_h6 >= 0.5 AS INT)::DOUBLE AS label FROM panel WHERE target_h6 IS NOT NULL""")
def q_tabular_rows(spark, sf):
    return T.tabular_rows(S.model_panel(spark, sf), ["lr_5", "vol_12"], 6, "ticker", "ts")


@query(f"""WITH {S.PREDS}, k AS (SELECT DISTINCT ts, ticker FROM preds)
  SELECT ticker, {TS}, {', '.join(f"{rnd(f'coalesce(CAST(lr_h{h} AS DOUBLE), 0)', 5)} AS lr_h{h}" for h in H)} FROM k JOIN panel USING (ts, ticker)""", digits=5)
def q_wide_targets(spark, sf):
    panel = materialize(S.model_panel(spark, sf))
    return T.wide_targets(S.predictions(spark, sf, panel=panel), panel, H)


@query(f"""WITH {S.PANEL}, t AS (SELECT * FROM panel WHERE target_h6 IS NOT NULL),
  m AS (SELECT avg(CAST(target_h6 >= 0.5 AS INT)) <= 0.5 AS up FROM t)
  SELECT ticker, {TS}, target_h6::DOUBLE AS target_h6 FROM t, m WHERE (target_h6 >= 0.5) = up""")
def q_minority_rows(spark, sf):
    return T.minority_rows(S.model_panel(spark, sf), 6).select("ticker", "ts", "target_h6")

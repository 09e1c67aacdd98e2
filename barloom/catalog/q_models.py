"""Queries of learners and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog.q_evaluation import TS, joined
from barloom.catalog.q_sources import landing
from barloom.catalog.q_targets import _PURGED, _SPLIT
from barloom.catalog.registry import query, rnd, rounded
from barloom.operators import models as M
from barloom.operators import predictions as H
from barloom.operators.blocks import over_blocks
from barloom.operators.splits import chrono_split, class_weights, forward_folds, purge_tail
from barloom.operators.targets import targets_long
from barloom.plans import panels as S
from barloom.session import checkpoint_dir, materialize
from barloom.streaming import late as W
from barloom.streaming import live as V

FEATURES = ["lr_1", "lr_5", "vol_12", "rv_up_12", "rv_dn_12", "volume"]
HS = tuple(S.PRED_HORIZONS)


def dataset(spark, sf):
    # the cuts, the counts of the purge and the rows all read the panel
    made = [f"{c}_h{h}" for c in ("lr", "target") for h in HS]
    panel = materialize(S.model_panel(spark, sf).select("ticker", "ts", *FEATURES, *made))
    rows = materialize(purge_tail(chrono_split(panel), 12))
    return {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}


_ROWS = f"{S.PANEL}, {_SPLIT}, {_PURGED}"
_KNOWN = "lr_1 IS NOT NULL AND lr_5 IS NOT NULL AND vol_12 IS NOT NULL"


@query(f"""WITH {_ROWS} SELECT horizon, count(*) AS n_rows, count(*) AS n_probable, 1 AS better FROM purged, (SELECT unnest({list(HS)}) AS horizon)
  WHERE split = 'test' AND {_KNOWN} GROUP BY horizon""")
def q_learner_checks(spark, sf):
    """Every horizon learned from a planted signal: all test rows scored with probabilities, far better than chance."""
    d = dataset(spark, sf)
    planted = {f"target_h{h}": (F.col("lr_5") > 0).cast("float") for h in HS}
    models = M.fit_per_horizon(d["train"].withColumns(planted), FEATURES, HS, learner=M.learners()["linear"], stored=True)
    test = materialize(d["test"].withColumns(planted))
    scored = materialize(M.predict_long(models, test, FEATURES))
    rows = scored.groupBy("horizon").agg(F.count("*").alias("n_rows"), F.count_if(F.col("mean").between(0, 1)).alias("n_probable"))
    quality = H.auc(H.with_actuals(scored, targets_long(test, HS, "target_h")))
    return rows.join(quality.select("horizon", (F.col("auc") > 0.9).cast("int").alias("better")), "horizon")


@query(f"""WITH {_ROWS}, t AS (SELECT *, row_number() OVER (ORDER BY ts, ticker) - 1 AS i, count(*) OVER () AS n FROM purged WHERE split = 'train'),
  f AS (SELECT *, i >= n - 5 * floor(n / 6) AS tested FROM t)
  {' UNION ALL '.join(f"SELECT {h} AS horizon, count(*) AS n_rows, count(*) FILTER (NOT tested) AS n_first, count(*) FILTER (tested AND {_KNOWN} AND target_h{h} IS NOT NULL) AS n_scored FROM f" for h in HS)}""")
def q_oof_checks(spark, sf):
    """Out-of-fold rows: all come back, the first block has no score, every other known row has one."""
    train = dataset(spark, sf)["train"]
    out = M.oof_predictions(train, FEATURES, HS, learner=M.learners()["linear"])
    folds = forward_folds(train).select("ts", "ticker", "fold")
    both = out.join(folds, ["ts", "ticker"])
    per = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"primary_h{h}").alias("p")) for h in HS])).alias("x")
    return both.select("fold", per).groupBy("x.horizon").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("fold").isNull()).alias("n_first"), F.count("x.p").alias("n_scored")
    )


_PLANTED = {h: f"lr_5 > {0.02 * i + 0.1}" for i, h in enumerate(HS)}


def planted(df):
    return df.withColumns({f"target_h{h}": F.when(F.expr(rule), 1.0).otherwise(0.0).cast("float") for h, rule in _PLANTED.items()})


@query(f"""WITH {_ROWS}, l AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, split, CAST({rule} AS INT) AS y FROM purged WHERE {_KNOWN}" for h, rule in _PLANTED.items())}),
  w AS (SELECT horizon, count(*) FILTER (split = 'test' AND y = 1) AS n_up, count(*) FILTER (split = 'test') AS n_rows FROM l GROUP BY horizon)
  SELECT horizon, n_rows, n_up, 1 AS found_more, 1 AS better FROM w""")
def q_fit_weighted(spark, sf):
    """Fits with the class weights of their horizon: a rare planted class is found at least as often as without, and well ranked."""
    d = dataset(spark, sf)
    train = materialize(planted(d["train"].dropna(subset=FEATURES)))
    test = materialize(planted(d["test"].dropna(subset=FEATURES)))
    weights = class_weights(targets_long(train, HS, "target_h"))
    truth = targets_long(test, HS, "target_h")
    found = {}
    for name, extra in (("plain", None), ("weighted", weights)):
        models = M.fit_per_horizon(train, FEATURES, HS, learner=M.learners()["linear"], class_weights=extra, stored=True)
        found[name] = materialize(H.with_actuals(M.predict_long(models, test, FEATURES), truth))
    hits = F.count_if((F.col("mean") >= 0.5) & (F.col("actual") >= 0.5))
    plain = found["plain"].groupBy("horizon").agg(hits.alias("n_plain"))
    made = found["weighted"].groupBy("horizon").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("actual") >= 0.5).alias("n_up"), hits.alias("n_hits")
    )
    quality = H.auc(found["weighted"]).select("horizon", (F.col("auc") > 0.9).cast("int").alias("better"))
    more = (F.col("n_hits") >= F.col("n_plain")).cast("int").alias("found_more")
    return made.join(plain, "horizon").join(quality, "horizon").select("horizon", "n_rows", "n_up", more, "better")


_FAMILIES = ", ".join(f"('{f.rpartition('_')[0] or f}')" for f in FEATURES)


@query(f"""WITH {S.PANEL}, f(family) AS (VALUES {_FAMILIES}), n AS (SELECT family, count(*) AS n_features FROM f GROUP BY family),
  h AS (SELECT DISTINCT unnest({list(HS)}) AS horizon FROM panel)
  SELECT horizon, family, n_features, CAST(family = 'lr' AS INT) AS leads FROM h, n""")
def q_feature_families(spark, sf):
    """Important features counted per family; the planted signal's family leads."""
    train = planted(dataset(spark, sf)["train"])
    models = M.fit_per_horizon(train, FEATURES, HS, stored=True)
    made = M.family_counts(M.feature_importance(models, FEATURES, spark, len(FEATURES)))
    return made.select("horizon", "family", "n_features", (F.col("best_rank") == 1).cast("int").alias("leads"))


@query()
def q_fit_per_horizon(spark, sf):
    d = dataset(spark, sf)
    models = M.fit_per_horizon(d["train"], FEATURES, HS, validation=d["val"], stored=True)
    scored = H.with_actuals(M.predict_long(models, d["test"], FEATURES), S.actuals(spark, sf, "target_h"))
    return H.auc(scored)


@query()
def q_predict_long(spark, sf):
    d = dataset(spark, sf)
    models = M.fit_per_horizon(d["train"], FEATURES, HS, learner=M.learners()["linear"], stored=True)
    return M.predict_long(models, d["test"], FEATURES)


@query()
def q_fit_ensemble(spark, sf):
    """Boosting, extra trees and ordered boosting: mean and deviation of the three."""
    d = dataset(spark, sf)
    models = M.fit_tree_ensemble(d["train"], FEATURES, HS, validation=d["val"])
    return H.ensemble_moments(M.tree_members(models, d["test"], FEATURES))


@query(f"""WITH {_ROWS}, m(member) AS (VALUES ('boosted'), ('extra_trees'), ('ordered'))
  SELECT horizon, member, count(*) AS n_rows, count(*) AS n_probable, 1 AS better FROM purged, (SELECT unnest({list(HS)}) AS horizon), m
  WHERE split = 'test' AND {_KNOWN} GROUP BY horizon, member""")
def q_ensemble_checks(spark, sf):
    """Every member learns a planted signal of every horizon: all test rows scored with probabilities, far better than chance."""
    d = dataset(spark, sf)
    train, test = planted(d["train"]), materialize(planted(d["test"]))
    scored = materialize(M.tree_members(M.fit_tree_ensemble(train, FEATURES, HS), test, FEATURES))
    rows = scored.groupBy("horizon", "member").agg(F.count("*").alias("n_rows"), F.count_if(F.col("mean").between(0, 1)).alias("n_probable"))
    truth = targets_long(test, HS, "target_h")
    found = None
    for name in ("boosted", "extra_trees", "ordered"):
        part = H.auc(H.with_actuals(scored.filter(F.col("member") == name).drop("member"), truth))
        part = part.select("horizon", F.lit(name).alias("member"), (F.col("auc") > 0.9).cast("int").alias("better"))
        found = part if found is None else found.unionByName(part)
    return rows.join(found, ["horizon", "member"])


@query()
def q_oof_predictions(spark, sf):
    d = dataset(spark, sf)
    out = M.oof_predictions(d["train"], FEATURES, HS, learner=M.learners()["linear"])
    return out.select("ts", "ticker", *[f"primary_h{h}" for h in HS])


@query()
def q_meta_label_pipeline(spark, sf):
    d = dataset(spark, sf)
    primary, meta = M.meta_label_pipeline(d["train"], FEATURES, HS, learner=M.learners()["linear"])
    p, m = M.predict_meta(primary, meta, d["test"], FEATURES)
    return p.select(*H.KEY3, F.col("mean").alias("primary")).join(m.select(*H.KEY3, F.col("mean").alias("meta")), H.KEY3)


@query()
def q_feature_importance_topn(spark, sf):
    d = dataset(spark, sf)
    models = M.fit_per_horizon(d["train"], FEATURES, HS)
    return M.feature_importance(models, FEATURES, spark, 20)


@query()
def q_model_registry(spark, sf):
    d = dataset(spark, sf)
    path = landing(spark, "models")
    M.save_models(M.fit_per_horizon(d["train"], FEATURES, HS), path, spark, FEATURES)
    models, features = M.load_models(path, spark)
    return M.predict_long(models, d["test"], features)


def _plain_model():
    return lambda x: 1.0 / (1.0 + (2.718281828459045 ** (-(x["lr_5"] * 0.5 + x["vol_12"]))))


@query(f"""WITH {S.PANEL}, o AS (SELECT ticker, ts, 1 / (1 + pow(2.718281828459045::DOUBLE, -(lr_5 * 0.5::DOUBLE + vol_12))) AS score FROM panel
  WHERE lr_5 IS NOT NULL AND vol_12 IS NOT NULL) SELECT {rounded(['score'], ['ticker'])} FROM o""")
def q_batch_score(spark, sf):
    rows = S.model_panel(spark, sf).select("ticker", "ts", "lr_5", "vol_12").dropna()
    return M.batch_score(rows, ["lr_5", "vol_12"], _plain_model).select("ticker", "ts", "score")


# --- streams: landed in time order, run once over everything, compared with SQL ---

def run_to_table(df, spark, mode="append"):
    out = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = (
        df.writeStream.outputMode(mode).format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/table")
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/table")


def landed_ticks(spark, sf, rows=S.event_ticks):
    path = landing(spark, "ticks")
    ticks = rows(spark, sf)
    ticks.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(path)
    return path, ticks.schema


_OHLCV = ["open", "high", "low", "close", "volume"]


@query(f"""WITH {S.EVENT_TICKS}, b AS (SELECT ticker, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(qty) AS volume FROM event_ticks GROUP BY 1, time_bucket(INTERVAL 60 MINUTE, ts)),
  m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM event_ticks)
  SELECT {rounded(_OHLCV, ['ticker'])} FROM b, m WHERE ts + INTERVAL 60 MINUTE <= mark""")
def q_stream_bars(spark, sf):
    path, schema = landed_ticks(spark, sf)
    ticks = V.read_parquet_stream(spark, path, schema)
    return run_to_table(V.stream_bars(ticks, 60, order="event_id"), spark)


@query(f"WITH {S.EVENT_ROWS} SELECT event_id, ticker, {rnd('price')} AS price, {rnd('qty')} AS qty FROM event_rows")
def q_stream_dedupe(spark, sf):
    path, schema = landed_ticks(spark, sf, S.event_rows)
    again = spark.read.parquet(path)
    again.write.mode("append").parquet(path)
    ticks = V.read_parquet_stream(spark, path, schema)
    return run_to_table(V.stream_dedupe(ticks, ["event_id"], lateness="60 days"), spark).drop("ts")


_AL = ["expected_return", "uncertainty", "alert_strength"]


@query(f"""WITH {S.PREDS}, best AS (SELECT *, row_number() OVER (PARTITION BY ts, ticker ORDER BY mean DESC, horizon) AS rn FROM preds),
  b1 AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mean DESC, ticker) AS rank FROM best WHERE rn = 1),
  l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM b1),
  o AS (SELECT ticker, ts, horizon AS best_horizon, mean AS expected_return, std AS uncertainty, CASE WHEN std > 1e-9 THEN mean / std ELSE 0 END AS alert_strength, CAST(rank AS INT) AS rank FROM l WHERE back = 1)
  SELECT ticker, {TS}, best_horizon, rank, {', '.join(f'{rnd(c)} AS {c}' for c in _AL)},
    CAST(expected_return >= 0.6 AND uncertainty <= 0.2 AND alert_strength >= 2 AS INT) AS alert FROM o""")
def q_stream_latest_alerts(spark, sf):
    """A file holds all rows of its times, so a batch may take any of them: it takes as many as are read side by side."""
    path, out, check = (landing(spark, n) for n in ("preds", "alerts", "check"))
    p = S.predictions(spark, sf)
    p.repartitionByRange("ts").write.parquet(path)
    stream = V.read_parquet_stream(spark, path, p.schema, W.FILES)
    V.start_latest_alerts(stream, out, check, every=None, min_return=0.6, max_std=0.2).awaitTermination()
    return V.latest_alerts(spark, out)


@query(f"""WITH {S.BARS}, w AS (SELECT ticker, CAST(ts AS DATE) + 1 AS day, volume AS prior_volume FROM bars),
  g AS (SELECT b.ticker, b.ts, b.close, w.prior_volume FROM bars b ASOF LEFT JOIN w ON b.ticker = w.ticker AND CAST(b.ts AS DATE) >= w.day)
  SELECT {rounded(['close', 'prior_volume'], ['ticker'])} FROM g""")
def q_stream_asof_static(spark, sf):
    bars = materialize(S.bars(spark, sf).select("ticker", "ts", "close", "volume"))
    daily = bars.select("ticker", F.date_add(F.to_date("ts"), 1).alias("day"), F.col("volume").alias("prior_volume"))
    days = bars.select("ticker", F.to_date("ts").alias("day"))
    valid = materialize(V.validity_days(daily, days, ["prior_volume"]))
    path = landing(spark, "bars")
    bars.select("ticker", "ts", "close").write.parquet(path)
    stream = V.read_parquet_stream(spark, path, bars.select("ticker", "ts", "close").schema)
    return run_to_table(V.stream_asof_static(stream, valid, ["prior_volume"]), spark)


WAIT, SPAN = 91, 182


def late_rows(spark, sf):
    """Predictions, and labels with the bar that makes them known, each stored by span of its time."""
    panel = materialize(S.model_panel(spark, sf))
    p = S.predictions(spark, sf, panel=panel).select("ts", "ticker", "horizon", (F.rint(F.col("mean") * 1e6) / 1e6).alias("mean"))

    def known(df, b):
        cells = [F.struct(F.lit(h).alias("horizon"), F.lead("ts", h).over(b.window).alias("known_at"), F.col(f"target_h{h}").cast("double").alias("actual")) for h in HS]
        return df.withColumn("_told", F.array(*cells))

    told = over_blocks(panel.select("ticker", "ts", *[f"target_h{h}" for h in HS]), known, back=0, ahead=max(HS))
    labels = told.select("ts", "ticker", F.explode("_told").alias("t")).select("ts", "ticker", "t.*").dropna()
    return W.by_span(p, "ts", WAIT), W.by_span(labels, "known_at", WAIT)


@query(f"""WITH {S.PREDS}, k AS ({' UNION ALL '.join(f"SELECT ts, ticker, {h} AS horizon, lead(ts, {h}) OVER s AS known_at, CAST(target_h{h} AS DOUBLE) AS actual FROM panel WINDOW s AS (PARTITION BY ticker ORDER BY ts)" for h in HS)}),
  j AS (SELECT ticker, horizon, known_at, round_even(mean * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE AS mean, actual FROM preds JOIN k USING (ts, ticker, horizon)
    WHERE actual IS NOT NULL AND known_at BETWEEN ts AND ts + INTERVAL {WAIT} DAY),
  s AS (SELECT horizon, date_diff('day', DATE '1970-01-01', CAST(known_at AS DATE)) // {SPAN} AS w, abs(mean - actual) AS s FROM j),
  r AS (SELECT *, row_number() OVER (PARTITION BY horizon, w ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY horizon, w) AS n FROM s),
  e AS (SELECT *, least(1.0::DOUBLE, (1 - 0.1::DOUBLE) * (1 + 1.0::DOUBLE / n)) * (n - 1) AS pos FROM r),
  v AS (SELECT horizon, w, any_value(n) AS n, any_value(pos) AS pos, max(s) FILTER (i = floor(pos)) AS lo, max(s) FILTER (i = least(ceil(pos), n - 1)) AS hi FROM e GROUP BY ALL),
  q AS (SELECT horizon, w, n, lo + (hi - lo) * (pos - floor(pos)) AS q FROM v),
  b AS (SELECT *, lag(q) OVER (PARTITION BY horizon ORDER BY w) AS q0 FROM q),
  c AS (SELECT horizon, w, avg(CAST(s <= q0 AS INT)) AS coverage FROM s JOIN b USING (horizon, w) GROUP BY ALL)
  SELECT horizon, strftime(DATE '1970-01-01' + CAST(w * {SPAN} AS INT), '%Y-%m-%d') AS window_start, n AS n_calibration, {rnd('q')} AS quantile,
    {rnd('greatest(q, 1 - q)')} AS threshold, {rnd('coverage')} AS coverage FROM b JOIN c USING (horizon, w)""")
def q_stream_late_labels(spark, sf):
    """Predictions wait in a stream-stream join for labels of later bars; windows of known labels are calibrated.

    Both sides land a span of days after the other, small spans together, and the stream takes them in batches in that order."""
    sides, widest = [], 1
    for rows in late_rows(spark, sf):
        path = landing(spark, "late")
        widest = max(widest, W.land_spans(rows, path, least=W.ROWS))
        sides.append(V.read_parquet_stream(spark, path, rows.drop(W.SLICE).schema, W.FILES))
    pairs = W.late_labels(*sides, f"{WAIT} days", lateness=f"{WAIT * widest} days")
    return W.window_calibration(run_to_table(pairs, spark), SPAN)

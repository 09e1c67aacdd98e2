"""Per-horizon classifiers on Spark ML: fit, predict, out-of-fold, meta labels.

Training runs on the cluster's rows; only the per-horizon loop and model
handles live on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.predictions import ensemble_moments, primary_wide_join
from barloom.operators.splits import forward_folds
from barloom.operators.targets import meta_target
from barloom.operators.trees import TreeModel, fit_extra_trees, fit_ordered_boosting, predict_trees, tree_rows
from barloom.session import materialize

C = F.col
SEED = 42


def boosted(max_iter: int = 20, depth: int = 4, step: float = 0.1) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=depth,
        stepSize=step, subsamplingRate=0.8, seed=SEED,
    )


def learners(max_iter: int = 20) -> dict[str, object]:
    """Base learners of the ensemble."""
    return {
        "boosted": boosted(max_iter),
        "forest": RandomForestClassifier(
            featuresCol="features", labelCol="label", numTrees=max_iter, maxDepth=5, seed=SEED
        ),
        "linear": LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01),
    }


def _rows(
    df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()
) -> DataFrame:
    known = df.filter(C(target).isNotNull()).dropna(subset=list(features))
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(known)
    return assembled.select("features", (C(target) >= 0.5).cast("double").alias("label"), *keep)


def fit_per_horizon(
    train: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    *,
    validation: DataFrame | None = None,
    weight: str | None = None,
    class_weights: DataFrame | None = None,
    learner: object | None = None,
    prefix: str = "target_h",
    stored: bool = False,
) -> dict[int, Model]:
    """One classifier per horizon over all tickers.

    All horizons read one stored table of the features, targets and weights.  ``stored`` says that the
    frames given are such tables, or plain filters and projections of them: they are read as they are.

    With ``validation`` boosting stops when it no longer improves there.  A
    horizon without a target column, or with a single class, is skipped.
    ``class_weights`` has ``w_pos`` and ``w_neg`` per horizon; they multiply the
    row weights of the column ``weight``, if both are given.
    """
    models: dict[int, Model] = {}
    # one row per horizon
    told = [] if class_weights is None else class_weights.filter(C("horizon").isin(list(horizons))).collect()
    per_class = {r["horizon"]: (r["w_pos"], r["w_neg"]) for r in told}
    targets = {h: f"{prefix}{h}" for h in horizons if f"{prefix}{h}" in train.columns}
    if not targets:
        return models
    keep = [weight] if weight else []

    def source(df: DataFrame) -> DataFrame:
        df = df.dropna(subset=list(features))
        return df if stored else materialize(df.select(*dict.fromkeys([*features, *targets.values(), *keep])))

    train = source(train)
    validated = validation is not None and isinstance(learner or boosted(), GBTClassifier)
    held = source(validation) if validated else None
    up = {h: (C(t) >= 0.5).cast("int") for h, t in targets.items()}
    seen = train.agg(*[F.max(u).alias(f"most_{h}") for h, u in up.items()], *[F.min(u).alias(f"least_{h}") for h, u in up.items()]).first()
    for h, target in targets.items():
        # a single class, or no rows
        if seen[f"most_{h}"] == seen[f"least_{h}"]:
            continue
        est = (learner or boosted()).copy()
        rows = _rows(train, features, target, keep).withColumn("_val", F.lit(False))
        if weight or h in per_class:
            est = est.setWeightCol("_weight")
        if validated:
            rows = rows.unionByName(_rows(held, features, target, keep).withColumn("_val", F.lit(True)))
            est = est.setValidationIndicatorCol("_val")
        own = C(weight) if weight else F.lit(1.0)
        for_up, for_down = per_class.get(h, (1.0, 1.0))
        models[h] = est.fit(rows.withColumn("_weight", own * F.when(C("label") == 1.0, for_up).otherwise(for_down)))
    return models


def predict_long(
    models: dict[int, Model], df: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Probabilities of every horizon as (ts, ticker, horizon, mean, std = 0)."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.dropna(subset=list(features)).select("ts", "ticker", *features)
    )
    out: DataFrame | None = None
    for h, m in models.items():
        part = m.transform(rows).select(
            "ts", "ticker", F.lit(int(h)).alias("horizon"),
            vector_to_array("probability")[1].alias("mean"), F.lit(0.0).alias("std"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fitted horizon")
    return out


def fit_ensemble(
    train: DataFrame, features: Sequence[str], horizons: Sequence[int], *,
    bases: dict[str, object] | None = None, **kw,
) -> dict[str, dict[int, Model]]:
    return {
        name: fit_per_horizon(train, features, horizons, learner=est, **kw)
        for name, est in (bases or learners()).items()
    }


def predict_ensemble(
    members: dict[str, dict[int, Model]], df: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Mean and population deviation over the members."""
    out: DataFrame | None = None
    for name, models in members.items():
        part = predict_long(models, df, features).withColumn("member", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no members")
    return ensemble_moments(out)


def fit_tree_ensemble(
    train: DataFrame, features: Sequence[str], horizons: Sequence[int], *,
    validation: DataFrame | None = None, weight: str | None = None, prefix: str = "target_h",
    rounds: int = 20, n_trees: int = 20, depth: int = 5,
) -> tuple[dict[int, Model], dict[str, TreeModel]]:
    """Gradient boosting per horizon, and extra trees and ordered boosting of all horizons together.

    Early stopping on ``validation`` is for the first alone; ``weight`` goes to all three.
    """
    boost = fit_per_horizon(
        train, features, horizons, validation=validation, weight=weight, prefix=prefix, learner=boosted(rounds)
    )
    rows = tree_rows(train, features, horizons, prefix=prefix, weight=weight)
    return boost, {
        "extra_trees": fit_extra_trees(rows, n_trees=n_trees, depth=depth),
        "ordered": fit_ordered_boosting(rows, n_rounds=max(1, rounds // 2)),
    }


def tree_members(
    models: tuple[dict[int, Model], dict[str, TreeModel]], df: DataFrame, features: Sequence[str]
) -> DataFrame:
    """(ts, ticker, horizon, member, mean, std) of all three members; horizons that all of them know."""
    boost, trees = models
    shared = set(boost).intersection(*[set(m.horizons) for m in trees.values()])
    if not shared:
        raise ValueError("no fitted horizon")
    first = predict_long({h: boost[h] for h in sorted(shared)}, df, features).withColumn("member", F.lit("boosted"))
    return first.unionByName(predict_trees(trees, df).filter(C("horizon").isin(sorted(shared))))


def oof_predictions(
    train: DataFrame, features: Sequence[str], horizons: Sequence[int], *,
    n_splits: int = 5, learner: object | None = None, prefix: str = "target_h",
) -> DataFrame:
    """Out-of-fold probabilities: fold k is predicted by a model of all rows before it.

    All rows come back with ``primary_h*``; those of the first block, or without
    a target, have null.
    """
    folds = materialize(forward_folds(train, n_splits))
    long: DataFrame | None = None
    for k in range(n_splits):
        before = folds.filter(C("fold").isNull() | (C("fold") < k))
        models = fit_per_horizon(before, features, horizons, learner=learner, prefix=prefix, stored=True)
        if not models:
            continue
        part = predict_long(models, folds.filter(C("fold") == k), features)
        long = part if long is None else long.unionByName(part)
    if long is None:
        return train.withColumns({f"primary_h{h}": F.lit(None).cast("double") for h in horizons})
    wide = primary_wide_join(folds.drop("fold"), materialize(long), horizons)
    return wide.withColumns(
        {
            f"primary_h{h}": F.when(C(f"{prefix}{h}").isNotNull(), C(f"primary_h{h}"))
            for h in horizons
        }
    )


def meta_label_pipeline(
    train: DataFrame, features: Sequence[str], horizons: Sequence[int], *,
    cost: float = 0.001, multiplier: float = 2.0, n_splits: int = 5, learner: object | None = None,
) -> tuple[dict[int, Model], dict[int, tuple[Model, list[str]]]]:
    """Primary models on all rows and meta models on out-of-fold primaries.

    A meta model sees the features and the primary probability of its horizon
    and answers whether the trade beats ``multiplier`` times the cost.
    """
    oof = materialize(
        meta_target(
            oof_predictions(train, features, horizons, n_splits=n_splits, learner=learner),
            horizons, cost=cost, multiplier=multiplier,
        )
    )
    primary = fit_per_horizon(oof, features, horizons, learner=learner, stored=True)
    meta: dict[int, tuple[Model, list[str]]] = {}
    for h in horizons:
        cols = [*features, f"primary_h{h}"]
        made = fit_per_horizon(oof, cols, [h], learner=learner, prefix="meta_target_h", stored=True)
        if h in made:
            meta[h] = (made[h], cols)
    return primary, meta


def predict_meta(
    primary: dict[int, Model], meta: dict[int, tuple[Model, list[str]]], df: DataFrame,
    features: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Long primary and long meta probabilities."""
    long = materialize(predict_long(primary, df, features))
    wide = primary_wide_join(df, long, list(primary))
    out: DataFrame | None = None
    for h, (m, cols) in meta.items():
        part = predict_long({h: m}, wide, cols)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no meta model")
    return long, out


def feature_importance(
    models: dict[int, Model], features: Sequence[str], spark: SparkSession, n: int = 20
) -> DataFrame:
    """Top features per horizon with their family (the name before its last part)."""
    rows = [
        (int(h), f, float(m.featureImportances[i]))
        for h, m in models.items() for i, f in enumerate(features)
    ]
    df = spark.createDataFrame(rows, "horizon int, feature string, importance double")
    ranked = df.withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("horizon").orderBy(C("importance").desc(), "feature")
        ),
    ).filter(C("rank") <= n)
    return ranked.withColumn("family", F.regexp_replace("feature", r"_[^_]*$", ""))


def family_counts(importance: DataFrame) -> DataFrame:
    """Per horizon and family of ``feature_importance``: its features among the top, their share of the
    importance and the best of their ranks."""
    return importance.groupBy("horizon", "family").agg(
        F.count("*").alias("n_features"), F.sum("importance").alias("importance"), F.min("rank").alias("best_rank")
    )


def save_models(models: dict[int, Model], path: str, spark: SparkSession, features: Sequence[str]) -> None:
    """Spark ML models per horizon and a manifest table."""
    for h, m in models.items():
        PipelineModel([m]).write().overwrite().save(f"{path}/h={h}")
    manifest = [(int(h), type(m).__name__, list(features)) for h, m in models.items()]
    spark.createDataFrame(
        manifest, "horizon int, kind string, features array<string>"
    ).write.mode("overwrite").parquet(f"{path}/manifest")


def load_models(path: str, spark: SparkSession) -> tuple[dict[int, Model], list[str]]:
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("horizon").collect()
    models = {r["horizon"]: PipelineModel.load(f"{path}/h={r['horizon']}").stages[0] for r in manifest}
    return models, list(manifest[0]["features"]) if manifest else []


def batch_score(
    df: DataFrame, features: Sequence[str], load: Callable[[], Callable[[pd.DataFrame], Iterable[float]]],
    name: str = "score",
) -> DataFrame:
    """Score with any Python model: ``load`` runs once per task, then Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    cols = list(features)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b.assign(**{name: pd.Series(model(b[cols]), index=b.index, dtype="float64")})

    return df.mapInPandas(score, schema)

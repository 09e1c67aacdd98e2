"""Decision thresholds from validation predictions.

A sweep over thresholds never multiplies the rows: each row is counted in the
bin of the highest threshold it passes, and the tiny bin table is summed from
the top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip
from barloom.operators.predictions import KEY3
from barloom.operators.ranks import quantiles
from barloom.session import materialize

C = F.col

# Bounds and defaults of the cost-optimal threshold.
BAYES_FLOOR, BAYES_CEIL = 0.51, 0.95
DEFAULT_GAIN, MIN_GAIN, MIN_POSITIVES = 0.005, 1e-4, 5
PNL_SWEEP = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
GAIN_QUANTILES = (0.50, 0.60, 0.70, 0.80, 0.90, 0.95)
META_PERCENTILES = (5.0, 10.0, 15.0, 20.0, 30.0, 40.0, 50.0)
PRIMARY_THRESHOLDS = (0.45, 0.50, 0.55, 0.60, 0.65)


def expected_gain(actuals: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean winning log-return; a default when fewer than five win."""
    win = C("actual") > 0
    return actuals.groupBy(*group).agg(
        F.count_if(win).alias("n_pos"), F.avg(F.when(win, C("actual"))).alias("_g")
    ).select(
        *group,
        "n_pos",
        F.when(C("n_pos") < MIN_POSITIVES, F.lit(DEFAULT_GAIN))
        .otherwise(F.greatest("_g", F.lit(MIN_GAIN)))
        .alias("gain"),
    )


def bayes_threshold(gain: str | Column, cost: float) -> Column:
    """``cost / (cost + gain)`` within [0.51, 0.95]."""
    g = F.greatest(C(gain) if isinstance(gain, str) else gain, F.lit(MIN_GAIN))
    c = F.lit(max(cost, MIN_GAIN))
    return clip(c / (c + g), BAYES_FLOOR, BAYES_CEIL)


def _beyond(c: Column) -> dict[str, Column]:
    kept = F.when(c, C("actual"))
    return {
        "n_signals": F.count_if(c),
        "avg_actual": F.coalesce(F.avg(kept), F.lit(0.0)),
        "win_rate": F.coalesce(
            F.avg(F.when(c, (C("actual") > 0).cast("double"))), F.lit(0.0)
        ),
    }


def calibrate_bayes(joined: DataFrame, cost: float) -> DataFrame:
    """One row: gain, threshold and what lies at or above it."""
    joined = materialize(joined.select("mean", "actual"))
    t = expected_gain(joined).withColumn("threshold", bayes_threshold("gain", cost))
    return joined.crossJoin(F.broadcast(t.select("gain", "threshold"))).groupBy(
        "gain", "threshold"
    ).agg(*[a.alias(n) for n, a in _beyond(C("mean") >= C("threshold")).items()])


def _suffix(df: DataFrame, axes: Sequence[tuple[str, str]], sums: Sequence[str]) -> DataFrame:
    """Per point of the threshold grid, the sums of all bins beyond it.

    ``axes``: (bin column, index column); a row in bin b passes points 0..b-1.
    The input has one row per bin, a few dozen at most.
    """
    for b, i in axes:
        df = df.filter(C(b) > 0).withColumn(
            i, F.explode(F.sequence(F.lit(0), C(b) - 1))
        )
    return df.groupBy(*[i for _, i in axes]).agg(*[F.sum(s).alias(s) for s in sums])


def _bin(value: str, cuts: Column, strict: bool = True) -> Column:
    if strict:
        return F.size(F.filter(cuts, lambda t: C(value) > t))
    return F.size(F.filter(cuts, lambda t: C(value) >= t))


def calibrate_quantile(
    joined: DataFrame, cost: float, probs: Sequence[float] = GAIN_QUANTILES, floor: float = 1e-5
) -> DataFrame:
    """First quantile of the prediction whose mean outcome is twice the cost,
    else the one with the best mean outcome (the lower of equals)."""
    probs = sorted(probs)
    joined = materialize(joined.select("mean", "actual"))
    q = quantiles(joined, [], "mean", probs)
    cuts = q.agg(
        F.array_sort(
            F.collect_list(F.greatest(C("quantile"), F.lit(floor)))
        ).alias("_cuts")
    )
    binned = (
        joined.select("mean", "actual")
        .crossJoin(F.broadcast(cuts))
        .withColumn("_bin", _bin("mean", C("_cuts"), strict=False))
        .groupBy("_bin")
        .agg(
            F.count("*").alias("n_signals"),
            F.sum("actual").alias("_sum"),
            F.count_if(C("actual") > 0).alias("_win"),
        )
    )
    table = (
        _suffix(binned, [("_bin", "_i")], ["n_signals", "_sum", "_win"])
        .crossJoin(F.broadcast(cuts))
        .select(
            C("_i").alias("step"),
            F.get(C("_cuts"), C("_i")).alias("threshold"),
            "n_signals",
            (C("_sum") / C("n_signals")).alias("avg_actual"),
            (C("_win") / C("n_signals")).alias("win_rate"),
        )
    )
    good = F.when(C("avg_actual") >= 2.0 * cost, C("step"))
    w = Window.partitionBy(F.lit(0))
    first = F.min(good).over(w)
    best = F.max_by("step", F.struct("avg_actual", -C("step"))).over(w)
    return table.withColumn("_pick", F.coalesce(first, best)).filter(
        C("step") == C("_pick")
    ).drop("_pick", "step")


def topk_threshold(
    predictions: DataFrame, k_pct: float, group: Sequence[str] = ("horizon",), score: str = "mean"
) -> DataFrame:
    """Threshold that about ``k_pct`` percent of the scores exceed."""
    if not 0.0 < k_pct < 100.0:
        raise ValueError(f"k_pct must be in (0, 100), got {k_pct}")
    return quantiles(predictions, group, score, [1.0 - k_pct / 100.0]).select(
        *group, "n", C("quantile").alias("threshold")
    )


def max_pnl_threshold(
    joined: DataFrame,
    sweep: Sequence[float] = PNL_SWEEP,
    cost: float = 0.001,
    min_trades: int = 100,
    group: Sequence[str] = (),
) -> DataFrame:
    """The sweep table with the chosen threshold flagged, per group.

    ``actual`` already holds costs; the cost is subtracted once more, as the
    reported results were made.
    """
    sweep = sorted(float(t) for t in sweep)
    cuts = F.array(*[F.lit(t) for t in sweep])
    binned = joined.groupBy(*group, _bin("mean", cuts).alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum("actual").alias("_s")
    )
    # every threshold appears, also those nothing passes
    sums = (
        binned.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(sweep) - 1))))
        .groupBy(*group, "_i")
        .agg(
            F.sum(F.when(C("_bin") > C("_i"), C("_n")).otherwise(0)).alias("n_trades"),
            F.sum(F.when(C("_bin") > C("_i"), C("_s"))).alias("_s"),
        )
    )
    enough = C("n_trades") >= max(min_trades, 1)
    table = sums.select(
        *group,
        C("_i").alias("step"),
        F.get(cuts, C("_i")).alias("threshold"),
        "n_trades",
        F.when(enough, C("_s") / C("n_trades") - cost).alias("mean_pnl"),
    )
    w = Window.partitionBy(*(group or [F.lit(0)]))
    best = F.coalesce(
        F.max_by(
            "step", F.when(C("mean_pnl").isNotNull(), F.struct("mean_pnl", -C("step")))
        ).over(w),
        F.lit(0),
    )
    return table.withColumn("chosen", C("step") == best).drop("step")


def join_primary_meta(
    primary: DataFrame, meta: DataFrame, actuals: DataFrame, horizon: int
) -> DataFrame:
    at = C("horizon") == horizon
    p = primary.filter(at).select(*KEY3, C("mean").alias("primary"))
    m = meta.filter(at).select(*KEY3, C("mean").alias("meta"))
    a = actuals.filter(at).select(*KEY3, C("actual").alias("lr"))
    return p.join(m, KEY3).join(a, KEY3)


def joint_threshold_grid(
    merged: DataFrame,
    *,
    primary_thresholds: Sequence[float] = PRIMARY_THRESHOLDS,
    primary_percentiles: Sequence[float] | None = None,
    meta_percentiles: Sequence[float] = META_PERCENTILES,
    cost: float = 0.001,
    min_trades: int = 50,
) -> DataFrame:
    """Grid of primary and meta thresholds with the chosen pair flagged.

    Percentiles are "top x percent" of the merged rows.  Chosen: best mean
    profit among pairs with enough trades, else best of any; the earlier pair
    of equals in grid order.
    """

    merged = materialize(merged.select("primary", "meta", "lr"))

    def tops(col: str, pcts: Sequence[float]) -> DataFrame:
        levels = [1.0 - p / 100.0 for p in pcts]
        q = quantiles(merged, [], col, sorted(set(levels)))
        by_level = {p: lvl for p, lvl in zip(pcts, levels)}
        return q.agg(
            F.array(
                *[F.max(F.when(C("q") == by_level[p], C("quantile"))) for p in pcts]
            ).alias(f"_{col}_cuts")
        )

    meta_cuts = tops("meta", meta_percentiles)
    rows = merged.select("primary", "meta", "lr").crossJoin(F.broadcast(meta_cuts))
    if primary_percentiles is not None:
        pcts = [float(p) for p in primary_percentiles]
        cuts = meta_cuts.crossJoin(F.broadcast(tops("primary", pcts)))
        rows = merged.select("primary", "meta", "lr").crossJoin(F.broadcast(cuts))
    else:
        pcts = [None] * len(primary_thresholds)
        fixed = F.array(*[F.lit(float(t)) for t in primary_thresholds])
        cuts = meta_cuts.withColumn("_primary_cuts", fixed)
        rows = rows.withColumn("_primary_cuts", fixed)

    # bins count passed thresholds from the loosest; grid positions are mapped
    # back through the order of each axis
    def order(c: str) -> Column:
        return F.array_sort(C(c))

    binned = (
        rows.withColumn("_pb", _bin("primary", order("_primary_cuts")))
        .withColumn("_mb", _bin("meta", order("_meta_cuts")))
        .groupBy("_pb", "_mb")
        .agg(F.count("*").alias("n"), F.sum("lr").alias("s"))
    )
    n_p = len(primary_percentiles) if primary_percentiles is not None else len(primary_thresholds)
    points = cuts.select(
        "_primary_cuts",
        "_meta_cuts",
        F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))).alias("_p"),
    ).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(meta_percentiles) - 1))).alias("_m")
    ).select(
        "_p",
        "_m",
        F.get("_primary_cuts", C("_p")).alias("t_primary"),
        F.get("_meta_cuts", C("_m")).alias("t_meta"),
        F.size(F.filter(C("_primary_cuts"), lambda t: t < F.get("_primary_cuts", C("_p")))).alias("_pi"),
        F.size(F.filter(C("_meta_cuts"), lambda t: t < F.get("_meta_cuts", C("_m")))).alias("_mi"),
    )
    sums = (
        F.broadcast(binned)
        .join(points, (C("_pb") > C("_pi")) & (C("_mb") > C("_mi")), "right")
        .groupBy("_p", "_m", "t_primary", "t_meta")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_trades"), F.sum("s").alias("_s"))
    )
    pct_names = F.array(*[F.lit(p).cast("double") for p in pcts])
    meta_names = F.array(*[F.lit(float(p)) for p in meta_percentiles])
    step = C("_p") * len(meta_percentiles) + C("_m")
    table = sums.select(
        step.alias("step"),
        F.get(pct_names, C("_p")).alias("primary_pct"),
        F.get(meta_names, C("_m")).alias("meta_pct"),
        "t_primary",
        "t_meta",
        "n_trades",
        (C("_s") / C("n_trades") - cost).alias("mean_pnl"),
    )
    w = Window.partitionBy(F.lit(0))
    rank = F.struct("mean_pnl", -C("step"))
    known = C("mean_pnl").isNotNull()
    chosen = F.coalesce(
        F.max_by("step", F.when(known & (C("n_trades") >= min_trades), rank)).over(w),
        F.max_by("step", F.when(known, rank)).over(w),
    )
    return table.withColumn("chosen", F.coalesce(C("step") == chosen, F.lit(False))).drop("step")


# --------------------------------------------------------------------------
# split-conformal
# --------------------------------------------------------------------------

FALLBACK_QUANTILE = 0.5


def conformal_threshold(
    joined: DataFrame, alpha: float = 0.1, *, directional: bool = False,
    group: Sequence[str] = (),
) -> DataFrame:
    """Conformal quantile and probability threshold per group.

    Two-sided: scores ``|p - y|``, threshold ``max(q, 1-q)``.  Directional:
    scores ``1 - p`` of the positives, threshold ``1 - q`` within [0, 1].
    Without scores both are 0.5.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must be in (0, 1), got {alpha}")
    src = joined.filter(C("actual") >= 0.5) if directional else joined
    score = 1.0 - C("mean") if directional else F.abs(C("mean") - C("actual"))
    scored = src.withColumn("_score", score)
    level = F.array(F.least(F.lit(1.0), (1.0 - alpha) * (1.0 + 1.0 / C("n"))))
    q = quantiles(scored, group, "_score", level)
    if not group:
        none = joined.sparkSession.range(1).select(F.lit(0).alias("_one"))
        q = none.join(q.withColumn("_one", F.lit(0)), "_one", "left").drop("_one")
    qv = F.coalesce(C("quantile"), F.lit(FALLBACK_QUANTILE))
    t = clip(1.0 - qv, 0.0, 1.0) if directional else F.greatest(qv, 1.0 - qv)
    return q.select(
        *group,
        qv.alias("quantile"),
        t.alias("threshold"),
        F.coalesce(C("n"), F.lit(0)).cast("bigint").alias("n_calibration"),
    )


def conformal_two_sided(joined: DataFrame, alpha: float = 0.1, **kw) -> DataFrame:
    return conformal_threshold(joined, alpha, directional=False, **kw)


def conformal_directional(joined: DataFrame, alpha: float = 0.1, **kw) -> DataFrame:
    return conformal_threshold(joined, alpha, directional=True, **kw)

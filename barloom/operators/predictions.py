"""The long prediction table and its evaluation.

Predictions are (ts, ticker, horizon, mean, std); actuals add ``actual``.  A
horizon holds a large share of all rows, so everything here is either a
combinable aggregate or goes through ``ranks``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, logistic
from barloom.operators.blocks import IDX, index_rows
from barloom.operators.ranks import average_ranks, quantiles, value_positions
from barloom.session import materialize

C = F.col
KEY3 = ["ts", "ticker", "horizon"]
PROB_EPS = 1e-7


def with_actuals(predictions: DataFrame, actuals: DataFrame, how: str = "inner") -> DataFrame:
    return predictions.join(actuals.select(*KEY3, "actual"), KEY3, how)


def predictions_long(
    df: DataFrame, horizons: Sequence[int], mean: str = "mean", std: str = "std"
) -> DataFrame:
    """Arrays with one entry per horizon to long rows; a wrong length is an error."""
    n = len(horizons)
    right = (F.size(mean) == n) & (F.size(std) == n)
    wrong = F.raise_error(F.lit(f"expected {n} horizons per row")).cast(
        "array<struct<mean:double,std:double>>"
    )
    zipped = F.when(
        right, F.arrays_zip(C(mean).alias("mean"), C(std).alias("std"))
    ).otherwise(wrong)
    names = F.array(*[F.lit(int(h)) for h in horizons])
    return df.select("ts", "ticker", F.posexplode(zipped).alias("_i", "_m")).select(
        "ts", "ticker", F.get(names, C("_i")).alias("horizon"),
        C("_m.mean").cast("double").alias("mean"), C("_m.std").cast("double").alias("std"),
    )


def ensemble_moments(members: DataFrame, value: str = "mean") -> DataFrame:
    """Mean and population deviation across ensemble members.

    Members of a key mostly come from different tasks, so plain values travel: partial moments are wider.
    """
    return members.select(*KEY3, value).repartition(*KEY3).groupBy(*KEY3).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def sample_moments(passes: DataFrame, logit: str = "logit", sample: bool = False) -> DataFrame:
    """Moments of the probabilities over stochastic passes (population) or over
    trained members (``sample``); logits are turned into probabilities first."""
    p = logistic(logit)
    spread = F.stddev_samp(p) if sample else F.stddev_pop(p)
    return passes.groupBy(*KEY3).agg(F.avg(p).alias("mean"), spread.alias("std"))


def primary_wide_join(df: DataFrame, primary: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Left-join the primary probabilities as ``primary_h*`` columns."""
    wide = primary.groupBy("ts", "ticker").agg(
        *[F.avg(F.when(C("horizon") == h, C("mean"))).alias(f"primary_h{h}") for h in horizons]
    )
    return df.join(wide, ["ts", "ticker"], "left")


def _positive(actual: str = "actual") -> Column:
    return (C(actual) >= 0.5).cast("int")


def auc(
    df: DataFrame, group: Sequence[str] = ("horizon",), score: str = "mean", actual: str = "actual"
) -> DataFrame:
    """Exact area under the ROC curve by rank sums; null with a single class."""
    keys = list(group)
    pos = value_positions(df, keys, score, extra={"_p": F.sum(_positive(actual))})
    stats = pos.groupBy(*keys).agg(
        F.sum("_p").alias("n_pos"),
        F.sum(C("cnt") - C("_p")).alias("n_neg"),
        F.sum(C("_p") * (C("below") + (C("cnt") + 1) / 2.0)).alias("_ranks"),
    )
    wins = C("_ranks") - C("n_pos") * (C("n_pos") + 1) / 2.0
    pairs = F.nullif(C("n_pos").cast("double") * C("n_neg"), F.lit(0.0))
    return stats.select(*keys, "n_pos", "n_neg", (wins / pairs).alias("auc"))


def _nll(p: Column, y: Column) -> Column:
    p = clip(p, PROB_EPS, 1.0 - PROB_EPS)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def log_loss(
    df: DataFrame, group: Sequence[str] = ("horizon",), prior: str | None = None,
    score: str = "mean", actual: str = "actual",
) -> DataFrame:
    """Log-loss, the loss of predicting the prior, and the lift over it.

    The prior is a column (such as the training share) or the observed share.
    """
    keys = list(group)
    y = _positive(actual)
    stats = df.filter(C(score).isNotNull() & C(actual).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(_nll(C(score), y)).alias("logloss"),
        F.avg(y).alias("_share"),
        (F.max(prior) if prior else F.avg(y)).alias("prior"),
    )
    p = clip("prior", PROB_EPS, 1.0 - PROB_EPS)
    base = -(C("_share") * F.log(p) + (1 - C("_share")) * F.log(1 - p))
    return stats.withColumn("logloss_baseline", base).withColumn(
        "lift", C("logloss_baseline") - C("logloss")
    ).drop("_share")


SHUFFLED = 16_384  #: positions of a block, and of a bucket of a shuffle on average
COPIES = 1_000_000  #: copies that a task sorts, on average


# Fixed rule: shuffle k puts rows in the order of md5("k:i") of their positions i.


def permutation_null(
    df: DataFrame, n_shuffles: int = 20, *, group: str = "horizon",
    score: str = "mean", actual: str = "actual",
) -> DataFrame:
    """Log-loss against its distribution under shuffled labels.

    Only positive labels move probability mass: the loss of a shuffle is a sum
    of log-odds over the places its positives land on, one equality join for all
    shuffles.
    """
    known = df.filter(C(score).isNotNull() & C(actual).isNotNull())
    idx = index_rows(known, (group,), ["ts", "ticker"], bucket=C("ts"))
    p = clip(score, PROB_EPS, 1.0 - PROB_EPS)
    rows = materialize(
        idx.select(
            group, IDX, _positive(actual).alias("_y"),
            F.log(p / (1 - p)).alias("_odds"), F.log(1 - p).alias("_base"),
        )
    )
    totals = rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum("_base").alias("_b"),
        F.sum(C("_y") * C("_odds")).alias("_o"),
    )
    real = totals.withColumn("loss_real", -(C("_o") + C("_b")) / C("n"))
    # each shuffle has a hash order of its own; the row at a place of the order lends its label to the
    # row of that position. First bits of the hash deal the order out, so no task sorts a whole shuffle. A copy
    # travels once, as its position and label; its hash is made again where it is sorted.
    most, n_rows = rows.groupBy(group).count().agg(F.max("count"), F.sum("count")).first()
    buckets = max(1, -(-(most or 0) // SHUFFLED))
    # copies are small once compressed: tasks are cut by their number, since each of them is hashed and sorted
    tasks = max(1, -(-(n_rows or 0) * n_shuffles // COPIES))

    def md5(shuffle: Column, idx: Column) -> Column:
        return F.md5(F.concat_ws(":", shuffle, idx))

    first = F.conv(F.substring(md5(C("shuffle"), C(IDX)), 1, 8), 16, 10).cast("bigint")
    copies = rows.select(group, IDX, "_y", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))).alias("shuffle"))
    dealt = copies.select(
        group, (C("shuffle") * buckets + F.shiftright(first * buckets, 32)).alias("_bkt"),
        (2 * C(IDX) + C("_y")).cast("bigint").alias("_copy"),
    ).repartition(tasks, group, "_bkt")
    shuffle = F.floor(C("_bkt") / buckets).cast("int")
    hashed = F.unhex(md5(shuffle, F.shiftright("_copy", 1)))
    place = F.row_number().over(Window.partitionBy(group, "_bkt").orderBy("_h"))
    placed = dealt.withColumn("_h", hashed).withColumn("_place", place - 1)
    # a bucket holds places in a row: one record of it has those of the positive labels
    lent = materialize(
        placed.groupBy(group, "_bkt").agg(
            F.count("*").alias("_n"), F.collect_list(F.when(C("_copy") % 2 == 1, C("_place"))).alias("_places")
        )
    ).withColumn("shuffle", shuffle)
    earlier = Window.partitionBy(group, "shuffle").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    starts = lent.select(group, "_bkt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    block = F.explode(F.sequence(F.floor(C("_start") / SHUFFLED), F.floor((C("_start") + C("_n") - 1) / SHUFFLED)))
    # what a bucket lends to a block of positions meets the block's odds as one row
    parts = lent.join(F.broadcast(starts), [group, "_bkt"]).select("*", block.alias("_blk"))
    low = C("_blk") * SHUFFLED - C("_start")
    inside = F.filter("_places", lambda x: (x >= low) & (x < low + SHUFFLED))
    parts = parts.select(group, "shuffle", "_blk", F.transform(inside, lambda x: (x - low).cast("int")).alias("_at"))
    odds = rows.groupBy(group, F.floor(C(IDX) / SHUFFLED).alias("_blk")).agg(
        F.array_sort(F.collect_list(F.struct(IDX, "_odds")))["_odds"].alias("_odds")
    )
    shuffled = (
        parts.join(odds, [group, "_blk"])
        .select(group, "shuffle", "_odds", F.explode("_at").alias("_at"))
        .groupBy(group, "shuffle")
        .agg(F.sum(F.get("_odds", C("_at"))).alias("_s"))
        .join(real, group)
        .withColumn("_null", -(C("_s") + C("_b")) / C("n"))
    )
    return shuffled.groupBy(group).agg(
        F.max("n").alias("n"),
        F.max("loss_real").alias("loss_real"),
        F.avg("_null").alias("loss_null_mean"),
        F.stddev_pop("_null").alias("loss_null_std"),
        F.min("_null").alias("loss_null_min"),
        (
            (1 + F.count_if(C("_null") <= C("loss_real"))) / F.lit(1.0 + n_shuffles)
        ).alias("p_value"),
    )


def prediction_quantiles(
    predictions: DataFrame, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.99),
    cuts: Sequence[float] = (0.5, 0.6),
) -> DataFrame:
    """Shape of the predicted probabilities per horizon."""
    q = quantiles(predictions, ["horizon"], "mean", probs).groupBy("horizon").agg(
        *[
            F.max(F.when(C("q") == float(p), C("quantile"))).alias(f"p{round(p * 100)}")
            for p in probs
        ]
    )
    stats = predictions.groupBy("horizon").agg(
        F.count("*").alias("n"),
        F.avg("mean").alias("mean_p"),
        F.max("mean").alias("max_p"),
        F.avg("std").alias("mean_std"),
        F.max("std").alias("max_std"),
        *[
            c
            for t in cuts
            for c in (
                F.count_if(C("mean") > t).alias(f"n_above_{round(t * 100)}"),
                F.avg((C("mean") > t).cast("int")).alias(f"share_above_{round(t * 100)}"),
            )
        ],
    )
    return stats.join(q, "horizon")


def prior_bias(joined: DataFrame) -> DataFrame:
    """Mean prediction minus the realised share of positives."""
    return joined.groupBy("horizon").agg(
        F.avg(_positive()).alias("p_up"), F.avg("mean").alias("mean_p")
    ).withColumn("bias", C("mean_p") - C("p_up"))


def acceptance_checks(
    predictions: DataFrame, alphas: DataFrame | None = None, *,
    min_range: float = 0.15, min_std: float = 0.02, alpha_range: tuple[float, float] = (0.05, 0.45),
) -> DataFrame:
    """Collapse checks per horizon; ``alphas``: a level (horizon, alpha) to check as well."""
    out = predictions.groupBy("horizon").agg(
        (F.max("mean") - F.min("mean")).alias("range"), F.avg("std").alias("mean_std")
    ).withColumns(
        {"range_ok": C("range") >= min_range, "std_ok": C("mean_std") >= min_std}
    )
    if alphas is None:
        return out
    lo, hi = alpha_range
    return out.join(alphas.select("horizon", "alpha"), "horizon", "left").withColumn(
        "alpha_ok", C("alpha").between(lo, hi)
    )


def rank_ic(
    joined: DataFrame, group: Sequence[str] = ("horizon",), bound: float = 0.3
) -> DataFrame:
    """Spearman correlation of prediction and outcome, raw and clipped."""
    if not 0.0 < bound <= 1.0:
        raise ValueError(f"the clip of a correlation lies in (0, 1], not at {bound}")
    keys = list(group)
    both = materialize(
        joined.filter(C("mean").isNotNull() & C("actual").isNotNull()).select(
            *keys, "mean", "actual"
        )
    )
    ranked = average_ranks(average_ranks(both, keys, "mean", "_rp"), keys, "actual", "_ra")
    return ranked.groupBy(*keys).agg(F.corr("_rp", "_ra").alias("rank_ic")).withColumn(
        "rank_ic_clipped", clip("rank_ic", -bound, bound)
    )


def signal_sharpe(joined: DataFrame, cost: float = 0.0) -> DataFrame:
    """Sharpe of betting ``2p - 1`` on the log-return, cost by bet size."""
    bet = 2.0 * C("mean") - 1.0
    pnl = bet * C("actual") - cost * F.abs(bet)
    return joined.groupBy("horizon").agg(
        F.avg(pnl).alias("mean_pnl"), F.stddev_pop(pnl).alias("std_pnl")
    ).withColumn("sharpe", C("mean_pnl") / F.greatest(C("std_pnl"), F.lit(1e-9)))


def horizon_monotonicity(predictions: DataFrame) -> DataFrame:
    """Mean squared fall of the probability from one horizon to the next."""
    w = Window.partitionBy("ts", "ticker").orderBy("horizon")
    fall = F.greatest(F.lit(0.0), F.lag("mean").over(w) - C("mean"))
    had = F.lag("mean").over(w).isNotNull()
    return (
        predictions.withColumn("_v", F.when(had, fall * fall))
        .agg(F.count("_v").alias("n_pairs"), F.avg("_v").alias("penalty"))
    )

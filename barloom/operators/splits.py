"""Chronological splits, purging, scaling, folds, windows, class statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import clip, full_window
from barloom.operators.blocks import IDX, HaloBlocks, index_rows, over_blocks
from barloom.operators.ranks import quantiles

C = F.col


def time_index(df: DataFrame, ts: str = "ts", name: str = "bar") -> DataFrame:
    """Distinct times with their 0-based order: the shared bar axis of all series."""
    return index_rows(df.select(ts).distinct(), (), ts, name=name)


def cut_times(df: DataFrame, fractions: Sequence[float], ts: str = "ts") -> DataFrame:
    """One row: number of times ``n`` and the first time of each later part."""
    times = time_index(df, ts)
    n = times.agg(F.count("*").alias("n"))
    at = times.crossJoin(F.broadcast(n))
    return at.agg(
        F.max("n").alias("n"),
        *[
            F.min(F.when(C("bar") >= F.floor(C("n") * f), C(ts))).alias(f"cut_{i}")
            for i, f in enumerate(fractions)
        ],
    )


def chrono_split(
    df: DataFrame, train: float = 0.70, val: float = 0.15, ts: str = "ts"
) -> DataFrame:
    """Add ``split`` by unique times, no shuffle of the rows themselves."""
    cuts = cut_times(df, (train, train + val), ts)
    enough = F.when(
        C("n") >= 3, F.lit(True)
    ).otherwise(F.raise_error(F.lit("Not enough timestamps for chronological split")).cast("boolean"))
    name = (
        F.when(enough & (C(ts) < C("cut_0")), "train")
        .when(C(ts) < C("cut_1"), "val")
        .otherwise("test")
    )
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", name).drop("n", "cut_0", "cut_1")


def purge_tail(
    df: DataFrame, k: int, *, splits: Sequence[str] = ("train", "val"),
    key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Drop the last ``k`` rows of each series in the named splits.

    A series with at most ``k`` rows vanishes from that split.
    """
    if k <= 0:
        return df
    part = F.when(C("split").isin(list(splits)), C("split"))
    left = index_rows(df, [*key, "split"], ts, from_end=True)
    return left.filter(part.isNull() | (C(IDX) >= k)).drop(IDX)


def scaler_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Parameters as a table (column, mean, std); population std, tiny -> 1."""
    stats = train.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), C(c).alias("p")) for c in cols])
    ).alias("r")
    return stats.select(rows).select(
        "r.column",
        C("r.p.mean").alias("mean"),
        F.when(C("r.p.std") <= 1e-12, F.lit(1.0)).otherwise(C("r.p.std")).alias("std"),
    )


def scaler_transform(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x - mean) / std`` from a stored parameter table (one row per column)."""
    wide = params.agg(
        *[
            F.max(F.when(C("column") == c, F.struct("mean", "std"))).alias(f"_p_{c}")
            for c in cols
        ]
    )
    return df.crossJoin(F.broadcast(wide)).withColumns(
        {c: (C(c) - C(f"_p_{c}.mean")) / C(f"_p_{c}.std") for c in cols}
    ).drop(*[f"_p_{c}" for c in cols])


def sliding_windows(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], window: int = 384, *,
    key: Sequence[str] = ("ticker",), ts: str = "ts", **blocks,
) -> DataFrame:
    """``x``: the last ``window`` rows x features, ``y``: the targets of the last row.

    Windows with a missing feature and rows with a missing target drop out.
    The result is ``window`` times its input; build it where it is consumed.
    """
    known = F.lit(True)
    for f in features:
        known = known & C(f).isNotNull()

    def build(d: DataFrame, b: HaloBlocks) -> DataFrame:
        w = b.last(window)
        d = d.withColumn(
            "_row", F.when(known, F.array(*[C(f).cast("float") for f in features]))
        )
        return d.withColumn("x", full_window(F.collect_list("_row"), "_row", w, window))

    out = over_blocks(df, build, back=window, key=key, ts=ts, **blocks)
    y = F.array(*[C(t).cast("float") for t in targets])
    return (
        out.dropna(subset=list(targets))
        .filter(C("x").isNotNull())
        .select(*key, ts, "x", y.alias("y"))
    )


def class_priors(
    df: DataFrame, horizons: Sequence[int], by: Sequence[str] = ("split",), prefix: str = "target_h"
) -> DataFrame:
    """Share of positives per split and horizon, missing targets left out."""
    flat = df.select(
        *by,
        F.explode(
            F.array(
                *[F.struct(F.lit(h).alias("horizon"), C(f"{prefix}{h}").alias("y")) for h in horizons]
            )
        ).alias("_p"),
    ).select(*by, "_p.horizon", "_p.y").filter(C("y").isNotNull())
    return flat.groupBy(*by, "horizon").agg(
        F.count("*").alias("n"), F.avg((C("y") >= 0.5).cast("double")).alias("p_up")
    )


def class_weights(actuals: DataFrame, beta: float = 0.999, actual: str = "actual") -> DataFrame:
    """Effective-number class weights per horizon and the plain odds ratio.

    Weights are scaled to sum to 2; ``pos_weight`` is their ratio and
    ``pos_weight_plain`` is ``(1 - p) / p`` with p kept in [0.05, 0.95].
    """
    if not 0.0 < beta < 1.0:
        raise ValueError(f"beta must be in (0, 1), got {beta}")
    counts = actuals.filter(C(actual).isNotNull()).groupBy("horizon").agg(
        F.count_if(C(actual) >= 0.5).alias("n_pos"),
        F.count_if(C(actual) < 0.5).alias("n_neg"),
        F.avg(actual).alias("_p"),
    )

    def raw(n: str) -> Column:
        effective = 1.0 - F.pow(F.lit(beta), F.greatest(C(n), F.lit(1)).cast("double"))
        return (1.0 - beta) / F.greatest(effective, F.lit(1e-12))

    total = raw("n_pos") + raw("n_neg")
    p = clip("_p", 0.05, 0.95)
    return counts.select(
        "horizon",
        "n_pos",
        "n_neg",
        (2.0 * raw("n_pos") / total).alias("w_pos"),
        (2.0 * raw("n_neg") / total).alias("w_neg"),
        (raw("n_pos") / raw("n_neg")).alias("pos_weight"),
        ((1.0 - p) / p).alias("pos_weight_plain"),
    )


def robust_scale(
    df: DataFrame, value: str, group: Sequence[str] = ("horizon",), floor: float = 1e-4
) -> DataFrame:
    """Twice the exact median of absolute values, at least ``floor``."""
    q = quantiles(df.withColumn("_abs", F.abs(C(value))), group, "_abs", [0.5])
    return q.select(
        *group, F.greatest(2.0 * C("quantile"), F.lit(floor)).alias("robust_scale")
    )


def forward_folds(
    df: DataFrame, n_splits: int = 5, *, order: Sequence[str] = ("ts", "ticker"), ts: str = "ts"
) -> DataFrame:
    """Add ``fold``: null for the first block, then the fold that tests the row.

    Blocks are equal by row position in ``order``; fold k is trained on all rows
    before its block.  The remainder of the division goes to the first block.
    """
    idx = index_rows(df, (), list(order), bucket=C(ts))
    n = idx.agg(F.count("*").alias("_n"))
    size = F.floor(C("_n") / (n_splits + 1))
    first = C("_n") - n_splits * size
    return (
        idx.crossJoin(F.broadcast(n))
        .withColumn(
            "fold", F.when(C(IDX) >= first, F.floor((C(IDX) - first) / size).cast("int"))
        )
        .drop(IDX, "_n")
    )

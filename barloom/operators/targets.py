"""Forward-looking targets and their long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import flag, zero_to_null
from barloom.operators.blocks import HaloBlocks, over_blocks

C = F.col
HORIZONS = (6, 12, 24, 48)
PRICE_FLOOR = 1e-8


def norm_log_return(
    bars: DataFrame, horizons: Sequence[int] = HORIZONS, *,
    key: Sequence[str] = ("ticker",), ts: str = "ts", **blocks,
) -> DataFrame:
    """``(ln close[t+h] - ln close[t]) / h`` by row position inside the series."""

    def build(df: DataFrame, b: HaloBlocks) -> DataFrame:
        now = F.log(zero_to_null("close"))
        return df.withColumns(
            {
                f"target_h{h}": (F.log(zero_to_null(F.lead("close", h).over(b.window))) - now) / h
                for h in horizons
            }
        )

    return over_blocks(bars, build, back=0, ahead=max(horizons), key=key, ts=ts, **blocks)


def trade_log_return(entry: Column, exit_: Column, cost_in: float, cost_out: float, short: bool) -> Column:
    """Log-return of one round trip after costs, null when a price is missing."""
    floor = F.lit(PRICE_FLOOR)
    if short:
        ratio = F.greatest(entry * (1.0 - cost_in), floor) / F.greatest(
            exit_ * (1.0 + cost_out), floor
        )
    else:
        ratio = exit_ * (1.0 - cost_out) / F.greatest(entry * (1.0 + cost_in), floor)
    known = entry.isNotNull() & exit_.isNotNull()
    return F.when(known, F.log(F.greatest(ratio, floor)))


def smooth_label(label: Column, eps: float) -> Column:
    if not 0.0 <= eps < 0.5:
        raise ValueError(f"label_smoothing must be in [0, 0.5), got {eps}")
    return label * (1.0 - eps) + (1.0 - label) * eps if eps else label


def label_smoothing(df: DataFrame, eps: float, label: str = "label") -> DataFrame:
    return df.withColumn(label, smooth_label(C(label), eps))


def cost_labels(
    bars: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    *,
    entry_cost: float,
    exit_cost: float,
    label_smoothing: float = 0.0,
    direction: str = "long",
    key: Sequence[str] = ("ticker",),
    ts: str = "ts",
    **blocks,
) -> DataFrame:
    """``lr_h*``: entry at the next open, exit at ``close[t+h]``; ``target_h*``: lr > 0.

    Stored as float like the reported labels; the sign is taken before rounding.
    """
    if direction not in ("long", "short"):
        raise ValueError(f"direction must be 'long' or 'short', got {direction!r}")
    smooth_label(F.lit(0.0), label_smoothing)  # argument check

    def build(df: DataFrame, b: HaloBlocks) -> DataFrame:
        return df.withColumns(
            label_columns(
                b, horizons, entry_cost, exit_cost, label_smoothing, direction == "short"
            )
        )

    return over_blocks(bars, build, back=0, ahead=max(horizons), key=key, ts=ts, **blocks)


def label_columns(
    b: HaloBlocks, horizons: Sequence[int], cost_in: float, cost_out: float,
    smoothing: float = 0.0, short: bool = False,
) -> dict[str, Column]:
    """The label step on open blocks, for use inside a larger panel."""
    entry = F.lead("open", 1).over(b.window)
    out = {}
    for h in horizons:
        lr = trade_log_return(
            entry, F.lead("close", h).over(b.window), cost_in, cost_out, short
        ).cast("float")
        hard = F.when(lr.isNotNull(), (lr > 0).cast("double"))
        out[f"target_h{h}"] = smooth_label(hard, smoothing).cast("float")
        out[f"lr_h{h}"] = lr
    return out


def cost_labels_long(bars: DataFrame, horizons=HORIZONS, **kw) -> DataFrame:
    return cost_labels(bars, horizons, direction="long", **kw)


def cost_labels_short(bars: DataFrame, horizons=HORIZONS, **kw) -> DataFrame:
    return cost_labels(bars, horizons, direction="short", **kw)


def meta_target(
    df: DataFrame, horizons: Sequence[int], *, cost: float = 0.001, multiplier: float = 2.0
) -> DataFrame:
    """1 where the log-return beats ``multiplier`` times the cost, null stays null."""
    bound = multiplier * cost
    return df.withColumns(
        {
            f"meta_target_h{h}": F.when(
                C(f"lr_h{h}").isNotNull(), (C(f"lr_h{h}") > bound).cast("float")
            )
            for h in horizons
            if f"lr_h{h}" in df.columns
        }
    )


def targets_long(
    df: DataFrame, horizons: Sequence[int], prefix: str = "lr_h", *,
    key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Wide targets to (ts, key, horizon, actual); missing targets drop out."""
    have = [h for h in horizons if f"{prefix}{h}" in df.columns]
    pairs = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"), C(f"{prefix}{h}").cast("double").alias("actual")
            )
            for h in have
        ]
    )
    return (
        df.select(ts, *key, F.explode(pairs).alias("_p"))
        .select(ts, *key, "_p.horizon", "_p.actual")
        .filter(C("actual").isNotNull())
    )


def attach_targets(
    predictions: DataFrame, wide: DataFrame, horizons: Sequence[int], prefix: str = "lr_h", *,
    key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Long actuals of exactly the predicted keys."""
    long = targets_long(wide, horizons, prefix, key=key, ts=ts)
    return predictions.select(ts, *key, "horizon").join(long, [ts, *key, "horizon"])


def wide_targets(
    predictions: DataFrame, wide: DataFrame, horizons: Sequence[int], prefix: str = "lr_h", *,
    key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Targets of the predicted (ts, key), one column per horizon, 0 where unknown."""
    have = [f"{prefix}{h}" for h in horizons if f"{prefix}{h}" in wide.columns]
    filled = wide.select(ts, *key, *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(c) for c in have])
    return predictions.select(ts, *key).distinct().join(filled, [ts, *key])


def label_audit(
    labelled: DataFrame, horizon: int, *, entry_cost: float, exit_cost: float,
    tolerance: float = 1e-4, key: Sequence[str] = ("ticker",), ts: str = "ts",
) -> DataFrame:
    """Recompute every stored log-return by joins on bar position; count differences.

    An independent path: positions and equality joins instead of ``lead``.
    """
    from barloom.operators.blocks import IDX, index_rows

    idx = index_rows(labelled, key, ts)
    entry = idx.select(*key, (C(IDX) - 1).alias(IDX), C("open").alias("_entry"))
    exit_ = idx.select(*key, (C(IDX) - horizon).alias(IDX), C("close").alias("_exit"))
    stored = idx.select(*key, IDX, C(f"lr_h{horizon}").alias("_stored")).filter(
        C("_stored").isNotNull()
    )
    again = trade_log_return(C("_entry"), C("_exit"), entry_cost, exit_cost, False)
    diff = F.abs(again - C("_stored").cast("double"))
    return (
        stored.join(entry, [*key, IDX], "left")
        .join(exit_, [*key, IDX], "left")
        .agg(
            F.count("*").alias("n_rows"),
            F.coalesce(
                F.sum(1 - flag(diff <= tolerance)), F.lit(0)
            ).cast("bigint").alias("n_discrepancies"),
            F.max(diff).alias("max_diff"),
        )
    )


def tabular_rows(df: DataFrame, features: Sequence[str], horizon: int, *extra: str) -> DataFrame:
    """Model rows of one horizon: features where the target is known."""
    t = f"target_h{horizon}"
    return df.filter(C(t).isNotNull()).select(
        *extra, *features, (C(t) >= 0.5).cast("double").alias("label")
    )


def minority_rows(df: DataFrame, horizon: int, label: str = "target_h") -> DataFrame:
    """Rows of the rarer class of one horizon."""
    c = f"{label}{horizon}"
    rare = df.filter(C(c).isNotNull()).agg((F.avg((C(c) >= 0.5).cast("double")) <= 0.5).alias("_up"))
    return df.filter(C(c).isNotNull()).crossJoin(F.broadcast(rare)).filter(
        (C(c) >= 0.5) == C("_up")
    ).drop("_up")

"""Trading signals out of long predictions.

All generators take the best horizon per (ts, ticker) and let at most ``k``
tickers per time act.  Ties are fixed: higher mean, then shorter horizon, then
ticker name.  The top-k is taken with a rank limit that works before the
shuffle; the remaining rows are HOLD and only meet it in a join.
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
COLS = ["ts", "ticker", "horizon", "mean", "std", "action", "signal"]


def best_horizon(predictions: DataFrame) -> DataFrame:
    """The row of the highest mean per (ts, ticker), the shorter horizon of equals."""
    w = Window.partitionBy("ts", "ticker").orderBy(C("mean").desc(), C("horizon"))
    return (
        predictions.filter(C("mean").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .filter(C("_rn") == 1)
        .drop("_rn")
    )


def top_k(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best tickers of each time with their ``rank``."""
    w = Window.partitionBy("ts").orderBy(C("mean").desc(), C("ticker"))
    return best.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= k)


def act(best: DataFrame, k: int, qualifies: Column, gate: Column | None = None) -> DataFrame:
    """Mark BUY where a top-k row qualifies; ``gate`` may use ``top_mean``,
    the highest mean of the time."""
    best = materialize(best)
    top = top_k(best, k)
    if gate is not None:
        top = top.withColumn("top_mean", F.max("mean").over(Window.partitionBy("ts"))).filter(gate)
    buys = top.filter(qualifies).select("ts", "ticker", F.lit(1).alias("signal"))
    signal = F.coalesce(C("signal"), F.lit(0))
    return (
        best.drop("signal")
        .join(buys, ["ts", "ticker"], "left")
        .withColumn("signal", signal)
        .withColumn("action", F.when(C("signal") == 1, "BUY").otherwise("HOLD"))
        .select(*[c for c in best.columns if c not in ("signal", "action")], "action", "signal")
    )


def effective_threshold(
    base: float, n_horizons: Column | int, *, mode: str = "classification",
    correction: str = "sidak", factor: float = 1.5,
) -> Column:
    """Threshold corrected for taking the best of several horizons."""
    if mode not in ("regression", "classification"):
        raise ValueError(f"Unknown mode: {mode}")
    n = F.lit(n_horizons) if isinstance(n_horizons, int) else n_horizons
    b = F.lit(float(base))
    if mode == "regression":
        many = b * factor
    elif correction == "sidak":
        many = F.pow(b, 1.0 / n)
    elif correction == "bonferroni":
        many = 1.0 - F.greatest(1.0 - b, F.lit(0.0)) / n
    else:
        many = b
    return F.when(n <= 1, b).otherwise(many)


def two_stage_signals(
    predictions: DataFrame,
    *,
    mode: str = "classification",
    threshold: float | None = None,
    std_cap: float | None = None,
    max_positions: int = 5,
    correction: str = "sidak",
    factor: float = 1.5,
) -> DataFrame:
    """Gate per time, then top-k by mean with ``mean >= T`` and ``std <= cap``."""
    classify = mode == "classification"
    base = threshold if threshold is not None else (0.55 if classify else 0.0005)
    cap = std_cap if std_cap is not None else (0.25 if classify else 0.02)
    predictions = materialize(predictions.select(*KEY3, "mean", "std"))
    n_h = predictions.agg(F.countDistinct("horizon").alias("_n"))
    t = n_h.select(
        effective_threshold(base, C("_n"), mode=mode, correction=correction, factor=factor).alias("_t")
    )
    best = best_horizon(predictions).crossJoin(F.broadcast(t))
    gate = C("top_mean") > (C("_t") if classify else F.lit(0.0))
    ok = (C("mean") >= C("_t")) & (C("std") <= cap)
    return act(best, max_positions, ok, gate).drop("_t").select(*COLS)


def threshold_signals(
    predictions: DataFrame, threshold: float | DataFrame, *, horizon: int | None = None,
    max_positions: int = 5,
) -> DataFrame:
    """Best (or one fixed) horizon, top-k, BUY above ``threshold``.

    ``threshold`` may be a one-row frame with that column.
    """
    src = predictions if horizon is None else predictions.filter(C("horizon") == horizon)
    best = best_horizon(src)
    if isinstance(threshold, DataFrame):
        best = best.crossJoin(F.broadcast(threshold.select(C("threshold").alias("_t"))))
        return act(best, max_positions, C("mean") > C("_t")).drop("_t").select(*COLS)
    return act(best, max_positions, C("mean") > threshold).select(*COLS)


def conformal_signals(
    predictions: DataFrame, calibration: DataFrame, max_positions: int = 5
) -> DataFrame:
    return threshold_signals(predictions, calibration, max_positions=max_positions)


def primary_meta_filter(
    primary: DataFrame, meta: DataFrame, t_primary: float, t_meta: float | None
) -> DataFrame:
    """BUY iff the primary beats its threshold and, where there is one, the meta its own."""
    m = meta.select(*KEY3, C("mean").alias("meta"))
    buy = C("mean") > t_primary
    if t_meta is not None:
        buy = buy & (C("meta") > t_meta)
    return primary.join(m, KEY3).select(
        *KEY3, "mean", "meta", "std", F.when(buy, "BUY").otherwise("HOLD").alias("action")
    )


# --- consensus of a long and a short model ---------------------------------

def consensus_frame(long: DataFrame, short: DataFrame) -> DataFrame:
    """Best long horizon with the short model's view of the same key."""
    lo = best_horizon(long).select(*KEY3, C("mean").alias("p_long"), C("std").alias("p_long_std"))
    sh = short.select(*KEY3, C("mean").alias("p_short"), C("std").alias("p_short_std"))
    return lo.join(sh, KEY3)


def consensus_decisions(frame: DataFrame, t_long: float, t_short: float) -> DataFrame:
    for name, v in (("t_long", t_long), ("t_short", t_short)):
        if not 0.0 < v < 1.0:
            raise ValueError(f"{name} must be in (0, 1), got {v}")
    lo, sh = C("p_long") > t_long, C("p_short") > t_short
    return frame.withColumns(
        {"long_signal": lo, "short_signal": sh, "open_long": lo & ~sh, "close_long": sh & ~lo}
    )


def consensus_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("n_bars"),
        F.count_if("open_long").alias("n_open_long"),
        F.count_if("close_long").alias("n_close_long"),
        F.coalesce(F.avg(C("open_long").cast("double")), F.lit(0.0)).alias("frac_open_long"),
        F.coalesce(F.avg(C("close_long").cast("double")), F.lit(0.0)).alias("frac_close_long"),
        F.max("p_long").alias("p_long_max"),
        F.max("p_short").alias("p_short_max"),
        F.avg("p_long").alias("p_long_mean"),
        F.avg("p_short").alias("p_short_mean"),
    )


def kelly_size(
    signals: DataFrame,
    *,
    primary: str = "mean",
    meta: str | None = "meta",
    scale: float = 0.5,
    primary_floor: float = 0.50,
    meta_floor: float = 0.50,
    cap: float = 0.20,
) -> DataFrame:
    """Add ``size_fraction`` from the edges of primary and (if there) meta."""

    def edge(c: str, floor: float) -> Column:
        p = clip(C(c).cast("double"), 0.0, 1.0)
        return clip(p - floor, 0.0, 1.0) / max(1e-9, 1.0 - floor)

    raw = edge(primary, primary_floor)
    if meta is not None and meta in signals.columns:
        raw = raw * edge(meta, meta_floor)
    return signals.withColumn("size_fraction", clip(raw * scale, 0.0, cap).cast("float"))


def signal_funnel(
    predictions: DataFrame, signals: DataFrame, *, threshold: float, std_cap: float
) -> DataFrame:
    """How many best-horizon rows pass each stage, and the quantiles of both inputs."""
    best = materialize(best_horizon(predictions).select("mean", "std"))
    over, calm = C("mean") > threshold, C("std") <= std_cap
    n = F.count("*")
    stages = best.agg(
        n.alias("n_best"),
        F.count_if(over).alias("n_above"),
        F.count_if(calm).alias("n_calm"),
        F.count_if(over & calm).alias("n_both"),
        (F.count_if(over & calm) / n).alias("share_both"),
        F.max("mean").alias("mean_max"),
        F.max("std").alias("std_max"),
    )

    def wide(col: str, probs: Sequence[float]) -> DataFrame:
        return quantiles(best, [], col, probs).agg(
            *[
                F.max(F.when(C("q") == p, C("quantile"))).alias(f"{col}_p{round(100 * p)}")
                for p in probs
            ]
        )

    counts = predictions.agg(F.count("*").alias("n_predictions")).crossJoin(
        signals.agg(F.count_if(C("action") == "BUY").alias("n_buy"))
    )
    return (
        counts.crossJoin(stages)
        .crossJoin(wide("mean", (0.5, 0.9, 0.99)))
        .crossJoin(wide("std", (0.5, 0.9)))
    )


def buys_per_ticker(signals: DataFrame) -> DataFrame:
    return signals.filter(C("action") == "BUY").groupBy("ticker").agg(F.count("*").alias("n_buy"))


def alerts(
    predictions: DataFrame, *, min_return: float = 0.0005, max_std: float = 0.02,
    min_strength: float = 2.0,
) -> DataFrame:
    """Forecast per (ts, ticker) with the alert flag and its rank by expected return."""
    best = best_horizon(predictions)
    strength = F.when(C("std") > 1e-9, C("mean") / C("std")).otherwise(0.0)
    return best.select(
        "ts",
        "ticker",
        C("horizon").alias("best_horizon"),
        C("mean").alias("expected_return"),
        C("std").alias("uncertainty"),
        strength.alias("alert_strength"),
    ).withColumn(
        "alert",
        (C("expected_return") >= min_return)
        & (C("uncertainty") <= max_std)
        & (C("alert_strength") >= min_strength),
    ).withColumn(
        # the tickers of one time
        "rank", F.row_number().over(Window.partitionBy("ts").orderBy(C("expected_return").desc(), "ticker"))
    )


def forecast_band(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Price band of the best horizon: ``close * exp((mean +- std) * h)``."""
    best = best_horizon(predictions)
    joined = best.join(bars.select("ts", "ticker", "close"), ["ts", "ticker"])

    def at(x: Column) -> Column:
        return C("close") * F.exp(x * C("horizon"))

    return joined.select(
        *KEY3,
        "close",
        at(C("mean")).alias("pred_close"),
        at(C("mean") + C("std")).alias("upper_close"),
        at(C("mean") - C("std")).alias("lower_close"),
    )

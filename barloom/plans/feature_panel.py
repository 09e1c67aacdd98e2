"""The whole feature table and its model-ready split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators.asof import asof
from barloom.operators.bars import drop_null_rows, index_logret_on_grid
from barloom.operators.blocks import IDX, HaloBlocks, index_rows, over_blocks
from barloom.operators.splits import chrono_split, purge_tail, scaler_fit, scaler_transform
from barloom.operators.targets import HORIZONS, label_columns, norm_log_return
from barloom.session import materialize

NOT_FEATURES = ("ticker", "ts", "open", "high", "low")


@dataclass(frozen=True)
class FeatureFrame:
    frame: DataFrame
    features: list[str]


def feature_panel(
    bars: DataFrame,
    *,
    macro: DataFrame | None = None,
    indexes: DataFrame | None = None,
    metals: DataFrame | None = None,
    horizons: Sequence[int] = HORIZONS,
    mode: str = "classification",
    cost: float = 0.0005,
    label_smoothing: float = 0.0,
    swap_long_short: bool = False,
    dummies: bool = False,
    exchange: bool = True,
    **panel,
) -> FeatureFrame:
    """Indicators, macro values, index and metal returns, targets, dummies.

    ``macro`` has one filled row per date, ``indexes``/``metals`` one close
    column per code.  Close and volume count as features, the other prices not.
    ``dummies`` adds the sparse one-hot vector ``tid``.
    """
    bars = bars.select("ticker", "ts", "open", "high", "low", "close", "volume")
    # stored with their positions once: indicators, returns and targets cut blocks from the same rows
    bars = materialize(index_rows(bars, ("ticker",), "ts"))
    labels = horizons if mode == "classification" else ()

    def targets(df: DataFrame, b: HaloBlocks) -> DataFrame:
        return df.withColumns(
            label_columns(b, labels, cost, cost, label_smoothing, swap_long_short)
        )

    out = I.indicator_panel(bars, use_temporal=False, **panel).drop(IDX)
    out = I.cyclic_time(out, exchange=exchange)
    if macro is not None:
        cols = [c for c in macro.columns if c != "ts"]
        times = bars.select("ts").distinct()
        out = out.join(asof(times, macro, key=(), values=cols), "ts")
    for closes in (indexes, metals):
        if closes is not None:
            out = out.join(index_logret_on_grid(bars, closes).drop(IDX), ["ticker", "ts"])
    features = [c for c in out.columns if c not in NOT_FEATURES]
    if mode == "classification":
        made = over_blocks(bars, targets, back=0, ahead=max(horizons))
        keep = [c for h in horizons for c in (f"target_h{h}", f"lr_h{h}")]
    else:
        made = norm_log_return(bars, horizons)
        keep = [f"target_h{h}" for h in horizons]
    out = out.join(made.select("ticker", "ts", *keep), ["ticker", "ts"])
    if dummies:
        out = I.ticker_dummies(out)
    return FeatureFrame(out, features)


def model_dataset(panel: FeatureFrame, max_horizon: int) -> tuple[DataFrame, DataFrame]:
    """Complete rows, split by time, purged, scaled on train: (rows, scaler table)."""
    rows = materialize(
        purge_tail(chrono_split(drop_null_rows(panel.frame, panel.features)), max_horizon)
    )
    params = materialize(scaler_fit(rows.filter(F.col("split") == "train"), panel.features))
    return scaler_transform(rows, params, panel.features), params

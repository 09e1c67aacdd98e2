"""Daily positions of institutions (YUR) and individuals (FIZ)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import or_zero, zero_to_null
from barloom.operators.asof import asof
from barloom.operators.blocks import HaloBlocks, over_blocks
from barloom.session import materialize

# Participant groups, position columns and contract names.
GROUPS = ("YUR", "FIZ")
POSITIONS = ("pos", "pos_long", "pos_short", "pos_long_num", "pos_short_num")
FUTURES_TO_SPOT = {
    "SBERF": "SBER",
    "GAZPF": "GAZP",
    "USDRUBF": "USDRUB",
    "CNYRUBF": "CNYRUB",
    "IMOEXF": "IMOEX",
    "GLDRUBF": "GLDRUB",
    "EURRUBF": "EURRUB",
}
KEY = ("ticker",)


def positioning_daily_close(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Closing snapshot per (day, group): per column the last non-null of the day."""
    have = [p for p in POSITIONS if p in df.columns]
    day = F.to_date(F.col("tradedate"))
    return (
        df.withColumn("day", day)
        .filter(F.col("day").isNotNull())
        .groupBy(*key, "day", "clgroup")
        .agg(
            *[
                F.max_by(p, F.when(F.col(p).isNotNull(), F.col("tradetime"))).alias(p)
                for p in have
            ]
        )
    )


def positioning_pivot(daily: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per day, columns ``<position>_<group>``."""
    have = [p for p in POSITIONS if p in daily.columns]
    return daily.groupBy(*key, "day").agg(
        *[
            F.max(F.when(F.col("clgroup") == g, F.col(p))).alias(f"{p}_{g}")
            for p in have
            for g in GROUPS
        ]
    )


def _imbalance(long: str, short: str) -> Column:
    lo, sh = F.col(long).cast("double"), F.abs(F.col(short).cast("double"))
    return or_zero((lo - sh) / zero_to_null(lo + sh))


def positioning_features(panel: DataFrame, key: Sequence[str] = KEY, **blocks) -> DataFrame:
    """Net position, its 1- and 5-day changes and the long/short imbalance."""

    def build(df: DataFrame, b: HaloBlocks) -> DataFrame:
        out = {}
        for g in GROUPS:
            if f"pos_{g}" not in panel.columns:
                continue
            pos, name = F.col(f"pos_{g}").cast("double"), f"futoi_{g.lower()}"
            out[f"{name}_pos"] = pos
            for d in (1, 5):
                out[f"{name}_pos_d{d}"] = or_zero(pos - F.lag(pos, d).over(b.window))
            if {f"pos_long_{g}", f"pos_short_{g}"} <= set(panel.columns):
                out[f"{name}_imbalance"] = _imbalance(f"pos_long_{g}", f"pos_short_{g}")
        return df.withColumns(out)

    made = over_blocks(panel, build, back=5, key=key, ts="day", **blocks)
    return made.select(*key, "day", *[c for c in made.columns if c.startswith("futoi_")])


def smart_divergence(features: DataFrame) -> DataFrame:
    """Institutions minus individuals, where both sides are known."""
    out = {}
    for name, new in (("pos", "futoi_smart_divergence"), ("imbalance", "futoi_smart_imbalance_diff")):
        yur, fiz = f"futoi_yur_{name}", f"futoi_fiz_{name}"
        if {yur, fiz} <= set(features.columns):
            out[new] = F.col(yur) - F.col(fiz)
    return features.withColumns(out) if out else features


def build_positioning(df: DataFrame, key: Sequence[str] = KEY, **blocks) -> DataFrame:
    panel = materialize(positioning_pivot(positioning_daily_close(df, key), key))
    return smart_divergence(positioning_features(panel, key, **blocks))


def positioning_asof(
    features: DataFrame, bars: DataFrame, *, delay_days: int = 0,
    key: Sequence[str] = KEY, ts: str = "ts",
) -> DataFrame:
    """Daily features on bars, null -> 0.

    With ``delay_days=0`` a day's closing snapshot is visible from its midnight,
    as the reported results were made; 1 is leak-free.
    """
    cols = [c for c in features.columns if c.startswith("futoi_")]
    right = features.withColumn(
        ts, F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(delay_days))
    )
    right = materialize(right.select(*key, ts, *cols))
    joined = asof(bars.select(*key, ts), right, key=key, ts=ts, values=cols)
    return joined.select(*key, ts, *[or_zero(c).alias(c) for c in cols])


def futures_to_spot(
    df: DataFrame, contract: str = "secid", name: str = "spot", mapping: dict[str, str] | None = None
) -> DataFrame:
    """Spot ticker of a contract; contracts without one drop out."""
    pairs = mapping or FUTURES_TO_SPOT
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(name, lookup[F.col(contract)]).filter(F.col(name).isNotNull())

"""As-of alignment: the last (or next) right-hand row at each left-hand row.

No range join: both sides are stacked, and inside one time bucket a window
carries the last right row forward.  Buckets without a right row take it from
one summary row per bucket, so no task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import BKT, month_bucket


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    key: Sequence[str] = ("ticker",),
    ts: str = "ts",
    right_ts: str | None = None,
    values: Sequence[str],
    direction: str = "backward",
    bucket: Column | None = None,
) -> DataFrame:
    """Left rows plus ``values`` of the nearest right row at or before (after).

    The whole right row is carried, nulls included.  ``right`` must have one
    row per (key, time).
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be 'backward' or 'forward', got {direction!r}")
    back = direction == "backward"
    keys = list(key)
    bucket = month_bucket(ts) if bucket is None else bucket
    payload = F.struct(*[F.col(v) for v in values])
    facts = right.select(
        *keys, F.col(right_ts or ts).alias(ts), payload.alias("_val")
    ).withColumn(BKT, bucket)
    rest = [c for c in left.columns if c not in (*keys, ts)]
    rows = left.withColumn("_row", F.struct(*([F.col(c) for c in rest] or [F.lit(True)])))
    rows = rows.select(*keys, ts, "_row").withColumn(BKT, bucket)

    # one summary row per (series, bucket): the fact that leaves the bucket
    pick = F.max_by if back else F.min_by
    leaving = facts.groupBy(*keys, BKT).agg(pick("_val", ts).alias("_out"))
    present = rows.select(*keys, BKT).distinct().withColumn("_out", F.lit(None))
    summary = leaving.unionByName(
        present.withColumn("_out", F.col("_out").cast(leaving.schema["_out"].dataType))
    ).groupBy(*keys, BKT).agg(F.first("_out", ignorenulls=True).alias("_out"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BKT)
    if back:
        reach = F.last("_out", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        )
    else:
        reach = F.first("_out", ignorenulls=True).over(
            w.rowsBetween(1, Window.unboundedFollowing)
        )
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BKT).alias("_k_bkt"),
        reach.alias("_carry"),
    )

    stacked = rows.withColumn("_side", F.lit(1)).unionByName(
        facts.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    inside = Window.partitionBy(*keys, BKT)
    if back:
        local = F.last("_val", ignorenulls=True).over(
            inside.orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
        )
    else:
        local = F.last("_val", ignorenulls=True).over(
            inside.orderBy(F.col(ts).desc(), "_side").rowsBetween(
                Window.unboundedPreceding, 0
            )
        )
    cond = F.col(BKT) == F.col("_k_bkt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    joined = (
        stacked.withColumn("_local", local)
        .filter(F.col("_side") == 1)
        .select(*keys, ts, BKT, "_row", "_local")
        .join(carry, cond, "left")
        .withColumn("_hit", F.coalesce("_local", "_carry"))
    )
    back_to = [F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in left.columns]
    return joined.select(*back_to, *[F.col(f"_hit.{v}").alias(v) for v in values])


def forward_fill(
    df: DataFrame, cols: Sequence[str], *, key: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Per column, the last non-null value at or before each row (one row per ts)."""
    keys = list(key)
    rows = df.withColumn(BKT, month_bucket(ts))
    ends = rows.groupBy(*keys, BKT).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_e_{c}") for c in cols]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BKT).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BKT).alias("_k_bkt"),
        *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in cols],
    )
    cond = F.col(BKT) == F.col("_k_bkt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    here = Window.partitionBy(*keys, BKT).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumns(
            {f"_l_{c}": F.last(c, ignorenulls=True).over(here) for c in cols}
        )
        .join(carry, cond)
        .withColumns({c: F.coalesce(f"_l_{c}", f"_c_{c}") for c in cols})
        .select(*df.columns)
    )

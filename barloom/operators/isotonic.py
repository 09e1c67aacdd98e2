"""Isotonic calibration of scores: pool-adjacent-violators as a mergeable summary.

Equal scores are pooled first, by one aggregate. Sorted ranges of (key, score) are then pooled each in its
task into blocks of rising means. Pooling blocks of neighbouring ranges gives what pooling all their rows gives,
so the ranges are merged pairwise up a tree until no two neighbouring blocks violate the order; on
noisy labels the blocks of a range are few, and the tree mostly ends after a step or two. A key may lie in
any number of tasks at every step but the last, which holds what is left as blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.asof import asof
from barloom.session import materialize

#: Score buckets of the as-of alignment; a bucket is a task's share of one key at least.
BUCKETS = 4096
#: Steps that are broadcast; more are aligned by a shuffle of the rows.
STEPS_SENT = 1 << 18


def _pool(rows: Iterator[tuple]) -> list[list]:
    """Blocks [lo, hi, n, total] of rising means from sorted ones."""
    held: list[list] = []
    for lo, hi, n, total in rows:
        now = [lo, hi, n, total]
        while held and held[-1][3] * now[2] >= now[3] * held[-1][2]:
            before = held.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        held.append(now)
    return held


def _pool_ranges(blocks: DataFrame, key: str, parts: int) -> DataFrame:
    """Blocks pooled inside each of ``parts`` sorted ranges, with the range they lie in."""
    schema = f"{key} {blocks.schema[key].dataType.simpleString()}, lo double, hi double, n bigint, total double, part int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, now, held = TaskContext.get().partitionId(), None, []

        def out() -> pd.DataFrame:
            made = pd.DataFrame(held, columns=["lo", "hi", "n", "total"])
            made.insert(0, key, now)
            return made.assign(part=part)

        for b in batches:
            for k, rows in b.groupby(key, sort=False):
                if held and k != now:
                    yield out()
                    held = []
                now = k
                held = _pool([*held, *rows[["lo", "hi", "n", "total"]].itertuples(index=False)])
        if held:
            yield out()

    dealt = blocks.select(key, "lo", "hi", "n", "total").repartitionByRange(parts, key, "lo").sortWithinPartitions(key, "lo")
    return materialize(dealt.mapInPandas(run, schema))


def _violated(blocks: DataFrame, key: str) -> bool:
    """Whether two blocks that meet at the border of two ranges are out of order."""
    mean = F.col("total") / F.col("n")
    ends = blocks.groupBy(key, "part").agg(
        F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")
    )
    before = F.lag("last").over(Window.partitionBy(key).orderBy("lo"))
    return not ends.withColumn("before", before).filter("before >= first").isEmpty()


def isotonic_fit(
    joined: DataFrame, *, score: str = "mean", actual: str = "actual", key: str = "horizon",
    min_samples: int = 100, digits: int | None = None, parts: int | None = None,
) -> DataFrame:
    """Steps (key, lo, hi, value) of the isotonic regression of every key.

    Rows with a null key, score or label take no part; keys of fewer than ``min_samples`` rows or of one label only
    get no steps. ``digits`` rounds the scores first. ``parts`` is the number of ranges to start with.
    """
    x = _rounded(F.col(score), digits)
    rows = joined.select(key, x.alias("lo"), F.col(actual).cast("double").alias("y")).dropna()
    pooled = rows.groupBy(key, "lo").agg(
        F.count("*").alias("n"), F.sum("y").alias("total"), F.min("y").alias("low"), F.max("y").alias("high")
    )
    pooled = materialize(pooled)
    enough = pooled.groupBy(key).agg(F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    enough = enough.filter((F.col("rows") >= min_samples) & (F.col("low") < F.col("high"))).select(key)
    blocks = pooled.join(enough, key, "left_semi").withColumn("hi", F.col("lo"))
    parts = parts or int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _pool_ranges(blocks, key, parts)
    while parts > 1 and _violated(blocks, key):
        parts = (parts + 1) // 2
        blocks = _pool_ranges(blocks, key, parts)
    return blocks.select(key, "lo", "hi", (F.col("total") / F.col("n")).alias("value"))


def _rounded(x: Column, digits: int | None) -> Column:
    x = x.cast("double")
    return x if digits is None else F.rint(x * 10.0**digits) / 10.0**digits


def _by_halving(known: DataFrame, steps: DataFrame, key: str, most: int) -> DataFrame:
    """Rows with the step at or below (``_below``) and the next one (``_at``): the steps go to the rows, which stay where they are."""
    held = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "value"))).alias("_steps"))
    rows = known.join(F.broadcast(held), key, "left").withColumn("_sub", F.lit(0))
    for i in range(most.bit_length() - 1, -1, -1):
        passed = F.get("_steps", F.col("_sub") + (2**i - 1))["lo"] <= F.col("_x")
        rows = rows.withColumn("_sub", F.col("_sub") + F.when(passed, 2**i).otherwise(0))
    before = F.when(F.col("_sub") > 0, F.get("_steps", F.col("_sub") - 1))
    return rows.select("_p", key, "_x", before.alias("_below"), F.get("_steps", F.col("_sub")).alias("_at"))


def _by_asof(known: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """``_by_halving`` for any number of steps."""
    bucket = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("_x"))) * BUCKETS)
    s = steps.select(key, F.col("lo").alias("_x"), F.struct("lo", "hi", "value").alias("_at"))
    below = asof(known, s, key=(key,), ts="_x", values=["_at"], bucket=bucket).withColumnRenamed("_at", "_below")
    return asof(below, s, key=(key,), ts="_x", values=["_at"], direction="forward", bucket=bucket)


def isotonic_apply(
    predictions: DataFrame, steps: DataFrame, *, score: str = "mean", key: str = "horizon", digits: int | None = None
) -> DataFrame:
    """Predictions with calibrated scores: the value of the step, between two steps a line, beyond the ends the
    value of the last one. Keys without steps and null scores stay as they are."""
    columns: Sequence[str] = predictions.columns
    rows = predictions.select(F.struct(*columns).alias("_p"), F.col(key).alias(key), _rounded(F.col(score), digits).alias("_x"))
    known = rows.filter(F.col(key).isNotNull() & F.col("_x").isNotNull())
    most, held = steps.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
    both = _by_halving(known, steps, key, most or 0) if (held or 0) <= STEPS_SENT else _by_asof(known, steps, key)
    b, a, x = F.col("_below"), F.col("_at"), F.col("_x")
    line = b["value"] + (a["value"] - b["value"]) * (x - b["hi"]) / (a["lo"] - b["hi"])
    value = (
        F.when(b.isNull(), a["value"])
        .when((x <= b["hi"]) | a.isNull(), b["value"])
        .otherwise(line)
    )
    done = both.select("_p", F.coalesce(value, F.col(f"_p.{score}").cast("double")).alias("_value"))
    rest = rows.filter(F.col(key).isNull() | F.col("_x").isNull()).select("_p", F.col(f"_p.{score}").cast("double").alias("_value"))
    return done.unionByName(rest).select(*[F.col("_value").alias(c) if c == score else F.col(f"_p.{c}").alias(c) for c in columns])


def isotonic_calibrate(predictions: DataFrame, joined: DataFrame, *, key: str = "horizon", min_samples: int = 100, digits: int | None = None) -> DataFrame:
    """Calibrated ``predictions`` by a fit on validation rows ``joined`` (mean, actual, key)."""
    steps = isotonic_fit(joined, key=key, min_samples=min_samples, digits=digits)
    return isotonic_apply(predictions, steps, key=key, digits=digits)

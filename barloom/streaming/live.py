"""The live path on Structured Streaming; a replay gives the batch results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.operators.bars import order_key
from barloom.operators.signals import alerts

C = F.col


def read_parquet_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Landed files as a stream.  Without ``files_per_batch`` a run over what is there is one
    batch, so its result does not depend on how the rows were cut into files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_bars(
    ticks: DataFrame, minutes: int, *, ts: str = "ts", key: Sequence[str] = ("ticker",),
    lateness: str = "10 minutes", order: str | None = None,
) -> DataFrame:
    """Tumbling OHLCV bars; a bar is emitted once the watermark passes it, rows
    later than that are dropped.  ``order``, an integer, breaks ties of equal times."""
    when: Column = order_key(ts, order) if order else C(ts)
    return (
        ticks.withWatermark(ts, lateness)
        .groupBy(*key, F.window(ts, f"{minutes} minutes").alias("_w"))
        .agg(
            F.min_by("price", when).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", when).alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select(*key, C("_w.start").alias(ts), "open", "high", "low", "close", "volume")
    )


def stream_dedupe(
    rows: DataFrame, columns: Sequence[str], *, ts: str = "ts", lateness: str = "10 minutes"
) -> DataFrame:
    """Drop replayed rows: equal in ``columns`` within the watermark."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(columns))


def stream_asof_static(
    bars: DataFrame, daily: DataFrame, values: Sequence[str], *, key: Sequence[str] = ("ticker",),
    ts: str = "ts",
) -> DataFrame:
    """Bars with a slowly changing daily table: ``daily`` has one row per key and
    day of validity (``day``), so the as-of match is an equality join."""
    table = daily.select(*key, "day", *values)
    return (
        bars.withColumn("day", F.to_date(ts)).join(table, [*key, "day"], "left").drop("day")
    )


def validity_days(daily: DataFrame, days: DataFrame, values: Sequence[str], key: Sequence[str] = ("ticker",)) -> DataFrame:
    """The daily table spread over every day it is valid for, ready for the join."""
    from barloom.operators.asof import asof

    right = daily.withColumn("day", F.to_date("day"))
    grid = days.select(*key, F.to_date("day").alias("day")).distinct()
    return asof(grid, right, key=key, ts="day", values=values, bucket=F.year("day"))


FOLD_EVERY = 16


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of every ticker; of one time, that of the later batch."""
    values = [c for c in rows.columns if c != "ticker"]
    return rows.groupBy("ticker").agg(
        F.max_by(F.struct(*values), F.struct("ts", "_batch")).alias("_r")
    ).select("ticker", "_r.*")


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Batch ids of the complete ``kind=`` folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [(x.getPath(), x.getPath().getName().partition("=")) for x in fs.listStatus(root)]
    return sorted(
        int(name[2]) for where, name in names
        if name[0] == kind and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS"))
    )


def _parts(spark: SparkSession, path: str, last: int, before: int) -> list[str]:
    """The newest base older than batch ``before`` and the changes after it, up to batch ``last``."""
    bases = [b for b in _written(spark, path, "base") if b < before]
    since = bases[-1] if bases else -1
    changes = [f"{path}/change={d}" for d in _written(spark, path, "change") if since < d <= last]
    return [f"{path}/base={since}"] * (since >= 0) + changes


def latest_alerts_sink(path: str, fold_every: int = FOLD_EVERY, **rules) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the newest forecast of every ticker, as changes on a base.

    A batch writes the tickers it holds and no others, into a folder named by its id, so a repeated
    batch overwrites itself. Every ``fold_every`` batches the changes are folded into a new base;
    the one before and its changes stay until the next fold, as readers may hold them.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = _newest(alerts(batch, **rules).withColumn("_batch", F.lit(batch_id).cast("bigint")))
        fresh.write.mode("overwrite").parquet(f"{path}/change={batch_id}")
        if (batch_id + 1) % fold_every:
            return
        parts = _parts(spark, path, batch_id, batch_id)
        _newest(spark.read.schema(fresh.schema).parquet(*parts)).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
        held = batch_id - fold_every
        gone = [f"change={d}" for d in _written(spark, path, "change") if d <= held]
        gone += [f"base={b}" for b in _written(spark, path, "base") if b < held]
        for name in gone:
            old = spark._jvm.org.apache.hadoop.fs.Path(path, name)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return upsert


def latest_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every ticker over the base and the changes since."""
    last = max(_written(spark, path, "change") + _written(spark, path, "base"), default=-1)
    if last < 0:
        raise ValueError(f"nothing written yet under {path}")
    return _newest(spark.read.parquet(*_parts(spark, path, last, last + 1))).drop("_batch")


def start_latest_alerts(
    predictions: DataFrame, path: str, checkpoint: str, every: str | None = "900 seconds",
    fold_every: int = FOLD_EVERY, **rules,
):
    """Run the alert table at a cadence, or once over what is there (``every=None``)."""
    writer = (
        predictions.writeStream.foreachBatch(latest_alerts_sink(path, fold_every, **rules))
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()

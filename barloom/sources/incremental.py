"""Incremental loads: deduplication, merging, chunk planning, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from barloom.functions.columns import flag
from barloom.session import materialize

C = F.col
RECEIVED = "SYSTIME"


def dedupe_rows(df: DataFrame, received: str = RECEIVED) -> DataFrame:
    """Drop rows equal in everything but the receive time; the latest is kept.

    Different values at one key both stay.
    """
    if received not in df.columns:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != received]
    return df.groupBy(*rest).agg(F.max(received).alias(received)).select(*df.columns)


def incremental_merge(existing: DataFrame, chunk: DataFrame, received: str = RECEIVED) -> DataFrame:
    return dedupe_rows(existing.unionByName(chunk, allowMissingColumns=True), received)


def save_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write a table of partitions; those of ``df`` replace older ones, others stay.

    Rows are dealt by ranges of the partition and then of all other columns that can be ordered,
    so a month with a third of all rows is many tasks and files.
    """
    rest = [
        f.name for f in df.schema.fields
        if f.name not in partition_by and isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)
    ]
    df.repartitionByRange(*partition_by, *[C(f"`{c}`") for c in rest]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partition_by).parquet(path)


def merge_into(path: str, chunk: DataFrame, partition_by: Sequence[str], received: str = RECEIVED) -> None:
    """Merge a chunk into a stored table in place, reading and rewriting only its partitions.

    The merged partitions are stored before they replace the old ones; a lost job can be repeated.
    """
    spark = chunk.sparkSession
    touched = chunk.select(*partition_by).distinct()
    have = spark.read.schema(chunk.schema).parquet(path).join(touched, list(partition_by), "left_semi")
    merged = materialize(incremental_merge(have.select(*chunk.columns), chunk, received))
    save_partitions(merged, path, partition_by)


def newest(df: DataFrame, key: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Latest time per key, for resuming."""
    return df.groupBy(*key).agg(F.max(ts).alias("newest"))


def month_chunks(df: DataFrame, start: str, end: str, months: int) -> DataFrame:
    """Half-open chunks of ``[start, end)`` date columns, the last one clipped."""
    if months <= 0:
        raise ValueError(f"a chunk takes a month or more, not {months}")
    s, e = F.to_date(start), F.to_date(end)
    starts = F.sequence(s, F.date_sub(e, 1), F.make_ym_interval(F.lit(0), F.lit(months)))
    keep = [c for c in df.columns if c not in (start, end)]
    return (
        df.filter(s < e)
        .select(*keep, e.alias("_end"), F.explode(starts).alias("chunk_start"))
        .withColumn("chunk_end", F.least(F.add_months("chunk_start", months), C("_end")))
        .drop("_end")
    )


def coverage_gaps(
    chunks: DataFrame, data: DataFrame, key: Sequence[str] = ("ticker",), ts: str = "ts"
) -> DataFrame:
    """Chunks (per key) not covered: the newest row is not yet within a day of the end."""
    have = newest(data, key, ts)
    bound = C("chunk_end").cast("timestamp") - F.expr("INTERVAL 1 DAY")
    covered = flag(C("newest") >= bound)
    return chunks.join(have, list(key), "left").filter(covered == 0).drop("newest")


def job_matrix(keys: DataFrame, products: Sequence[str]) -> DataFrame:
    """Every key with every product."""
    return keys.select("*", F.explode(F.array(*[F.lit(p) for p in products])).alias("product"))


def missing_keys(wanted: DataFrame, data: DataFrame, key: Sequence[str] = ("ticker",)) -> DataFrame:
    return wanted.join(data.select(*key), list(key), "left_anti")


# Fixed value: 5-minute bars of a session.
EXPECTED_BARS = 105


def source_profile(df: DataFrame, source: str = "source", ts: str = "ts", expected: int = EXPECTED_BARS) -> DataFrame:
    """Rows, time range, days and bars per day against the expected number."""
    return (
        df.groupBy(source, F.to_date(ts).alias("_day"))
        .agg(F.count("*").alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        .groupBy(source)
        .agg(
            F.sum("_n").alias("n_rows"),
            F.count("*").alias("n_days"),
            F.min("_lo").alias("first_ts"),
            F.max("_hi").alias("last_ts"),
        )
        .withColumn("bars_per_day", C("n_rows") / C("n_days"))
        .withColumn("coverage", C("bars_per_day") / expected)
    )


def save_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Artifacts of a run, one parquet table per name, partitioned by ``run_id``."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("run_id").parquet(f"{root}/{name}")


def load_run(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").filter(C("run_id") == run_id).drop("run_id")

"""Session helpers shared by the tests, the benchmark and the entry points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "barloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; all are session-level."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for stored intermediate tables: the cluster's own, beside its warehouse if unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    return (told or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Store a frame that several passes read, and continue from the stored copy.

    A parquet table under the cluster's checkpoint folder: lost executors reread
    it, later passes still prune columns, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/barloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

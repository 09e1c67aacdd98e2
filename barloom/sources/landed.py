"""Landed files to tables: CSV, parquet, JSON envelopes, XML rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col
BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def csv_schema(columns: Sequence[str], ts: str = "ts") -> T.StructType:
    return T.StructType(
        [T.StructField(ts, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in columns]]
    )


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Text time to UTC timestamp; rows without a readable time drop out."""
    return df.withColumn(ts, F.try_to_timestamp(C(ts))).filter(C(ts).isNotNull())


def scan_raw_csv(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = BAR_COLUMNS,
    ts: str = "ts",
) -> DataFrame:
    """CSV whose first column is the time, with a declared schema."""
    raw = spark.read.option("header", True).schema(csv_schema(columns, ts)).csv(
        path if isinstance(path, str) else list(path)
    )
    return _timed(raw, ts)


def scan_ticker_files(
    spark: SparkSession, root: str, columns: Sequence[str] = BAR_COLUMNS, ts: str = "ts",
    files: str = "*.csv", ticker: str = r"([^/]+)\.csv$",
) -> DataFrame:
    """All ``<root>/<ticker>.csv`` as one table, ticker from the path.

    ``files`` and ``ticker`` (a pattern on the path) fit other layouts.  Tickers without a file are simply not there; rows without a close drop out.
    """
    raw = (
        spark.read.option("header", True)
        .schema(csv_schema(columns, ts))
        .csv(f"{root}/{files}")
        .withColumn("ticker", F.regexp_extract(C("_metadata.file_path"), ticker, 1))
    )
    return _timed(raw, ts).filter(C("close").isNotNull())


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``sink_parquet`` or any other; the month of the folders is not a column."""
    return spark.read.parquet(path).drop(MONTH)


def sink_raw_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


MONTH = "_month"


def sink_parquet(df: DataFrame, path: str, ts: str = "ts", key: Sequence[str] = ("ticker",)) -> None:
    """One folder per month; rows are dealt by ranges of month, key and time, so a hot key is many
    tasks, a month few files, and row groups of a key lie together."""
    monthly = df.withColumn(MONTH, F.date_format(ts, "yyyy-MM"))
    ranged = monthly.repartitionByRange(MONTH, *key, ts).sortWithinPartitions(MONTH, *key, ts)
    ranged.write.mode("overwrite").option("compression", "snappy").partitionBy(MONTH).parquet(path)


_BLOCK = "struct<columns:array<string>,data:array<array<string>>>"


def flatten_envelope(
    df: DataFrame, columns: Sequence[str], key: str | None = None, payload: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``{"<key>": {"columns": [...], "data": [[...]]}}`` text to rows of strings.

    Takes block ``key`` if given and there, else the first block with data.
    Missing columns become null.
    """
    blocks = F.from_json(C(payload), f"map<string,{_BLOCK}>")
    names = F.json_object_keys(C(payload))
    first = F.get(
        F.filter(
            F.transform(names, lambda n: F.element_at(blocks, n)),
            lambda b: b["data"].isNotNull(),
        ),
        F.lit(0),
    )
    block = F.coalesce(F.try_element_at(blocks, F.lit(key)), first) if key else first
    rows = df.select(*keep, block.alias("_b")).select(
        *keep, C("_b.columns").alias("_c"), F.explode("_b.data").alias("_r")
    )
    cell = F.map_from_entries(F.arrays_zip(F.transform("_c", F.lower).alias("k"), C("_r").alias("v")))
    return rows.withColumn("_m", cell).select(
        *keep, *[F.try_element_at("_m", F.lit(c)).alias(c) for c in columns]
    )


def scan_json_envelope(
    spark: SparkSession, path: str, columns: Sequence[str], key: str | None = None
) -> DataFrame:
    """One envelope per file."""
    return flatten_envelope(scan_documents(spark, path), columns, key)


def parse_fx_rates(docs: DataFrame, payload: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Rate records: ``Date`` dd.mm.yyyy, decimal-comma ``Value`` per ``Nominal``."""
    record = "array<struct<_Date:string,Nominal:string,Value:string>>"
    parsed = F.from_xml(C(payload), f"Record {record}")["Record"]
    raw = docs.select(*keep, F.explode(parsed).alias("_r")).select(*keep, "_r.*")
    return raw.select(
        *keep,
        F.try_to_timestamp(C("_Date"), F.lit("dd.MM.yyyy")).alias("ts"),
        (
            F.coalesce(_decimal_comma(C("Value")), F.lit(0.0))
            / F.greatest(F.coalesce(_decimal_comma(C("Nominal")), F.lit(1.0)), F.lit(1.0))
        ).alias("value"),
    ).filter(C("ts").isNotNull())


def parse_key_rates(docs: DataFrame, payload: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``KR`` nodes anywhere, in any namespace, with both ``DT`` and ``Rate``."""

    def named(n: str) -> str:
        return f'*[local-name()="{n}"]'

    whole = f'//{named("KR")}[{named("DT")}[text()] and {named("Rate")}[text()]]'

    def values(n: str) -> Column:
        return F.xpath(C(payload), F.lit(f"{whole}/{named(n)}/text()"))

    pairs = F.arrays_zip(values("DT").alias("dt"), values("Rate").alias("rate"))
    return docs.select(*keep, F.explode(pairs).alias("_r")).select(
        *keep,
        F.try_to_timestamp(C("_r.dt")).alias("ts"),
        _decimal_comma(C("_r.rate")).alias("key_rate"),
    ).dropna(subset=["ts", "key_rate"])


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file, its text in ``value``."""
    return spark.read.option("wholetext", True).text(path)


def scan_fx_rates(spark: SparkSession, path: str) -> DataFrame:
    return parse_fx_rates(scan_documents(spark, path))


def scan_key_rates(spark: SparkSession, path: str) -> DataFrame:
    return parse_key_rates(scan_documents(spark, path))


def _decimal_comma(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".").try_cast("double")


def session_timestamp(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``tradedate`` (+ ``tradetime``) to a UTC time; rows of nulls only drop out."""
    if "tradedate" not in df.columns:
        return df
    date = C("tradedate").cast("string")
    text = F.concat_ws(" ", date, C("tradetime").cast("string")) if "tradetime" in df.columns else date
    return df.dropna("all").withColumn(ts, F.try_to_timestamp(text))


def canonical_columns(df: DataFrame, ts: str = "ts", zone: str | None = None) -> DataFrame:
    """Lower-case names, UTC time, the OHLCV columns as doubles."""
    df = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    time = C(ts).cast("timestamp")
    if zone is not None:
        time = F.to_utc_timestamp(time, zone)
    keys = [c for c in ("ticker",) if c in df.columns]
    return df.select(
        *keys, time.alias(ts), *[C(c).cast("double").alias(c) for c in BAR_COLUMNS if c in df.columns]
    )

"""What the operators share: input columns, stored intermediate tables, Arrow passes over rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: a batch ends at the first bound it meets, so a worker holds 4 MB of texts or one longer text.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: ASCII white space, as the contracts spell it.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the Arrow passes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextmanager
def batch_rows(spark: SparkSession, rows: int, most: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of other bounds for the jobs started inside."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    try:
        yield
    finally:
        ready(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; where the session names none, one beside its warehouse."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        told = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-llm-scratch"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that is read more than once and go on from the copy (cuts the lineage)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a stored frame that no later plan reads."""
    path = getattr(df, "stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """``crc32`` of the decimal text of an id, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its id and text, so that repeated rows share it and null ids have one."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string"))


def add_columns(
    docs: DataFrame, keep: Sequence[str], new: str, make: Callable[[], Callable[..., dict]], text: str = "text",
    extra: Sequence[str] = (),
) -> DataFrame:
    """One Arrow pass: rows keep the columns ``keep`` and get the columns ``new``.

    ``make()`` runs once a task and returns a function from the batch's texts
    (UTF-8 bytes, null as empty) and the columns ``extra`` to a dict of column
    values. Columns of the input with the name of a new one are replaced. Inputs
    of any width are read only in ``keep``, ``extra`` and the text.
    """
    added = T._parse_datatype_string(new) if isinstance(new, str) else new
    names = {f.name for f in added}
    carried = [c for c in dict.fromkeys(keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in carried] + list(added))
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("binary").alias("__text"), *[F.col(f"`{c}`") for c in extra])
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            if not b.num_rows:
                continue
            work = work or make()
            got = work([x or b"" for x in b.column(n).to_pylist()], *[b.column(n + 1 + i).to_pylist() for i in range(len(extra))])
            cols = [b.column(i) for i in range(n)]
            cols += [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], arrow_type(f.dataType)) for f in added]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

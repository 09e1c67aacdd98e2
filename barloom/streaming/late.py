"""Labels that arrive late: predictions wait for them in a stream-stream join.

A label of horizon h is known h bars after its prediction. Both streams carry a watermark and the join
a time range, so a prediction stays in the state for ``wait`` at most and state follows the predictions of
that span, not the length of the run. What comes out is an append-only table of scored pairs;
coverage and thresholds are sums and exact quantiles over its windows, with no row-by-row level.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.thresholds import conformal_two_sided
from barloom.session import checkpoint_dir

C = F.col
EPOCH = "1970-01-01"
SLICE = "_span"
FILES = 8  #: files of a landed write, and of a batch
ROWS = 500_000  #: rows of a write of several spans


def span_of(time: str, days: int) -> Column:
    """Number of the span of ``days`` since the epoch."""
    return F.floor(F.datediff(F.to_date(time), F.to_date(F.lit(EPOCH))) / days)


def late_labels(
    predictions: DataFrame, labels: DataFrame, wait: str, *, key: Sequence[str] = ("ticker", "horizon"),
    ts: str = "ts", known: str = "known_at", lateness: str = "1 day",
) -> DataFrame:
    """Predictions joined to labels of their key and time that are known within ``wait``.

    ``labels`` has the key, the time of the prediction, ``known`` and ``actual``.  A label known before its
    prediction or more than ``wait`` after it is dropped, as is a row of either stream that is later than
    the watermark; a prediction without a label never comes out.  Null keys and times match nothing.
    A label repeated within the wait comes out as often as it came.
    """
    asked = predictions.withWatermark(ts, lateness).alias("p")
    told = labels.withWatermark(known, lateness).alias("l")
    on = [C(f"p.{c}") == C(f"l.{c}") for c in (*key, ts)]
    first = C(f"p.{ts}")
    on.append(C(f"l.{known}").between(first, first + F.expr(f"INTERVAL {wait}")))
    values = [c for c in predictions.columns if c not in (*key, ts)]
    return asked.join(told, on).select(
        *[C(f"p.{c}") for c in (*key, ts)], *[C(f"p.`{c}`") for c in values], C(f"l.{known}"), C("l.actual")
    )


def by_span(rows: DataFrame, time: str, days: int) -> DataFrame:
    """``rows`` stored in a folder per span of ``days``, many files a span; rows without a time match nothing and are left out."""
    path = f"{checkpoint_dir(rows.sparkSession)}/streams/{uuid.uuid4().hex}"
    timed = rows.where(C(time).isNotNull()).withColumn(SLICE, span_of(time, days))
    timed.repartitionByRange(SLICE, time, *[c for c in rows.columns if c != time]).write.partitionBy(SLICE).parquet(path)
    return rows.sparkSession.read.schema(timed.schema).parquet(path)


def land_spans(rows: DataFrame, path: str, files: int = FILES, least: int = 0) -> int:
    """Land a table of ``by_span``, each span in a write of its own, so that files are older the earlier their span.

    Consecutive spans of fewer than ``least`` rows together land in one write: a batch has a cost of its own,
    whatever it holds. Gives the number of spans, gaps included, of the widest write.

    A stream takes files by age. Rows of a write may come in any order, so a stream of several batches
    needs a lateness of the widest one; it then loses none, wherever its batches begin, and its state holds
    the wait and a few writes, whatever the length of the table.
    """
    writes, held, size = [], [], 0
    for span, n in rows.groupBy(SLICE).count().orderBy(SLICE).collect():
        held, size = [*held, span], size + n
        if size >= least:
            writes.append(held)
            held, size = [], 0
    writes += [held] if held else []
    if not writes:
        rows.drop(SLICE).write.parquet(path)
    for spans in writes:
        rows.where(C(SLICE).isin(spans)).drop(SLICE).repartition(files).write.mode("append").parquet(path)
    return max((spans[-1] - spans[0] + 1 for spans in writes), default=1)


def window_calibration(
    pairs: DataFrame, days: int, alpha: float = 0.1, *, by: str = "horizon", known: str = "known_at"
) -> DataFrame:
    """Per ``by`` and window of ``days`` in which labels became known: the split-conformal quantile and
    threshold, and the coverage of the quantile of the window before (null in the first one)."""
    if days < 1:
        raise ValueError(f"a window takes a day or more, not {days}")
    rows = pairs.filter(C("mean").isNotNull() & C("actual").isNotNull() & C(known).isNotNull()).withColumn("window", span_of(known, days))
    made = conformal_two_sided(rows, alpha, group=[by, "window"])
    # one row per window: the frame below orders a short table
    order = Window.partitionBy(by).orderBy("window")
    made = made.withColumn("_before", F.lag("quantile").over(order))
    hit = F.abs(C("mean") - C("actual")) <= C("_before")
    covered = rows.join(made.select(by, "window", "_before"), [by, "window"]).groupBy(by, "window").agg(
        F.avg(F.when(C("_before").isNotNull(), hit.cast("double"))).alias("coverage")
    )
    return made.drop("_before").join(covered, [by, "window"]).select(
        by, F.date_add(F.to_date(F.lit(EPOCH)), (C("window") * days).cast("int")).alias("window_start"),
        "n_calibration", "quantile", "threshold", "coverage",
    )

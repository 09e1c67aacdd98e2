"""Late labels: the stream-stream join gives the batch pairs, whatever the number of batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.catalog.q_models import run_to_table
from barloom.catalog.registry import QUERIES
from barloom.sources.incremental import save_partitions
from barloom.streaming import late as W
from barloom.streaming import live as V

DAY = dt.datetime(2024, 1, 1)
P = "ts timestamp, ticker string, horizon int, mean double"
L = "ts timestamp, ticker string, horizon int, known_at timestamp, actual double"


def rows():
    at = lambda d: DAY + dt.timedelta(days=d)
    preds = [(at(d), t, 2, (d * 7 % 10) / 10) for d in range(80) for t in "ab"]
    labels = []
    for d in range(80):
        wait = 2 if d % 5 else 9  # every fifth label comes too late
        labels.append((at(d), "a", 2, at(d + wait), float(d % 2)))
        if d % 3:
            labels.append((at(d), "b", 2, at(d + 2), float(d % 2)))
    preds += [(at(3), None, 2, 0.5), (at(3), "c", 2, None)]
    labels += [(at(3), "c", 2, at(4), 1.0), (at(9), "a", 2, at(8), 1.0), (at(3), None, 2, at(4), 1.0), (at(4), "d", 2, at(5), 1.0)]
    return sorted(preds, key=lambda r: r[0]), sorted(labels, key=lambda r: r[3])


def land(spark, path, data, schema, files):
    step = -(-len(data) // files)
    for i in range(0, len(data), step):
        spark.createDataFrame(data[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)
    return V.read_parquet_stream(spark, path, spark.createDataFrame([], schema).schema, 1)


@pytest.mark.parametrize("files", [1, 4, 10])
def test_pairs_equal_the_batch(spark, tmp_path, files):
    preds, labels = rows()
    p, a = (land(spark, str(tmp_path / n), d, s, files) for n, d, s in (("p", preds, P), ("l", labels, L)))
    got = run_to_table(W.late_labels(p, a, "5 days"), spark).collect()
    told = [(r[0], r[1], r[3], r[4]) for r in labels]
    want = {
        (ts, t, k, m, y) for ts, t, _, m in preds for lts, lt, k, y in told
        if t is not None and (ts, t) == (lts, lt) and ts <= k <= ts + dt.timedelta(days=5)
    }
    assert len(got) == len(want) and {(r.ts, r.ticker, r.known_at, r.mean, r.actual) for r in got} == want


def test_state_holds_the_wait_only(spark, tmp_path):
    preds, labels = rows()
    p, a = (land(spark, str(tmp_path / n), d, s, 10) for n, d, s in (("p", preds, P), ("l", labels, L)))
    q = (
        W.late_labels(p, a, "5 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination()
    held = [s["numRowsTotal"] for r in q.recentProgress for s in r["stateOperators"]]
    assert len(q.recentProgress) >= 10 and max(held) < (len(preds) + len(labels)) / 2


@pytest.mark.parametrize("batch", [2, 3])
def test_spans_land_in_order_and_lose_no_pair(spark, tmp_path, batch):
    """Rows dealt anyhow land a span after the other; batches may begin inside a span."""
    preds, labels = rows()
    sides = []
    for name, data, schema, time in (("p", preds, P, "ts"), ("l", labels, L, "known_at")):
        df = spark.createDataFrame(data[::-1], schema)
        W.land_spans(W.by_span(df, time, 7), str(tmp_path / name), 2)
        sides.append(V.read_parquet_stream(spark, str(tmp_path / name), df.schema, batch))
    q = (
        W.late_labels(*sides, "5 days", lateness="7 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {
        (ts, t, k, m, y) for ts, t, _, m in preds for lts, lt, _, k, y in labels
        if t is not None and (ts, t) == (lts, lt) and ts <= k <= ts + dt.timedelta(days=5)
    }
    assert len(got) == len(want) and {(r.ts, r.ticker, r.known_at, r.mean, r.actual) for r in got} == want
    held = [s["numRowsTotal"] for r in q.recentProgress for s in r["stateOperators"]]
    assert len(q.recentProgress) >= 8 and max(held) < (len(preds) + len(labels)) / 2


@pytest.mark.parametrize("least, batch", [(60, 2), (60, 3), (10**6, 2)])
def test_small_spans_land_together_and_lose_no_pair(spark, tmp_path, least, batch):
    """A batch has a cost of its own, so spans of few rows share one; batches may begin inside a write."""
    preds, labels = rows()
    sides, spans = [], []
    for name, data, schema, time in (("p", preds, P, "ts"), ("l", labels, L, "known_at")):
        df = spark.createDataFrame(data[::-1], schema)
        spans.append(W.land_spans(W.by_span(df, time, 7), str(tmp_path / name), 2, least=least))
        assert len(list((tmp_path / name).glob("*.parquet"))) == (2 if least > 1000 else 6)
        sides.append(V.read_parquet_stream(spark, str(tmp_path / name), df.schema, batch))
    pairs = W.late_labels(*sides, "5 days", lateness=f"{7 * max(spans)} days")
    q = pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {
        (ts, t, k, m, y) for ts, t, _, m in preds for lts, lt, _, k, y in labels
        if t is not None and (ts, t) == (lts, lt) and ts <= k <= ts + dt.timedelta(days=5)
    }
    assert len(got) == len(want) and {(r.ts, r.ticker, r.known_at, r.mean, r.actual) for r in got} == want


def test_the_query_runs_in_batches(spark, monkeypatch):
    asked = []
    read = V.read_parquet_stream
    monkeypatch.setattr(V, "read_parquet_stream", lambda *a: asked.append(a) or read(*a))
    assert QUERIES["stream_late_labels"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(asked) == 2 and all(len(a) == 4 and a[3] for a in asked)


def test_windows(spark):
    _, labels = rows()
    pairs = spark.createDataFrame([(*r, 0.25) for r in labels], L + ", mean double")
    got = W.window_calibration(pairs, 30).orderBy("window_start").collect()
    assert got[0].coverage is None and all(r.coverage is not None for r in got[1:])
    assert sum(r.n_calibration for r in got) == len(labels)
    assert all(r.quantile == 0.75 and r.threshold == 0.75 for r in got)
    assert W.window_calibration(pairs.where("false"), 30).count() == 0
    with pytest.raises(ValueError):
        W.window_calibration(pairs, 0)


def test_a_hot_partition_is_many_files(spark, tmp_path):
    df = spark.range(20000).select(
        F.when(F.col("id") < 18000, "2024-01").otherwise("2024-02").alias("month"), "id", F.array("id").alias("xs")
    )
    out = tmp_path / "t"
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # few small rows would be put together again
    spark.conf.set(merge, "false")
    try:
        save_partitions(df, str(out), ["month"])
    finally:
        spark.conf.unset(merge)
    assert len(list((out / "month=2024-01").glob("*.parquet"))) > 1
    save_partitions(df.where("month = '2024-02'").limit(7), str(out), ["month"])
    left = {r.month: r["count"] for r in spark.read.parquet(str(out)).groupBy("month").count().collect()}
    assert left == {"2024-01": 18000, "2024-02": 7}

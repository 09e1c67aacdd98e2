"""A replayed stream gives the batch result."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from barloom.catalog import load
from barloom.operators.bars import resample_ohlcv, ticks_as_bars
from barloom.streaming import live as V


def run(df, spark, tmp_path, mode="append"):
    q = (
        df.writeStream.outputMode(mode).format("parquet")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_bars_and_late_rows(spark, tmp_path):
    ts = pd.date_range("2024-01-02 07:00", periods=300, freq="1min")
    df = pd.DataFrame({"ticker": "a", "ts": ts, "price": np.arange(300.0), "qty": 1.0})
    src = tmp_path / "in"
    for part in (df.iloc[:100], df.iloc[100:], df.iloc[:1].assign(price=9999.0)):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(src))
    stream = V.read_parquet_stream(spark, str(src), spark.createDataFrame(df).schema, 1)
    got = run(V.stream_bars(stream, 5), spark, tmp_path).orderBy("ts").toPandas()
    batch = resample_ohlcv(ticks_as_bars(spark.createDataFrame(df)), 5).orderBy("ts").toPandas()
    assert 0 < len(got) < len(batch)
    pd.testing.assert_frame_equal(got, batch.iloc[: len(got)][got.columns.tolist()])


@pytest.mark.parametrize("files", [4, 40, 400])
def test_rows_do_not_depend_on_the_files(spark, tmp_path, files):
    ts = pd.date_range("2024-01-02 07:00", periods=1200, freq="1min")
    df = pd.DataFrame({"ticker": "a", "ts": ts, "price": np.arange(1200.0), "qty": 1.0, "event_id": np.arange(1200)})
    rows = spark.createDataFrame(df)
    src = str(tmp_path / "in")
    rows.repartition(files).write.parquet(src)
    stream = V.read_parquet_stream(spark, src, rows.schema)
    got = run(V.stream_bars(stream, 5, order="event_id"), spark, tmp_path).orderBy("ts").toPandas()
    batch = resample_ohlcv(ticks_as_bars(rows), 5).orderBy("ts").toPandas()
    assert len(got) == 237
    pd.testing.assert_frame_equal(got, batch.iloc[: len(got)][got.columns.tolist()])


def test_alert_batches_write_their_own_tickers(spark, tmp_path):
    """Many tickers once, then two a batch: later batches write two rows, folders stay bounded, the newest rows are right."""
    first = pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "ticker": [f"t{i:03d}" for i in range(200)], "horizon": 1, "mean": np.linspace(0.1, 0.9, 200), "std": 0.1})
    later = [first.iloc[[i, 199 - i]].assign(ts=pd.Timestamp("2024-01-02") + pd.Timedelta(days=i), mean=0.2 + 0.05 * i) for i in range(9)]
    src, out = str(tmp_path / "in"), tmp_path / "alerts"
    for part in [first, *later]:
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
    stream = V.read_parquet_stream(spark, src, spark.createDataFrame(first).schema, 1)
    V.start_latest_alerts(stream, str(out), str(tmp_path / "check"), every=None, fold_every=4).awaitTermination()
    written = {p.name: spark.read.parquet(str(p)).count() for p in out.glob("*=*")}
    assert sorted(written) == ["base=3", "base=7", *[f"change={i}" for i in range(4, 10)]]
    assert all(n == (200 if name.startswith("base") else 2) for name, n in written.items())
    got = V.latest_alerts(spark, str(out)).toPandas().set_index("ticker").sort_index()
    want = pd.concat([first, *later]).sort_values("ts", kind="stable").groupby("ticker").last()
    assert list(got.index) == list(want.index)
    assert (got["ts"] == want["ts"]).all() and np.allclose(got["expected_return"], want["mean"])


def test_a_repeated_alert_batch_changes_nothing(spark, tmp_path):
    f = spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "ticker": ["a", "b"], "horizon": 1, "mean": [0.3, 0.4], "std": 0.1}))
    out = str(tmp_path / "alerts")
    with pytest.raises(ValueError):
        V.latest_alerts(spark, out)
    write = V.latest_alerts_sink(out, fold_every=2)
    for batch, rows in ((0, f), (1, f.where("ticker = 'b'")), (1, f.where("ticker = 'b'")), (2, f.limit(0)), (3, f.limit(0)), (3, f.limit(0))):
        write(rows, batch)
    got = V.latest_alerts(spark, out)
    assert "_batch" not in got.columns and [r["ticker"] for r in got.orderBy("ticker").collect()] == ["a", "b"]


def test_the_alert_query_takes_many_files_a_batch(spark, monkeypatch):
    """Batches of eight files, however many the landed table has."""
    seen, last = [], V.latest_alerts
    monkeypatch.setattr(V, "latest_alerts", lambda s, path: seen.append(path) or last(s, path))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # few small rows would be put together again
    spark.conf.set(merge, "false")
    try:
        got = load()[0]["stream_latest_alerts"](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset(merge)
    assert got > 0 and len(list(Path(seen[0].removeprefix("file:")).glob("change=*"))) <= -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)

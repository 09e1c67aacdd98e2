"""Block-wise windows, prefixes, as-of joins and ranks against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators.asof import asof, forward_fill
from barloom.operators.blocks import index_rows, running
from barloom.operators.ranks import average_ranks, quantiles


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(0)
    parts = []
    # one series holds most of the rows
    for t, n in (("hot", 900), ("b", 120), ("c", 30)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        o = c * (1 + rng.normal(0, 0.002, n))
        hi, lo = np.maximum(o, c) * 1.003, np.minimum(o, c) * 0.997
        v = rng.integers(0, 50, n).astype(float)
        ts = pd.date_range("2024-01-01", periods=n, freq="D")
        parts.append(pd.DataFrame({"ticker": t, "ts": ts, "open": o, "high": hi, "low": lo, "close": c, "volume": v}))
    return pd.concat(parts)


def by_ticker(df, fn):
    return np.concatenate([fn(g) for _, g in df.sort_values(["ticker", "ts"]).groupby("ticker")])


def run(spark, bars, fam, col, **kw):
    out = fam(spark.createDataFrame(bars), **kw).toPandas().sort_values(["ticker", "ts"])
    assert len(out) == len(bars)
    return out[col].to_numpy(dtype=float)


@pytest.mark.parametrize("size", [64, 4096])
def test_rolling_families(spark, bars, size):
    got = run(spark, bars, I.sma_distance, "sma_20_rel", size=size)
    want = by_ticker(bars, lambda g: (g.close / g.close.rolling(20).mean() - 1).to_numpy())
    np.testing.assert_allclose(got, want, atol=1e-12)
    got = run(spark, bars, I.rolling_volatility, "vol_asym_24", size=size)

    def asym(g):
        lr = np.log(g.close / g.close.shift(1))
        up, dn = lr.clip(lower=0).rolling(24).std(), lr.clip(upper=0).rolling(24).std()
        return ((dn - up) / (up + dn + 1e-9)).to_numpy()

    np.testing.assert_allclose(got, by_ticker(bars, asym), atol=1e-9)
    got = run(spark, bars, I.obv_zscore, "obv_zscore", size=size)

    def obv(g):
        x = (g.volume * np.sign(g.close.diff()).fillna(0)).cumsum()
        r = x.rolling(50)
        return ((x - r.mean()) / (r.std() + 1e-9)).fillna(0).to_numpy()

    np.testing.assert_allclose(got, by_ticker(bars, obv), atol=1e-8)


@pytest.mark.parametrize("size", [64, 4096])
def test_exponential_families(spark, bars, size):
    got = run(spark, bars, I.ema_distance, "ema_26_rel", size=size)
    want = by_ticker(bars, lambda g: (g.close / g.close.ewm(span=26, adjust=False, min_periods=26).mean() - 1).to_numpy())
    np.testing.assert_allclose(got, want, atol=1e-12)

    def rsi(g):
        d = g.close.diff()
        up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        dn = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        return ((100 - 100 / (1 + up / dn)).fillna(50) / 100).to_numpy()

    got = run(spark, bars, I.rsi, "rsi_14", size=size)
    np.testing.assert_allclose(got, by_ticker(bars, rsi), atol=1e-10)

    def macd(g):
        e = lambda x, s: x.ewm(span=s, adjust=False, min_periods=s).mean()
        m = (e(g.close, 12) - e(g.close, 26)) / g.close
        return e(m, 9).to_numpy()

    got = run(spark, bars, I.macd, "macd_signal", size=size)
    np.testing.assert_allclose(got, by_ticker(bars, macd), atol=1e-12)


def test_fracdiff_and_hurst(spark, bars):
    w = np.array(I.fracdiff_weights()[::-1])
    assert len(w) == 282

    def fd(g):
        x = g.close.to_numpy()
        out = np.full(len(x), np.nan)
        for i in range(len(w) - 1, len(x)):
            out[i] = w @ x[i - len(w) + 1 : i + 1]
        return out

    got = run(spark, bars, I.fracdiff, "fracdiff_close", size=300)
    np.testing.assert_allclose(got, by_ticker(bars, fd), atol=1e-9)
    got = run(spark, bars, I.hurst_rs, "hurst_60", size=100)

    def hurst(g):
        def one(v):
            d = np.cumsum(v - v.mean())
            return np.log(np.ptp(d) / v.std(ddof=1) + 1e-10) / np.log(len(v))

        return np.log(g.close / g.close.shift(1)).rolling(60).apply(one, raw=True).to_numpy()

    np.testing.assert_allclose(got, by_ticker(bars, hurst), atol=1e-9)


def test_index_and_running(spark, bars):
    df = spark.createDataFrame(bars)
    out = running(index_rows(df, ["ticker"], "ts"), ["ticker"], "ts", {"v": ("sum", "volume"), "top": ("max", "close")})
    got = out.toPandas().sort_values(["ticker", "ts"])
    assert (got["_idx"].to_numpy() == by_ticker(bars, lambda g: np.arange(len(g)))).all()
    np.testing.assert_allclose(got["v"], by_ticker(bars, lambda g: g.volume.cumsum().to_numpy()))
    np.testing.assert_allclose(got["top"], by_ticker(bars, lambda g: g.close.cummax().to_numpy()))


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_keeps_the_whole_row(spark, bars, direction):
    left = bars[["ticker", "ts", "close"]]
    right = bars[bars.index % 37 == 5][["ticker", "ts", "volume"]].assign(
        extra=lambda d: np.where(d.volume > 25, d.volume, np.nan)
    )
    right["ts"] = right["ts"] + pd.Timedelta(hours=3)
    r = spark.createDataFrame(right).withColumn("extra", F.nanvl("extra", F.lit(None)))
    got = asof(spark.createDataFrame(left), r, values=["volume", "extra"], direction=direction).toPandas()
    want = pd.merge_asof(
        left.sort_values("ts"), right.sort_values("ts"), on="ts", by="ticker", direction=direction
    )
    key = ["ticker", "ts"]
    got, want = got.sort_values(key), want.sort_values(key)
    np.testing.assert_allclose(got["volume"].astype(float), want["volume"])
    np.testing.assert_allclose(got["extra"].astype(float), want["extra"])


def test_forward_fill(spark, bars):
    b = bars.assign(x=np.where(bars.volume % 7 == 0, bars.close, np.nan))
    df = spark.createDataFrame(b).withColumn("x", F.nanvl("x", F.lit(None)))
    got = forward_fill(df, ["x"], key=["ticker"]).toPandas().sort_values(["ticker", "ts"])
    np.testing.assert_allclose(got["x"].astype(float), by_ticker(b, lambda g: g.x.ffill().to_numpy()))


@pytest.mark.parametrize("splits", [2, 3, 32])
def test_ranks_and_quantiles(spark, bars, splits):
    b = bars.assign(v=bars.volume.where(bars.volume > 3))
    df = spark.createDataFrame(b).withColumn("v", F.nanvl("v", F.lit(None)))
    got = average_ranks(df, ["ticker"], "v", splits=splits).toPandas().sort_values(["ticker", "ts"])
    np.testing.assert_allclose(got["rank"].astype(float), by_ticker(b, lambda g: g.v.rank().to_numpy()))
    q = quantiles(df, ["ticker"], "close", [0.0, 0.13, 0.5, 1.0], splits=splits).toPandas()
    assert len(q) == 12
    for r in q.itertuples():
        want = np.quantile(b.loc[b.ticker == r.ticker, "close"], r.q)
        assert abs(r.quantile - want) < 1e-9


@pytest.mark.parametrize("splits", [2, 7, 64, 1000])
def test_quantiles_sort_only_the_ranges_they_need(spark, splits):
    """Uneven values, ties and a group of one row: exact, by plans that never deal rows by their group alone."""
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(size=3000) ** 3, np.repeat(0.25, 900), [np.nan] * 5])
    b = pd.DataFrame({"g": np.where(np.arange(len(v)) % 3 == 0, "a", "b"), "v": v})
    b.loc[len(b)] = ["one", 4.5]
    df = spark.createDataFrame(b).withColumn("v", F.nanvl("v", F.lit(None))).repartition(5)
    probs = [0.0, 0.01, 0.333, 0.5, 0.9, 1.0]
    frame = quantiles(df, ["g"], "v", probs, splits=splits)
    got = {(x.g, x.q): (x.n, x.quantile) for x in frame.collect()}
    assert len(got) == 3 * len(probs)
    for (g, q), (n, x) in got.items():
        known = b.loc[b.g == g, "v"].dropna()
        assert n == len(known) and abs(x - np.quantile(known, q)) < 1e-12
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "size(filter" not in plan and "strategy=broadcast" in plan
    ranks = average_ranks(df, ["g"], "v", splits=splits).filter("v is not null").toPandas()
    for _, rows in ranks.groupby("g"):
        np.testing.assert_allclose(rows["rank"].astype(float), rows.v.rank())


def test_chained_families_share_one_sort(spark, bars):
    """A sort between two families would hold their wide rows in a task's memory."""
    plan = I.indicator_panel(spark.createDataFrame(bars))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") > 10
    executed = I.indicator_panel(spark.createDataFrame(bars))._jdf.queryExecution().executedPlan().toString()
    blocks = [line for line in executed.splitlines() if "Sort [" in line and "_blk" in line]
    assert len(blocks) == 1

"""Sweeps of threshold pairs against a run of every pair, and what they store."""

import random

import pandas as pd
import pytest

from barloom.operators import sweeps as W
from barloom.operators import trades as R

BARS = pd.date_range("2024-01-01", periods=60, freq="D")
COST = 0.0005


def quotes(tickers):
    rnd = random.Random(5)
    return {(k, b): 100 + rnd.randrange(-20, 21) for k in tickers for b in range(len(BARS)) if rnd.random() < 0.95}


def prices(spark, held):
    rows = [(BARS[b], k, float(x), float(x)) for (k, b), x in held.items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "ticker", "open", "close"]))


def left_at(held, ticker, bar, entry):
    later = [x for x in range(bar, len(BARS)) if (ticker, x) in held]
    return held[ticker, later[0]] if later else entry


def net(entry, exit_):
    return (1 - COST) * exit_ / entry * (1 - COST) - 1


@pytest.fixture
def stores(monkeypatch):
    """Rows of every stored table."""
    held, kept = [], W.materialize

    def seen(df):
        out = kept(df)
        held.append(out.count())
        return out

    for m in (W, R):
        monkeypatch.setattr(m, "materialize", seen)
    return held


def test_consensus_pairs_share_their_rows(spark, stores):
    rnd = random.Random(6)
    tickers, hold = "abc", 4
    held = quotes(tickers)
    seen = {(k, b): (rnd.choice([0.1, 0.45, 0.5, 0.55, 0.72, 0.9]), rnd.random()) for k in tickers for b in range(60) if rnd.random() < 0.8}
    rows = [(BARS[b], k, *p) for (k, b), p in seen.items()] + [(BARS[3], "d", 0.9, 0.1)]
    f = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "ticker", "p_long", "p_short"]))
    grid = [round(0.1 * i, 1) for i in range(1, 10)]  # 81 pairs: more than a bit set holds
    found = W.consensus_sweep(f, prices(spark, held), grid, grid, max_hold=hold)
    got = {(r["t_long"], r["t_short"]): r for r in found.collect()}
    assert len(got) == 81
    for (lo, hi), r in got.items():
        opens = [(k, b) for (k, b), (p, q) in seen.items() if p > lo and not q > hi]
        closes = {(k, b) for (k, b), (p, q) in seen.items() if q > hi and not p > lo}
        returns = []
        for k, b in opens:
            if (k, b + 1) in held:
                stop = next((x for x in range(b + 1, b + 1 + hold) if (k, x) in closes), b + 1 + hold)
                entry = held[k, b + 1]
                returns.append(net(entry, left_at(held, k, stop + 1, entry)))
        more = int(0.9 > lo and not 0.1 > hi)  # a ticker without prices
        assert (r["n_open_signals"], r["n_close_signals"], r["n_trades"]) == (len(opens) + more, len(closes), len(returns))
        assert abs(r["win_rate"] - (sum(x > 0 for x in returns) / len(returns) if returns else 0)) < 1e-12
        assert abs(r["final_equity"] - 1e6 - 1e5 * sum(returns)) < 1e-3
    # a stored row per decision, or per exit of one: never one per pair
    assert max(stores) <= 5 * len(rows)


def test_relaxed_pairs_share_their_rows(spark, stores):
    rnd = random.Random(7)
    held = quotes("abcdef")
    rows = [(BARS[b], k, h, rnd.random(), 0.1, rnd.randrange(20) / 20) for (k, b) in held for h in (1, 3)]
    f = pd.DataFrame(rows, columns=["ts", "ticker", "horizon", "mean", "std", "meta"])
    primary = spark.createDataFrame(f.drop(columns="meta"))
    meta = spark.createDataFrame(f.drop(columns=["mean"]).rename(columns={"meta": "mean"}))
    levels, percents = [0.05 * i for i in range(1, 20)], [10.0, 30.0, 60.0, 90.0, 100.0]
    found = W.relaxation_sweep(primary, meta, prices(spark, held), levels, percents, min_buys=20).collect()
    cut = {p: f["meta"].quantile(1 - p / 100) for p in percents}
    want = {}
    for t in levels:
        for p in percents:
            fit = f[(f["mean"] > t) & (f["meta"] > cut[p])]
            if len(fit) >= 20:
                trades = [(r.ticker, list(BARS).index(r.ts), r.horizon) for r in fit.itertuples()]
                want[round(t, 6), p] = (len(fit), sum(b + 1 + h <= 59 and (k, b + 1) in held for k, b, h in trades))
    got = {(round(r["t_primary"], 6), round(r["meta_percent"], 6)): (r["n_buy"], r["n_trades"]) for r in found}
    assert got == want and len(got) < len(levels) * len(percents)
    assert all(abs(r["t_meta"] - cut[round(r["meta_percent"], 6)]) < 1e-12 for r in found)
    assert max(stores) <= 2 * len(f)

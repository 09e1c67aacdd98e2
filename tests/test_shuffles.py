"""Label shuffles over many buckets and blocks, and what travels of them."""

import math
import random
from hashlib import md5

import pandas as pd

from barloom.operators import predictions as H


def test_copies_travel_without_their_hash(spark, monkeypatch):
    monkeypatch.setattr(H, "SHUFFLED", 7, raising=False)
    plans, kept = [], H.materialize
    monkeypatch.setattr(H, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    rnd, k = random.Random(3), 6
    days = pd.date_range("2024-01-01", periods=90, freq="D")
    rows = [(days[i], t, h, rnd.random(), float(rnd.random() < 0.4)) for h, n in ((1, 90), (2, 13), (3, 1)) for i in range(n) for t in ("a", "b")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "ticker", "horizon", "mean", "actual"]))
    got = {r["horizon"]: r for r in H.permutation_null(df, k).collect()}
    for h in (1, 2):
        mine = sorted((r[0], r[1], r[3], r[4]) for r in rows if r[2] == h)
        n, null = len(mine), []
        for s in range(k):
            order = sorted(range(n), key=lambda i: md5(f"{s}:{i}".encode()).hexdigest())
            null.append(-sum(math.log(p if mine[i][3] else 1 - p) for i, (_, _, p, _) in zip(order, mine)) / n)
        mean = sum(null) / k
        assert got[h]["n"] == n
        assert math.isclose(got[h]["loss_null_mean"], mean) and math.isclose(got[h]["loss_null_min"], min(null))
        assert math.isclose(got[h]["loss_null_std"], math.sqrt(sum((x - mean) ** 2 for x in null) / k))
    dealt = [p.split("RepartitionByExpression")[1].split("\n")[1] for p in plans if "RepartitionByExpression" in p]
    assert len(dealt) == 1 and "_copy" in dealt[0] and "unhex" not in dealt[0]


def test_members_travel_as_plain_values(spark):
    """Moments are made after the exchange: no partial sums, which are wider than a value, before it."""
    rows = [("2024-01-01", "a", h, 0.1 * m, 0.0) for h in (1, 2) for m in range(4)] + [("2024-01-01", "b", 1, 0.5, 0.0), ("2024-01-02", "b", 1, None, 0.0)]
    df = spark.createDataFrame(rows, "ts string, ticker string, horizon int, mean double, std double")
    out = H.ensemble_moments(df)
    got = {(r.ts, r.ticker, r.horizon): (r.mean, r.std) for r in out.collect()}
    assert len(got) == 4 and got["2024-01-01", "b", 1] == (0.5, 0.0) and got["2024-01-02", "b", 1] == (None, None)
    assert all(math.isclose(a, b) for h in (1, 2) for a, b in zip(got["2024-01-01", "a", h], (0.15, math.sqrt(0.0125))))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and plan.index("partial_avg") < plan.index("Exchange")

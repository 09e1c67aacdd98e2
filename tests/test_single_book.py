"""Non-overlapping trades against a plain walk over each series."""

import random

from barloom.operators.single_book import non_overlapping, single_position_book


def walk(trades):
    taken, free = [], {}
    for t in sorted(trades, key=lambda t: (t[0], t[1], -t[3], t[4], t[2])):
        if t[1] >= free.get(t[0], -1):
            taken.append(t)
            free[t[0]] = max(t[2], t[1] + 1)
    return taken


def test_equals_a_plain_walk(spark):
    rnd = random.Random(5)
    trades = []
    for name, n in (("hot", 1500), ("a", 40), ("b", 1)):
        for _ in range(n):
            at = rnd.randrange(3 * n)
            h = rnd.choice([0, 1, 1, 3, 6, 30])
            trades.append((name, at, at + h, rnd.choice([0.6, 0.7, 0.8]), h, rnd.uniform(-0.1, 0.1)))
    trades = list({(t[0], t[1], t[3], t[4]): t for t in trades}.values())
    trades += [("lost", 0, 2, 0.6, 2, -1.0), ("lost", 1, 3, 0.6, 2, 0.1), ("lost", 2, 4, 0.6, 2, 0.1)]
    schema = "ticker string, entry_bar bigint, exit_bar bigint, mean double, horizon int, return_pct double"
    df = spark.createDataFrame(trades + [(None, 1, 2, 0.5, 1, 0.0), ("c", None, 2, 0.5, 1, 0.0)], schema).repartition(6)
    want = walk(trades)
    assert sorted(tuple(r) for r in non_overlapping(df).select(*df.columns).collect()) == sorted(want)
    cash = {}
    for r in sorted(single_position_book(df).collect(), key=lambda r: (r.ticker, r.entry_bar)):
        before = cash.get(r.ticker, 1_000_000 / 4)
        assert abs(r.invested - before) < 1e-6 * max(1, before)
        cash[r.ticker] = before * max(1 + r.return_pct, 1e-12)
        assert abs(r.cash - cash[r.ticker]) < 1e-6 * max(1, before)
    assert non_overlapping(df.filter("false")).count() == 0

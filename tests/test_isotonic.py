"""Isotonic calibration against a plain pooling of all rows."""

import numpy as np
import pytest

from barloom.operators.isotonic import isotonic_apply, isotonic_calibrate, isotonic_fit


def plain(x, y):
    """Boundaries and values of the isotonic fit, all rows at once."""
    order = np.argsort(x, kind="stable")
    blocks = []
    for v in np.unique(x):
        at = [i for i in order if x[i] == v]
        blocks.append([v, v, len(at), sum(y[i] for i in at)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(b[0], b[1], b[3] / b[2]) for b in blocks]


def predicted(steps, x):
    return np.interp(x, [p for s in steps for p in (s[0], s[1])], [s[2] for s in steps for _ in (0, 1)])


CASES = {
    "noisy": lambda r, x: (r.rand(len(x)) < x).astype(float),
    "falling": lambda r, x: 1 - x,
    "rising": lambda r, x: x,
    "steps": lambda r, x: np.floor(x * 7) % 3,
    "ties": lambda r, x: (r.rand(len(x)) < 0.5).astype(float),
}


@pytest.mark.parametrize("kind", CASES)
def test_fit_and_apply(spark, kind):
    r = np.random.RandomState(3)
    rows, want = [], {}
    for h, n in ((1, 1500), (5, 300)):  # one key holds most rows and lies in many ranges
        x = np.round(r.rand(n), 2 if kind == "ties" else 9)
        y = CASES[kind](r, x)
        want[h] = plain(x, y)
        rows += [(h, float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "horizon int, mean double, actual double").repartition(5)
    steps = isotonic_fit(df, parts=13)
    got = {h: sorted((s.lo, s.hi, s.value) for s in steps.filter(f"horizon = {h}").collect()) for h in want}
    for h in want:
        assert np.allclose(got[h], want[h])
    probe = np.concatenate([[-5.0, 0.0, 1.0, 7.0], r.rand(200), [s[0] for s in want[1]][:50]])
    new = spark.createDataFrame([(h, float(p), i) for h in want for i, p in enumerate(probe)], "horizon int, mean double, i int")
    for h in want:
        out = {x.i: x["mean"] for x in isotonic_apply(new, steps).filter(f"horizon = {h}").collect()}
        assert np.allclose([out[i] for i in range(len(probe))], predicted(want[h], probe))


def test_ties_small_keys_and_nulls(spark):
    base = [(1, x, y) for x, y in zip((0.1, 0.2, 0.2, 0.3, 0.4), (0.0, 1.0, 0.0, 0.0, 1.0))]
    rows = base + [(2, 0.5, 1.0)] * 10 + [(3, 0.5, 1.0), (3, 0.6, 0.0)] + [(1, None, 1.0), (1, 0.3, None), (None, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "horizon int, mean double, actual double")
    out = isotonic_calibrate(df, df, min_samples=5)
    got = sorted((r.horizon or 0, r["mean"] if r["mean"] is None else round(r["mean"], 6)) for r in out.filter("mean is not null").collect())
    third = round(1 / 3, 6)
    assert got == sorted([(1, 0.0), (1, third), (1, third), (1, third), (1, third), (1, 1.0)] + [(2, 0.5)] * 10 + [(3, 0.5), (3, 0.6), (0, 0.2)])
    assert out.count() == len(rows) and out.columns == df.columns
    assert isotonic_calibrate(df.filter("false"), df.filter("false")).count() == 0


def test_rows_stay_where_steps_are_few(spark, monkeypatch):
    """Both ways give each row the same value; with few steps the rows are not shuffled."""
    from barloom.operators import isotonic as I

    steps = [(1, 0.1, 0.1, 0.0), (1, 0.3, 0.5, 0.25), (1, 0.6, 0.6, 0.5), (1, 0.8, 0.9, 1.0), (2, 0.5, 0.5, 0.7)]
    s = spark.createDataFrame(steps, "horizon int, lo double, hi double, value double").localCheckpoint()
    xs = [None, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0, float("nan"), -0.5]
    rows = [(i, h, x) for i, (h, x) in enumerate((h, x) for h in (1, 2, 3, None) for x in xs)]
    p = spark.createDataFrame(rows, "id int, horizon int, mean double").localCheckpoint()
    few = I.isotonic_apply(p, s)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "SortMergeJoin" not in plan
    got = sorted(map(str, few.collect()))
    monkeypatch.setattr(I, "STEPS_SENT", 0, raising=False)
    assert got == sorted(map(str, I.isotonic_apply(p, s).collect()))
    line = next(r.mean for r in few.collect() if r.id == 3)
    assert abs(line - 0.125) < 1e-12

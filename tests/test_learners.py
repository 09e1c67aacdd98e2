"""Learners read one stored table."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import models as M

FEATURES, HS = ["a", "b"], (1, 3, 6)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    made = []
    for i in range(400):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        y = [float(a + rnd.gauss(0, 0.5) > 0), None if i % 7 == 0 else float(b > a), 1.0]
        made.append((f"S{i % 4}", i // 4, None if i % 50 == 0 else a, b, *y, *[0.01 * x if x is not None else None for x in y]))
    cols = "ticker string, day int, a double, b double, " + ", ".join(f"target_h{h} double" for h in HS) + ", " + ", ".join(f"lr_h{h} double" for h in HS)
    df = spark.createDataFrame(made, cols)
    return df.withColumn("ts", F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, day)")).drop("day")


def stores(monkeypatch):
    made, plain = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: made.append(df.columns) or plain(df))
    return made


def test_horizons_share_a_stored_table(spark, rows, monkeypatch):
    made = stores(monkeypatch)
    linear = M.learners()["linear"]
    got = M.fit_per_horizon(rows, FEATURES, HS, learner=linear)
    assert sorted(got) == [1, 3] and len(made) == 1
    again = M.fit_per_horizon(rows, FEATURES, HS, learner=linear, stored=True)
    assert len(made) == 1
    for h in got:
        own = M._rows(rows, FEATURES, f"target_h{h}").withColumn("_weight", F.lit(1.0))
        alone = linear.copy().fit(own)
        for m in (got[h], again[h]):
            assert m.coefficients.toArray() == pytest.approx(alone.coefficients.toArray(), rel=1e-6)
            assert m.intercept == pytest.approx(alone.intercept, rel=1e-6, abs=1e-9)


def test_validation_is_stored_once(spark, rows, monkeypatch):
    made = stores(monkeypatch)
    got = M.fit_per_horizon(rows, FEATURES, HS, validation=rows.limit(100), learner=M.boosted(2, 2))
    assert sorted(got) == [1, 3] and len(made) == 2
    assert M.fit_per_horizon(rows.where("false"), FEATURES, HS, learner=M.boosted(2, 2)) == {}


def test_folds_and_meta_models_store_no_copies(spark, rows, monkeypatch):
    made = stores(monkeypatch)
    linear = M.learners()["linear"]
    primary, meta = M.meta_label_pipeline(rows, FEATURES, HS[:2], n_splits=2, learner=linear)
    assert sorted(primary) == [1, 3] and set(meta) <= {1, 3}
    # the folds, their predictions, and the rows with meta targets
    assert len(made) == 3

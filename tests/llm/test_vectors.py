"""The permutation index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import permutation_index, queries


def brute(rows, is_query, k):
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    for q in np.flatnonzero(is_query(ids)):
        s = x @ x[q]
        other = np.flatnonzero(ids != ids[q])
        yield ids[q], [(ids[i], s[i]) for i in other[np.lexsort((ids[other], -s[other]))][:k]]


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = {}
    for r in queries.op1_permutation_index(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, want in brute(rows, lambda i: i % 20 == 0, 20):
        have = sorted(got[q])
        assert [r for r, _, _ in have] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(have, have[1:]))
        hit += len({v for v, _ in want} & {v for _, v, _ in have})
        total += len(want)
    assert hit / total >= 0.9


def test_norms_vary(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.1, 3, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in permutation_index.nearest(df, F.col("id") % 50 == 0, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = dict(brute(df.collect(), lambda i: i % 50 == 0, 10))
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) / (10 * len(want)) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (2, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = permutation_index.nearest(df, F.col("id") % 2 == 0, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (2, 1, 0, 0.5), (2, 2, 1, 0.5)]
    assert permutation_index.nearest(df.where("false"), F.col("id") % 2 == 0).count() == 0
    assert permutation_index.nearest(df.where("vec_id = 0"), F.col("id") % 2 == 0).count() == 0


def test_a_third_of_equal_vectors(spark):
    """The smallest ids of the group stay, and each of its copies is one pivot at most."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    x[rng.permutation(3000)[:1000]] = x[0] = rng.standard_normal(16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in permutation_index.nearest(df, F.col("id") % 50 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    group = np.flatnonzero((x == x[0]).all(1)).tolist()
    asked = [q for q in group if q % 50 == 0]
    assert asked
    for q in asked:
        assert got[q] == [i for i in group if i != q][:20]


def test_pivots_of_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((140, 8)), 20, axis=0)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>")
    assert len(np.unique(permutation_index.pivots_of(v, 10.0), axis=0)) == permutation_index.PIVOTS


def test_one_id_with_two_vectors(spark):
    for order in (1, -1):
        rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.5, 9.0]), (1, [3.0, 1.0])][::order]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
        got = permutation_index.nearest(df, F.col("id") == 0, 20).collect()
        assert [(r.vec_id, r.score) for r in got] == [(1, 0.5)]

"""Hard negatives and collocations against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import collocations, hard_negatives


def plain_negatives(rows):
    least = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        least[i] = min(least.get(i, (v, label)), (v, label))
    q = {i: ([math.floor(256 * x) for x in v], label) for i, (v, label) in least.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in (i for i in q if i % 50 == 0):
        s = sorted((-dot(q[a][0], q[i][0]), i) for i in q if i != a)
        for m, p in [x for x in s if q[x[1]][1] == q[a][1]][:5]:
            fit = [(n, i) for n, i in s if q[i][1] != q[a][1] and -50 * m <= -100 * n <= -95 * m]
            out |= {(a, p, r + 1, i, -m, -n) for r, (n, i) in enumerate(fit[:3])}
    return out


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 300)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    rnd = random.Random(9)
    schema = "vec_id bigint, embedding array<float>, label int, score string, id int"
    for dims, copies in ((2, 0), (6, 400)):
        vector = lambda: [rnd.randrange(-8, 9) / 8 for _ in range(dims)]
        same = vector()
        rows = [(i, list(same) if i < copies else vector(), rnd.randrange(3)) for i in range(1200)]
        rows += [(2000, None, 1), (2050, vector(), None), (2100, [None] * dims, 1), (2150, [float("nan")] * dims, 0), (None, vector(), 1), (2200, [], 0), (2250, vector()[:1], 2), (50, vector(), 1)]
        df = spark.createDataFrame([(*r, "s", 1) for r in rows], schema)
        got = hard_negatives.mine(df, F.col("id") % 50 == 0, F.col("label"))
        assert {tuple(r) for r in got.collect()} == plain_negatives(rows)
    assert hard_negatives.mine(df.where("false"), F.col("id") % 50 == 0, F.col("label")).count() == 0


def test_no_side_of_the_search_is_broadcast(spark, monkeypatch):
    """Dealt blocks are as many as shards times blocks: broadcast, they would all pass through the driver."""
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    plans, over = [], hard_negatives.over_shards

    def seen(*args):
        found = over(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(hard_negatives, "over_shards", seen)
    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(-8, 9) / 8 for _ in range(5)], rnd.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = hard_negatives.mine(df, F.col("id") % 50 == 0, F.col("label"))
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_search_sorts_only_rows_of_a_window(monkeypatch):
    rng = np.random.default_rng(3)
    n, dims = 4096, 64
    x, labels = rng.integers(-64, 65, (n, dims)), rng.integers(0, 4, n)
    lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    shard = hard_negatives.Shard(*(np.ascontiguousarray(a).tobytes() for a in (np.arange(n) * 3, labels, x, lists)))
    sorted_rows = []
    for name in ("sort", "lexsort", "argsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, *more, plain=plain, **kw: sorted_rows.append(np.shape(a)[-1]) or plain(a, *more, **kw))
    for i in range(0, n, 400):
        scores = x @ x[i]
        best = np.partition(scores, -6)[-6:-1]
        eligible = labels != labels[i]
        got = shard.best(x[i], eligible, 50 * best, 95 * best, 3)
        for b, (rows, found) in zip(best, got):
            fit = sorted((-s, r) for r, s in enumerate(scores.tolist()) if eligible[r] and 50 * b <= 100 * s <= 95 * b)[:3]
            assert [(-s, r) for r, s in zip(rows.tolist(), found.tolist())] == fit
    assert sum(sorted_rows) < 11 * n / 2  # half a shard per search; all rows were sorted once a step


def plain_collocations(rows, top):
    f, out = defaultdict(Counter), []
    for lang, text in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        longer = Counter()
        for g, v in c.items():
            if len(g) == 3 and v >= 10:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], v)
        found = []
        for g, a in c.items():
            if len(g) > 1 and a >= 10 and not (len(g) == 2 and longer[g] and 100 * longer[g] >= 50 * a):
                s, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, r, n, -s) for i, (s, a, p, x, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations(spark):
    rnd = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "ünder", "a'b", "x", "\x1c", "é", "long-word" * 30]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", " \x0b", ""]
    rows = []
    for i in range(300):
        lang = rnd.choice(["en", "en", "en", "de", None, "und", ""])
        rows.append((lang, "".join(w + rnd.choice(marks[:-1]) for w in rnd.choices(words, [9, 2, 5, 3, 3, 3, 2, 1, 1, 1, 1, 0.2], k=rnd.randrange(60)))))
    rows += [("en", None), ("en", ""), (None, " .\n"), ("de", "new york city " * 3000), ("en", "the " * 20)] + rows[:5]
    df = spark.createDataFrame([(i, lang, text, "s", 1) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string, phrase string, n int").repartition(3)
    for top in (2000, 7):
        got = collocations.collocations(df, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, top)
    assert collocations.collocations(df.where("false")).count() == 0
    big = collocations.score(*(collocations.np.array([v], "int64") for v in (10**12, 10**12, 3 * 10**12)))
    assert big.tolist() == [333333]

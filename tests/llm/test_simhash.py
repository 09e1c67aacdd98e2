"""Fingerprints and groups against brute force."""

import random

import numpy as np
import xxhash

from barloom.llm import queries, simhash
from barloom.llm.components import components

U64 = (1 << 64) - 1


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, ids):
    """Union of all fingerprints within two bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array(fps, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_groups(fps, [r.doc_id for r in rows]))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_crowds_chains_and_skewed_bits(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = {centre}
    for _ in range(900):  # a crowd around one point, up to six bits away
        x = centre
        for _ in range(rnd.randint(0, 6)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    x = rnd.getrandbits(64)
    for _ in range(60):  # a chain of two-bit steps
        x ^= 3 << rnd.randrange(63)
        fps.add(x)
    half = rnd.getrandbits(32)
    fps |= {(half << 32) | rnd.getrandbits(32) for _ in range(700)}  # one half never differs
    fps |= {rnd.getrandbits(64) for _ in range(700)} | {0, U64, 1 << 63}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    roots = {r.node & U64: r.root & U64 for r in components(simhash.links(df)).collect()}
    want = plain_groups(fps, fps)
    got = {}
    for f, w in zip(fps, want):
        got.setdefault(roots.get(f, f), set()).add(w)
    assert all(len(g) == 1 for g in got.values()) and len(got) == len(set(want))


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(0)
    cost = rng.integers(0, 50, (200, 3, 4)).astype(float)
    t, best = simhash.allocate(cost)
    assert ((t + 1).sum(1) == 3).all()
    every = [(a, b, 3 - a - b) for a in range(4) for b in range(4 - a)]
    want = np.min([cost[:, 0, a] + cost[:, 1, b] + cost[:, 2, c] for a, b, c in every], 0)
    assert np.allclose(best, want)
    assert np.allclose(sum(cost[np.arange(200), i, t[:, i] + 1] for i in range(3)), want)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, " \n\t"), (None, "a b"), (7, "A B"), (8, "a b"), (2, long), (1, long), (4, "one"), (4, "two words here now"), (6, "é Ü x y")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, fp string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.groups(df).collect()}
    fp = {t: (f - (1 << 64) if (f := plain_fingerprint(t)) >> 63 else f) for _, t in rows}
    assert len(got) == len(rows)
    assert [got[i, 0] for i in (5, 3, 9)] == [3, 3, 3]
    assert got[7, fp["a b"]] == got[8, fp["a b"]] == got[None, fp["a b"]] == 7
    assert got[1, fp[long]] == got[2, fp[long]] == 1
    assert simhash.groups(df.where("false")).count() == 0

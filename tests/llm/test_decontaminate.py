"""Decontamination against a brute-force scan of all windows."""

import random
from collections import Counter

from barloom.llm import decontaminate, queries


def grams(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.lower().split(" ") if w]


def brute(docs, items):
    """doc -> {item: best similarity} over all item-sized windows."""
    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            if not v:
                continue
            k = min(5, len(v))
            a, b = grams(w, k), Counter(grams(v, k))
            n = sum(b.values())
            if not set(a) & set(b):
                continue
            best = 0.0
            for s in range(max(1, len(a) - n + 1)):
                c = Counter(a[s : s + n])
                both = sum((b & c).values())
                best = max(best, both / (n + sum(c.values()) - both))
            if best >= 0.8:
                out.setdefault(d, {})[i] = best
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = queries.op8_decontaminate(spark, sf).collect()
    assert len(got) == len(docs) and want
    for r in got:
        have = want.get(r.doc_id, {})
        assert (r.contaminated, r.n_items) == (bool(have), len(have))
        if have:
            assert abs(r.similarity - max(have.values())) < 1e-12
            assert r.item_id == min(i for i, s in have.items() if s == max(have.values()))


def test_edits_edges_and_short_items(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([3, 5, 6, 7, 9, 14, 30, 60, 60, 200])]
    items += [(20, items[6][1]), (21, None), (22, "  "), (23, " ".join(["a b"] * 15))]
    docs = []
    for k in range(120):
        _, item = rnd.choice([x for x in items if x[1] and x[1].strip()])
        piece = item.split(" ")
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            piece[rnd.randrange(len(piece))] = rnd.choice(words)
        if rnd.random() < 0.2:
            piece = piece[: int(len(piece) * 0.9)]
        docs.append((k, " ".join(text(rnd.choice([0, 3, 200])) + piece + text(rnd.choice([0, 3, 200]))).upper()))
    docs += [(200, None), (201, ""), (None, items[6][1]), (202, items[8][1]), (202, items[8][1]), (203, ("\n" + items[9][1]) * 40)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, similarity int")
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id bigint, text string, n double")
    want = brute(enumerate(t for _, t in docs), [x for x in items if x[0] != 20])
    got = {}
    for r in decontaminate.marked(df, bench, ["doc_id", "similarity"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[202]) == 2
    for k, (d, _) in enumerate(docs):
        have, r = want.get(k, {}), got[d][0]
        assert (r.contaminated, r.n_items) == (bool(have), len(have))
        if have:
            assert abs(r.similarity - max(have.values())) < 1e-12
    assert decontaminate.marked(df, bench.where("false"), ["doc_id"]).where("contaminated").count() == 0
    assert decontaminate.marked(df.where("false"), bench, ["doc_id"]).count() == 0


def test_blocks_meet_all_within_the_radius(spark):
    rnd = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, 7, rnd.getrandbits(64)) for i in range(40)]
    prints = {rnd.getrandbits(64) for _ in range(200)}
    for _, _, fp in items:
        for d in (0, 1, 22, 23, 24, 30):
            prints.add(fp ^ sum(1 << b for b in rnd.sample(range(64), d)))
    want = {(signed(f), i) for f in prints for i, _, fp in items if (f ^ fp).bit_count() <= decontaminate.RADIUS}
    windows = spark.createDataFrame([(7, signed(f)) for f in prints] * 2 + [(8, signed(items[0][2]))], "n int, fp bigint")
    made = spark.createDataFrame([(i, n, signed(f)) for i, n, f in items], "item bigint, n int, fp bigint")
    got = [(r.fp, r.item) for r in decontaminate.met(windows, made).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fingerprints_are_majority_bits(spark):
    rnd = random.Random(6)
    rows = [(k, [rnd.getrandbits(64) - (1 << 63) for _ in range(k)]) for k in (1, 2, 3, 8, 61)]
    df = spark.createDataFrame(rows, "k int, grams array<bigint>")
    for r in df.select("k", "grams", decontaminate.fingerprint(df.grams).alias("fp")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in r.grams) > r.k)
        assert r.fp % (1 << 64) == want


def test_no_window_at_the_bound_is_lost(spark):
    """Copies of items with edits down to 0.8, whatever the distance of their fingerprints."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, [rnd.choice(words) for _ in range(n)]) for i, n in enumerate([13, 22, 31, 40, 60, 100])]
    docs, want = [], {}
    for k in range(1500):
        i, item = items[k % len(items)]
        n, piece = len(item) - 4, list(item)
        cut = max(c for c in range(n) if 5 * (n - c) >= 4 * (n + c))  # shingles that may differ
        if rnd.random() < 0.5:  # new words at one end, each takes one shingle
            piece[len(piece) - cut :] = [f"x{k}.{j}" for j in range(cut)]
        else:
            piece[:cut] = [f"x{k}.{j}" for j in range(cut)]
        docs.append((k, " ".join([f"y{k}.{j}" for j in range(20)] + piece + [f"z{k}.{j}" for j in range(20)])))
        want[k] = i
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.marked(df, bench, ["doc_id"]).where("contaminated").collect()}
    assert got == want

"""Line dedup: the filters, reversible counts, and results against a plain count."""

import hashlib
from collections import Counter

import numpy as np

from barloom.llm import line_dedup, queries
from barloom.llm.line_dedup import Cuckoo, LineIndex

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def plain(rows, least=10):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        yield d, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    f = Cuckoo.of(keys[:50_000])
    assert f.contains(keys[:50_000]).all() and f.contains(keys[50_000:]).mean() < 0.01
    f.delete(keys[:25_000])
    assert f.contains(keys[25_000:50_000]).all() and f.contains(keys[:25_000]).mean() < 0.01
    again = Cuckoo.load(f.dump())
    assert again.insert(keys[:25_000]) and again.contains(keys[:50_000]).all()
    assert (again.slots != 0).sum() == 50_000
    assert not Cuckoo(4).insert(keys[:100])
    same = np.full(8, keys[0])
    assert Cuckoo(16).insert(same)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(rows)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op4_line_dedup(spark, sf).collect()}
    assert got == want and any(k for _, k, _ in want.values())


def refs(index):
    return sorted((bytes(r.key), r.n_docs) for r in index.refs.collect())


def sound(index):
    """Every key is in the filter of its shard, and filters hold as many prints as there are keys."""
    made = {r.shard: Cuckoo.load(bytes(r["filter"])) for r in index.filters.collect()}
    by_shard = {}
    for r in index.refs.collect():
        by_shard.setdefault(r.shard, []).append(bytes(r.key))
    for s, ks in by_shard.items():
        assert made[s].contains(line_dedup.words(ks)).all()
    assert sum(int((f.slots != 0).sum()) for f in made.values()) == sum(map(len, by_shard.values()))


def test_insertions_and_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    first = LineIndex.build(a)
    assert first.shards > 1
    both = first.insert(b)
    sound(first)
    sound(both)
    assert refs(both) == refs(LineIndex.build(docs))
    back = both.delete(b)
    sound(back)
    assert refs(back) == refs(first)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in both.drop_lines(docs, ["doc_id"], 3).collect()}
    assert got == {d: (n, k, t) for d, n, k, t in plain(rows, 3)}
    # beyond the broadcast bound all line keys are shuffled, with the same result
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in both.drop_lines(docs, ["doc_id"], 3).collect()} == got


def test_edges(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, "\n \n", 0), (None, "Same \t", 0), (4, "sAME", 0), (5, "same\nÄ\nä\nx", 0), (6, long, 0), (6, long, 0), (7, "x\x1c\nx", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in LineIndex.build(df).drop_lines(df, ["doc_id", "n_lines"], 2).collect())
    want = sorted((str(d), n, k, t) for d, n, k, t in plain([(d, t) for d, t, _ in rows], 2))
    assert got == want
    none = df.where("false")
    assert LineIndex.build(none).drop_lines(none, ["doc_id"]).count() == 0

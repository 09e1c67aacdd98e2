"""Held-out accuracy and edge cases of the trained classifiers."""

import zlib

import pytest

from barloom.llm import queries


# toxic labels of junk texts (quality 0) are drawn without a word that shows it, so they are left out
@pytest.mark.parametrize("name,label,where,ones,zeros", [
    ("op7_quality", "quality", "true", 0.97, 0.93), ("op2_toxicity", "toxic", "quality = 1", 0.85, 0.95),
])
def test_held_out_accuracy(spark, name, label, where, ones, zeros):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    known = spark.read.parquet(f"{sf}/labels.parquet").where(where).collect()
    held = [(got[r.doc_id].predicted, r[label]) for r in known if got[r.doc_id].held_out]
    share = lambda y: sum(p == y for p, have in held if have == y) / sum(have == y for _, have in held)
    assert share(1) >= ones and share(0) >= zeros


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_edges(spark, module):
    import importlib

    m = importlib.import_module(f"barloom.llm.{module}")
    docs = spark.createDataFrame(
        [(1, None, "s"), (2, "", "s"), (None, "a b c", None), (4, "w" * 50000, "s"), (5, "x y", "s"), (5, "x y", "s"), (6, "idiot " * 5000, "s")],
        "doc_id bigint, text string, score string",
    )
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 1), (5, 0, 0), (5, 0, 0), (6, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = m.train(docs, labels)
    got = m.score(docs, model, ["doc_id", "score"])
    assert got.columns == ["doc_id", "score"] and got.count() == 7
    assert all(0 <= r.score <= 1 for r in got.collect())
    pair = [r.score for r in got.where("doc_id = 5").collect()]
    assert abs(pair[0] - pair[1]) < 1e-6  # rows of a matrix product differ in the last bits
    assert m.score(docs, m.train(docs, labels.where("false")), ["doc_id"]).where("score = 0.5").count() == 7
    assert m.score(docs.where("false"), model, ["doc_id"]).count() == 0

"""The pipeline against plain versions of its stages, stage by stage on what each one gets."""

from collections import Counter

import sentencepiece

import corpus_pipeline as cp
from barloom.llm import quality
from barloom.llm.common import tokenizer_file
from test_decontaminate import brute
from test_near_copies import brute as plain_components

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACE))
    held = Counter(k for t in rows.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    return {d: "\n".join(x for x in (t or "").split("\n") if held[key(x)] < 10) for d, t in rows.items()}


def test_run_equals_the_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    order = sorted(texts)
    scores = quality.vote(model, [(texts[d] or "").encode() for d in order])
    kept = {d: texts[d] for d, s in zip(order, scores) if s >= 0.3}
    assert len(kept) < len(texts)
    lines = plain_lines(kept)
    ids = sorted(lines)
    groups = plain_components([(d, lines[d]) for d in ids])
    single = {d: lines[d] for d, g in groups.items() if d == g}
    assert len(single) < len(lines)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute(single.items(), items)
    clean = {d: t for d, t in single.items() if d not in leaks}
    assert len(clean) < len(single)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert got.keys() == clean.keys()
    for d, t in clean.items():
        want = sp.encode(t)
        assert got[d].ids == want and got[d].n_tokens == len(want) and got[d].decoded == sp.decode(want)


def test_stages_keep_odd_columns(spark):
    """Columns named like the operators' own keep their values, through every stage and whatever they hold."""
    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = "score string, row int, n_lines map<string,int>, __row bigint, __rest int, __text string, __gone int, node int, n int, root int, key string, ids int, fp int, component_id int"
    names = [c.split()[0] for c in extra.split(", ")]
    values = ("s", 1, {"a": 1}, 7, 3, "t", 4, 5, 6, 7, "k", 8, 9, 10)
    odd = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *values) for r in real.collect()]
    plain = (odd[1][1] or "x") + " clean"
    none = (None,) * len(names)
    odd += [(None, None, None, None, None, *none), (10**6, "", "en", None, 0, *values), (10**6 + 1, plain, "en", "s", 5, *none)] * 2
    docs = spark.createDataFrame(odd, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    given = {repr({c: r[c] for c in docs.columns if c not in ("text", "n_chars")}) for r in docs.collect()}
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {repr({c: r[c] for c in out.columns if c not in ("text", "n_chars")}) for r in out.collect()} <= given
        assert stage(spark, docs.where("false"), sf).count() == 0
    last = cp.STAGES[-1][1]
    assert last(spark, docs, sf).count() == len(odd) and last(spark, docs.where("false"), sf).count() == 0


def test_one_row_of_a_repeated_document_stays(spark):
    """Of rows of one id and text the same one stays, however they are dealt."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, f"v{i}") for i in range(20)] + [(1, text + " more", "a"), (2, text, "b"), (None, text, "c"), (None, "other words stand here alone", "z")]
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, __row string").repartition(n)
        got = {tuple(r) for r in cp.drop_copies(spark, docs, "").collect()}
        assert len(got) == 2 and (None, "other words stand here alone", "z") in got
        first = got if n == 1 else first
        assert got == first

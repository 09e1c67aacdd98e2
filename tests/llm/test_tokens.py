"""Piece encoding and Arrow id files against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import arrow_ids, pieces
from barloom.llm.common import tokenizer_file

HARD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "  a   b  ", "\n", "a\n b\t c", "▁", "a▁b ▁ c", "é à ▁▁ x", "日本 語 text", "🙂 smile 🙂🙂",
    "It's they'll WE'RE DON'T x's 's 'll", "foo, bar. baz!! (qux) \"x\" a1b2 12,345.6 %%% th%%% a&&&", "<|endoftext|> x<|ENDOFTEXT|>y <|startoftext|>",
    "x" * 3000, "word " * 2000, "Σίσυφος ΣΑΣ É é", "a b c \u0085 d", "<s> </s> <unk> <0x0A>", "a\x0bb\x0cc\x1cd", "naïve café déjà-vu l'été",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    hard = spark.createDataFrame([(10**6 + i, t, i) for i, t in enumerate(HARD)], "doc_id bigint, text string, n_tokens int")
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("n_tokens"))
    return hard.union(real)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pieces.digests(docs, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids), texts[r.doc_id][:80]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), texts[r.doc_id][:80]
    for r in pieces.encode(docs, ["doc_id", "n_tokens"]).where("doc_id >= 1000000").collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(r.ids)


def test_arrow_ids_equal_the_library(docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file(arrow_ids.TOKENIZER))
    folder, index = arrow_ids.write(docs, folder=str(tmp_path / "ids"), length=64)
    got = {r.doc_id: r for r in arrow_ids.read(folder, index).collect()}
    start, stream = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        have = got[r.doc_id]
        assert (have.start, have.n_tokens) == (start, len(ids)), (r.text or "")[:80]
        assert have.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), (r.text or "")[:80]
        start += len(ids)
        stream += ids
    flat = []
    for p in sorted((tmp_path / "ids").glob("*.arrow")):
        f = arrow_ids.SequenceFile(folder, p.name)
        for k in range(len(f)):
            ids, mask = f[k]
            assert len(ids) == 64 and not ids.flags.owndata
            flat += ids[mask.to_numpy(zero_copy_only=False)].tolist()
    assert flat == stream


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, "b"), (None, "a"), (3, "x y"), (3, "x y"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = arrow_ids.read(*arrow_ids.write(df)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (None, 2, 2), (2, 4, 1), (3, 5, 3), (3, 8, 3)]
    none = df.where("false")
    assert arrow_ids.read(*arrow_ids.write(none)).count() == 0
    assert pieces.digests(none, ["doc_id"]).count() == 0

"""Base scores against a plain count, gradients against differences, likelihoods against a step-by-step walk."""

import math
import zlib
from collections import Counter

import numpy as np

from barloom.llm import language_model as lm
from barloom.llm import queries


def plain(rows):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    c = Counter()
    for d, t in rows:
        if fold(d):
            c.update(lm.tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        ws = lm.tokens((t or "").encode())
        yield d, fold(d) == 0, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)


def test_whole_table_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op6_language_model(spark, sf).collect()}
    model = base = 0.0
    for d, held, n, known, total, score in plain(rows):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
        if held:
            model, base = model + r.score, base + score
    assert model > base


def small(n=150):
    words = lm.Words([b"", *(f"w{i}".encode() for i in range(n))], [40, *range(n, 0, -1)], 20_000, n + 60)
    p = lm.initial(words)
    rng = np.random.default_rng(4)
    return words, {k: (v + 0.1 * rng.standard_normal(v.shape) * (v > -1e8)).astype(np.float32) for k, v in p.items()}, rng


def walk(p, sym):
    """One document, one step at a time."""
    h, out, k = np.zeros(lm.HIDDEN), 0.0, lm.HIDDEN
    for s in sym:
        x = h @ p["cw"] + p["cb"]
        x = x - np.log(np.exp(x).sum())
        c = (s - 1) // lm.CLASS + 1 if s else 0
        out += x[c]
        if s:
            y = h @ p["ow"][c - 1] + p["ob"][c - 1]
            out += y[(s - 1) % lm.CLASS] - np.log(np.exp(y).sum())
        g = p["emb"][s] @ p["w"] + p["b"]
        zr = 1 / (1 + np.exp(-(g[: 2 * k] + h @ p["u"][:, : 2 * k])))
        c = np.tanh(g[2 * k :] + (zr[k:] * h) @ p["u"][:, 2 * k :])
        h = h + zr[:k] * (c - h)
    return out


def test_state_is_carried_over_whole_documents():
    _, p, rng = small()
    docs = [rng.integers(0, 152, n).astype(np.int32) for n in (1, 700, 33, 32, 64, 5, 90, 1, 257)]
    want = [walk({k: v.astype(float) for k, v in p.items()}, d) for d in docs]
    for lanes in (1, 3, 512):
        assert np.allclose(lm.score(p, docs, lanes), want, rtol=1e-4)


def test_long_documents_go_on_beside_the_next(monkeypatch):
    _, p, rng = small()
    exact = {k: v.astype(float) for k, v in p.items()}
    blocks = []
    plain_states = lm.states

    def spy(p, gates, sym, *more):
        blocks.append(sym.shape)
        return plain_states(p, gates, sym, *more)

    monkeypatch.setattr(lm, "states", spy)
    for most in (lm.BUFFER, 500):
        monkeypatch.setattr(lm, "BUFFER", most)
        scorer, waiting, got = lm.Scorer(p, 8), [], []
        parts = [[rng.integers(0, 152, n).astype(np.int32) for n in [900, *rng.integers(1, 60, 40)]] for _ in range(4)] + [[]]
        blocks.clear()
        for i, part in enumerate(parts):
            waiting += part
            sums, left = scorer.run(part, last=i == 4)
            got += [(waiting[k], sums[k]) for k in range(len(waiting)) if k not in set(left.tolist())]
            waiting = [waiting[k] for k in left]
        assert not waiting and len(got) == 164
        assert np.allclose([x for _, x in got], [walk(exact, d) for d, _ in got], rtol=1e-4)
        if most > 500:  # all four long ones at once, where each ran on alone before
            assert sum(steps for steps, _ in blocks) < 2 * 900
    t = lm.Trainer(p)
    for part in parts:
        t.train(part, last=not part)
    assert t.seen == sum(map(len, sum(parts, []))) and not t.lanes.left


def test_probabilities_sum_to_one():
    words, p, rng = small()
    s = rng.standard_normal((3, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm.likelihood(p, s, np.full(3, k))) for k in range(words.short + 1))
    assert np.allclose(total, 1, atol=1e-4)
    rest = 10 ** words.rest[words.short :]
    assert rest.sum() < 1


def test_gradients():
    _, p, rng = small(70)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    lm_f4, lm.F4 = lm.F4, np.float64
    try:
        docs = [rng.integers(0, 72, n).astype(np.int32) for n in (20, 9, 30)]
        sym, doc, start, size = lm.lay(docs, 2)
        sym, doc, start = sym[:24], doc[:24], start[:24]
        got = {}

        class Spy(lm.Trainer):
            def __init__(self, p):
                super().__init__(p)
                self.m = {k: [np.zeros_like(v), np.full_like(v, 1e12)] for k, v in p.items()}

        t = Spy(p)
        h = np.zeros((2, lm.HIDDEN))
        t.window(sym, doc, start, h)
        got = {k: t.m[k][0] * 10 for k in p}

        def loss(q):
            s, _ = lm.states(q, q["emb"] @ q["w"] + q["b"], sym, start, h)
            real = doc.ravel() >= 0
            return -lm.likelihood(q, s.reshape(-1, lm.HIDDEN)[real], sym.ravel()[real]).mean()

        for k in p:
            for _ in range(6):
                i = tuple(rng.integers(0, n) for n in p[k].shape)
                if p[k][i] < -1e8:
                    continue
                up, down = ({**p, k: p[k].copy()} for _ in range(2))
                up[k][i] += 1e-5
                down[k][i] -= 1e-5
                assert abs((loss(up) - loss(down)) / 2e-5 - got[k][i]) < 1e-6, k
    finally:
        lm.F4 = lm_f4


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a a\tb"), (None, "a é É"), (5, "z " * 40_000), (6, "q"), (6, "q"), (10, "new words here")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id bigint, text string, n int")
    got = sorted((lm.scores(df).collect()), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(plain(rows), key=lambda r: (str(r[0]), r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)
    assert lm.scores(df.where("false")).count() == 0


def test_training_sees_every_token(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(i % 40 + 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, averaged = [], lm.averaged

    def spy(copies, like):
        seen.append(sum(r.seen for r in copies.collect()))
        return averaged(copies, like)

    monkeypatch.setattr(lm, "averaged", spy)
    lm.train(df, lm.frequent(lm.counts(lm.train_rows(df))))
    assert sum(seen) == next(plain(rows))[4]


def test_whole_texts_are_looked_up_as_words_are():
    from barloom.llm import language_model as lm

    words = lm.Words([b"", *[b"w%d" % i for i in range(lm.SHORT + 5)]], [1] * (lm.SHORT + 6), lm.SHORT + 6, lm.SHORT + 6)
    texts = [b"W1 w2 unseen", b"", None, b"w%d w%d" % (lm.SHORT - 2, lm.SHORT)]
    got = words.texts(texts)
    assert [x.tolist() for x in got] == [words.symbols(words.ids(lm.tokens(t or b""))).tolist() for t in texts]

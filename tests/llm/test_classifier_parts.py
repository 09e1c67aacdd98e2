"""The quality vote and the toxicity network against plain versions of themselves."""

import numpy as np
import pytest

from barloom.llm import quality, toxicity


def plain_vote(model, text):
    z = quality.damped(quality.counts(text), model["idf"]).astype(float) @ model["axes"].astype(float)
    z /= np.linalg.norm(z)
    near = sorted((-round(float(z @ v) * quality.STEPS), i) for i, v in enumerate(model["z"].astype(float)))[: quality.NEIGHBOURS]
    w = [max(-s / quality.STEPS, 1e-6) ** quality.POWER for s, _ in near]
    return sum(a * model["y"][i] for a, (_, i) in zip(w, near)) / sum(w)


def test_vote_equals_a_plain_one():
    r = np.random.default_rng(5)
    words = [bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[i] for i in r.integers(0, 300, r.integers(3, 200))) for _ in range(400)]
    model = quality.fit(texts[:200], list(r.integers(0, 2, 200)))
    got = quality.vote(model, texts)
    np.testing.assert_allclose(got, [plain_vote(model, t) for t in texts], atol=2e-3)
    # a vote only moves by more than rounding where two neighbours change places on a step
    assert np.mean(np.abs(got - [plain_vote(model, t) for t in texts]) < 1e-4) > 0.97


def test_equal_neighbours_rank_by_place():
    labels = [1] * 15 + [0] * 46
    model = quality.fit([b"one text of all rows"] * 61, labels)
    assert quality.vote(model, [b"one text of all rows"] * 300) == pytest.approx(np.ones(300))
    model = quality.fit([b"one text of all rows"] * 61, labels[::-1])
    assert quality.vote(model, [b"one text of all rows"] * 3) == pytest.approx(np.zeros(3))


def plain_logit(p, vocab, words):
    """One window, step by step in double precision."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, x = toxicity.HIDDEN, []
    for w in words:
        b = b"^" + w + b"$"
        ids = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(b) - 2)]
        x.append(np.concatenate([p["word"][vocab.get(w, 0)], np.mean([p["char"][i] for i in ids], axis=0)]))
    states = []
    for side in "fb":
        w, u, c, s, out = p[f"w{side}"], p[f"u{side}"], p[f"c{side}"], np.zeros(h), {}
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            z = sig(x[t] @ w[:, :h] + c[:h] + s @ u[:, :h])
            r = sig(x[t] @ w[:, h : 2 * h] + c[h : 2 * h] + s @ u[:, h : 2 * h])
            s = out[t] = s + z * (np.tanh(x[t] @ w[:, 2 * h :] + c[2 * h :] + (r * s) @ u[:, 2 * h :]) - s)
        states.append(np.array([out[t] for t in range(len(x))]))
    s = np.concatenate(states, 1)
    e = np.exp(s @ p["att"])
    return float((e / e.sum()) @ s @ p["out"] + p["bias"][0])


def network(seed=2):
    vocab = {w: i + 1 for i, w in enumerate([b"red", b"green", b"blue", b"a"])}
    p = toxicity.initial(len(vocab), np.random.default_rng(seed))
    p["bias"][:] = 0.3
    return {"p": p, "vocab": vocab, "prior": 0.4, "calibration": (1.0, 0.0)}


def test_scores_walk_every_window():
    r, model = np.random.default_rng(4), network()
    pool = [b"red", b"green", b"blue", b"a", b"violet", b"x1", "für".encode()]
    texts = [[pool[i] for i in r.integers(0, 7, n)] for n in (1, 5, 31, 32, 33, 48, 49, 200)] + [[]]
    logit, owner, win = toxicity.Scorer(model).logits(texts)
    joined = [w for t in texts for w in t]
    p = {k: v.astype(float) for k, v in model["p"].items()}
    plain = [plain_logit(p, model["vocab"], [joined[j] for j in row if j >= 0]) for row in win]
    np.testing.assert_allclose(logit, plain, atol=2e-5)
    base = np.cumsum([0, *map(len, texts)])
    for k, t in enumerate(texts):
        first = [int(row[0] - base[k]) for row in win[owner == k]]
        assert first == (toxicity.starts(len(t)) if t else [])
        assert {int(j - base[k]) for row in win[owner == k] for j in row if j >= 0} == set(range(len(t)))
    got = toxicity.Scorer(model).scores([b" ".join(t) for t in texts])
    best = [max((x for x, o in zip(plain, owner) if o == k), default=None) for k in range(len(texts))]
    np.testing.assert_allclose(got, [model["prior"] if b is None else 1 / (1 + np.exp(-b)) for b in best], atol=1e-5)


def test_gradients_by_finite_differences():
    model = network()
    words = [b"red", b"blue", b"violet", b"x1"]
    win = np.array([[0, 1, 2, 0, 3], [2, 2, 1, -1, -1], [3, -1, -1, -1, -1]])
    y, weight = np.array([1, 0, 1], np.float32), np.array([0.5, 1.5, 1.0], np.float32)
    vid = np.array([model["vocab"].get(w, 0) for w in words])
    got = toxicity.gradients(model["p"], vid, *toxicity.trigrams(words), win, y, weight)

    def loss(p):
        x = np.array([plain_logit(p, model["vocab"], [words[j] for j in row if j >= 0]) for row in win])
        return float((weight * (np.log1p(np.exp(x)) - y * x)).sum() / 3)

    base = {k: v.astype(float) for k, v in model["p"].items()}
    for name in base:
        size = np.linalg.norm(got[name])
        assert size > 0
        r = np.random.default_rng(1)
        for way in (got[name] / size, r.standard_normal(base[name].shape) / base[name].size ** 0.5):
            ends = [loss(base | {name: base[name] + e * way}) for e in (1e-4, -1e-4)]
            assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(float((got[name] * way).sum()), rel=1e-3, abs=2e-6), name

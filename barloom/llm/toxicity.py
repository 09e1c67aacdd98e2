"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A token is a word of letters and digits, ASCII in lower case. Its input joins a word vector
(words in at least ``MIN_DOCS`` fit documents, one shared vector for others) and the mean
vector of its hashed character trigrams. Two recurrent passes of ``HIDDEN`` units read each
window of ``WINDOW`` tokens; attention weights pool the states into one logit. All windows
at stride ``STRIDE`` overlap by half and the last one ends with the text, so every token
of the text is read. A document's score is the calibrated logit of its most toxic window.

Labels mark documents, so training starts with every window of a toxic document as
positive, then keeps of each toxic document the windows that the network itself finds
toxic. The fit sample holds at most ``FIT_ROWS`` labelled rows and 24 MB of whole texts
outside the held-out fold (a documented bound); it is trained on the driver and the weights (under 2 MB) are
broadcast. An epoch trains on at most ``EPOCH_TOXIC`` toxic windows of the sample and on as many clean ones as there are toxic ones in it, or
``EPOCH_CLEAN`` where there are fewer toxic ones; all are drawn anew each epoch. These bounds are part of the bound of the label
sample and touch no scored text. Scoring is one Arrow pass without a shuffle over all windows of all texts, ``CHUNK`` at a
time; a worker holds the windows of one batch, which is 4 MB of texts or one longer text.

Null and empty texts, or texts without words, get the share of label 1 in the fit sample;
without labels of the fit fold every score is 0.5 and predicted is 1. Repeated rows score
alike up to single precision; rows of null doc_id are scored and never train.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from barloom.llm.common import add_columns
from barloom.llm.quality import sample

WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORD_DIM, CHAR_DIM, CHARS = 8, 8, 4096
MIN_DOCS, MAX_WORDS = 4, 8000
FIT_ROWS, EPOCHS, BATCH, RATE = 4000, 5, 256, 0.005
EPOCH_TOXIC, EPOCH_CLEAN = 12_000, 6000
CHUNK = 2048
_KEEP = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()
F4 = np.float32


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of ``^word$`` of all words, and the start of each word's run."""
    b = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    h = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
    inside = np.ones(len(b), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return h[inside[:-2]].astype(np.int64), np.concatenate([[0], np.cumsum(size - 2)[:-1]])


def starts(n: int) -> list[int]:
    """First tokens of the windows that cover ``n`` tokens."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the joined tokens (-1: padding) of all windows, and the text of each."""
    rows, owner, base = [], [], 0
    for k, n in enumerate(lengths):
        if n:
            s = np.asarray(starts(n))[:, None] + np.arange(WINDOW)
            rows.append(np.where(s < n, s + base, -1))
            owner += [k] * len(s)
        base += n
    return (np.concatenate(rows) if rows else np.zeros((0, WINDOW), int)), np.asarray(owner, int)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(F4)
    p = {"word": 0.3 * rng.standard_normal((n_words + 1, WORD_DIM)), "char": 0.3 * rng.standard_normal((CHARS, CHAR_DIM))}
    for side in "fb":
        p |= {f"w{side}": draw(d, 3 * h), f"u{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h)}
    p |= {"att": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1)}
    return {k: np.ascontiguousarray(v, F4) for k, v in p.items()}


def recur(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States of one direction. gates: (time, n, 3H) inputs of update, reset, candidate."""
    h = HIDDEN
    t_n, n, _ = gates.shape
    state, out = np.zeros((n, h), F4), np.empty((t_n, n, h), F4)
    for t in range(t_n - 1, -1, -1) if back else range(t_n):
        zr = sigmoid(gates[t, :, : 2 * h] + state @ u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        rs = r * state
        c = np.tanh(gates[t, :, 2 * h :] + rs @ u[:, 2 * h :])
        m = mask[t][:, None]
        new = state + m * z * (c - state)
        if keep is not None:
            keep.append((t, state, z, r, rs, c, m))
        state = out[t] = new
    return out


def pooled(p: dict, states: np.ndarray, mask: np.ndarray):
    """Attention over time: logits of the windows and the weights."""
    e = states @ p["att"] + np.where(mask > 0, 0, -1e9).astype(F4)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    v = (a[:, :, None] * states).sum(0)
    return v @ p["out"] + p["bias"][0], a, v


def gradients(p: dict, vid: np.ndarray, tri: np.ndarray, at: np.ndarray, win: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Backward pass of the weighted logistic loss of a batch of windows.

    vid, (tri, at): word and trigram ids of the distinct words; win: (n, time) distinct word or -1.
    """
    h, n = HIDDEN, len(win)
    size = np.diff(np.append(at, len(tri)))
    word_of = np.repeat(np.arange(len(at)), size)
    x = np.concatenate([p["word"][vid], np.add.reduceat(p["char"][tri], at, axis=0) / size[:, None]], 1).astype(F4)
    mask = (win.T >= 0).astype(F4)
    idx = np.maximum(win.T, 0)
    g, kept, states = {}, {}, []
    for side in "fb":
        gates = (x @ p[f"w{side}"] + p[f"c{side}"])[idx]
        kept[side] = []
        states.append(recur(gates, p[f"u{side}"], mask, side == "b", kept[side]))
    s = np.concatenate(states, 2)
    logit, a, v = pooled(p, s, mask)
    d_logit = ((sigmoid(logit) - y) * weight / n).astype(F4)
    g["bias"], g["out"] = np.array([d_logit.sum()]), v.T @ d_logit
    dv = d_logit[:, None] * p["out"]
    da = (s * dv).sum(2)
    de = a * (da - (a * da).sum(0))
    g["att"] = np.einsum("tn,tnh->h", de, s)
    ds = a[:, :, None] * dv + de[:, :, None] * p["att"]
    dx = np.zeros_like(x)
    for k, side in enumerate("fb"):
        u, carry = p[f"u{side}"], np.zeros((n, h), F4)
        du, dg = np.zeros_like(u), np.zeros((len(mask), n, 3 * h), F4)
        for t, state, z, r, rs, c, m in reversed(kept[side]):
            d = (ds[t, :, k * h : (k + 1) * h] + carry) * m
            carry = (ds[t, :, k * h : (k + 1) * h] + carry) * (1 - m)
            dc = d * z * (1 - c * c)
            drs = dc @ u[:, 2 * h :].T
            dz, dr = d * (c - state) * z * (1 - z), drs * state * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            du[:, 2 * h :] += rs.T @ dc
            du[:, : 2 * h] += state.T @ dzr
            carry = carry + d * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
            dg[t] = np.concatenate([dzr, dc], 1)
        flat, where = dg.reshape(-1, 3 * h), idx.ravel()
        per_word = np.zeros((len(x), 3 * h), F4)
        np.add.at(per_word, where, flat)
        g[f"u{side}"], g[f"w{side}"], g[f"c{side}"] = du, x.T @ per_word, per_word.sum(0)
        dx += per_word @ p[f"w{side}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], vid, dx[:, :WORD_DIM])
    np.add.at(g["char"], tri, (dx[:, WORD_DIM:] / size[:, None])[word_of])
    return g


class Scorer:
    """Weights with the input products of both directions worked out."""

    def __init__(self, model: dict):
        self.m, p = model, model["p"]
        self.word = np.concatenate([p["word"] @ p[f"w{s}"][:WORD_DIM] + p[f"c{s}"] for s in "fb"], 1)
        self.char = np.concatenate([p["char"] @ p[f"w{s}"][WORD_DIM:] for s in "fb"], 1)

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit and text of every window, and the windows as indexes of tokens."""
        lengths = [len(t) for t in texts]
        win, owner = windows(lengths)
        if not len(win):
            return np.zeros(0, F4), owner, win
        words = list(dict.fromkeys(chain.from_iterable(texts)))
        place = dict(zip(words, range(len(words))))
        tok = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int64, sum(lengths))
        vocab = self.m["vocab"]
        gates = self.word[np.fromiter((vocab.get(w, 0) for w in words), np.int64, len(words))]
        for i in range(0, len(words), 4096):
            tri, at = trigrams(words[i : i + 4096])
            size = np.diff(np.append(at, len(tri)))[:, None]
            gates[i : i + 4096] += np.add.reduceat(self.char[tri], at, axis=0) / size
        out, p, h3 = np.empty(len(win), F4), self.m["p"], 3 * HIDDEN
        for i in range(0, len(win), CHUNK):
            w = win[i : i + CHUNK].T
            mask = (w >= 0).astype(F4)
            g = gates[tok[np.maximum(w, 0)]]
            s = np.concatenate([recur(g[:, :, :h3], p["uf"], mask, False), recur(g[:, :, h3:], p["ub"], mask, True)], 2)
            out[i : i + CHUNK] = pooled(p, s, mask)[0]
        return out, owner, win

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.m["p"] is None:
            return np.full(len(texts), self.m["prior"])
        logit, owner, _ = self.logits([tokens(t) for t in texts])
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, logit)
        a, b = self.m["calibration"]
        return np.where(np.isfinite(top), sigmoid(a * np.clip(top, -50, 50) + b), self.m["prior"])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic regression on one feature, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * x + b)
        w = q * (1 - q) + 1e-6
        g = np.array([((q - y) * x).sum() + 0.01 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = max(a - step[0], 1e-3), b - step[1]
    return float(a), float(b)


def fit(texts: list[bytes], labels: list[int], seed: int = 0) -> dict:
    """Train the network; a pure function of the sample."""
    y = np.asarray(labels, F4)
    if not len(y) or y.min() == y.max():
        return {"p": None, "prior": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    parts = [tokens(t) for t in texts]
    freq: dict[bytes, int] = {}
    for t in parts:
        for w in set(t):
            freq[w] = freq.get(w, 0) + 1
    common = sorted((w for w, n in freq.items() if n >= MIN_DOCS), key=lambda w: (-freq[w], w))[:MAX_WORDS]
    vocab = {w: i + 1 for i, w in enumerate(common)}
    p = initial(len(vocab), rng)
    model = {"p": p, "vocab": vocab, "prior": float(y.mean()), "calibration": (1.0, 0.0)}
    win, owner = windows([len(t) for t in parts])
    joined = list(chain.from_iterable(parts))
    wy = y[owner]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for phase in range(2):
        pos, neg = np.flatnonzero(wy == 1), np.flatnonzero(wy == 0)
        if phase:
            logit = Scorer(model).logits(parts)[0]
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, owner, logit)
            pos = pos[(logit[pos] >= 0) | (logit[pos] == best[owner[pos]])]
        for _ in range(EPOCHS):
            some = rng.choice(neg, min(len(neg), max(len(pos), EPOCH_CLEAN)), replace=False)
            order = rng.permutation(np.concatenate([rng.choice(pos, min(len(pos), EPOCH_TOXIC), replace=False), some]))
            share = len(pos) / (len(pos) + len(some))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                w = win[rows]
                seen: dict[bytes, int] = {}
                ids = np.array([[seen.setdefault(joined[j], len(seen)) if j >= 0 else -1 for j in r] for r in w.tolist()])
                words = list(seen)
                # now and then a word is read by its characters alone
                vid = np.array([vocab.get(x, 0) for x in words]) * (rng.random(len(words)) > 0.1)
                tri, at = trigrams(words)
                weight = np.where(wy[rows] == 1, 0.5 / share, 0.5 / (1 - share)).astype(F4)
                g = gradients(p, vid, tri, at, ids, wy[rows], weight)
                step += 1
                for k, v in p.items():
                    m, s = moments[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] ** 2 - s)
                    v -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(F4)
    logit, owner, _ = Scorer(model).logits(parts)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, logit)
    ok = np.isfinite(top)
    model["calibration"] = calibrate(top[ok].astype(float), y[ok].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    rows = {r.doc_id: r for r in sample(docs, labels, label, FIT_ROWS).collect()}
    rows = [rows[k] for k in sorted(rows)]
    return fit([bytes(r.text or b"") for r in rows], [r["__y"] for r in rows])


def score(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` plus the score (0 to 1) of every row as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value) if shared.value["p"] is not None else None
        prior = shared.value["prior"]
        return lambda texts: {name: scorer.scores(texts) if scorer else np.full(len(texts), prior)}

    return add_columns(docs, keep, f"{name} double", make)

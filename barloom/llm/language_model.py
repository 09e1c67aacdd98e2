"""Gated recurrent language model with a class-factored softmax, scoring whole documents.

Tokens are the words of the text, A-Z in lower case, and one end. Token counts over all
training rows (crc32 of doc_id modulo ``FOLDS`` not 0) give the base score and the layout of the model: the
``SHORT`` most frequent words are its vocabulary, ``CLASS`` of them to a class, all
other words one class of their own. P(word) = P(class | state) P(word | class, state); within the class of other
words a word has its smoothed share of their counts, unseen words one share together, so a text's probability is proper.

Training starts from the counts (output biases are log frequencies) and goes over all training
documents once, one in ``ROUNDS`` by hash in each of ``ROUNDS`` rounds: every
task trains its own copy by truncated backpropagation, ``WINDOW`` steps at a time with the state carried on,
and the copies are averaged by tokens in a tree of ``FAN`` each. No document passes the driver.

Scoring lays documents out in lanes (long ones first), runs all lanes in step and carries each state
from window to window until the document ends, so the likelihood is that of the complete text. Long documents do not
run on alone, in training and in scoring: the next documents of the task are laid beside them. The ``FREQUENT`` most
frequent words have their counts broadcast (a fixed bound); the other words of each text are
joined with the count table, summed per text.

A task holds ``BUFFER`` tokens, or one document if it is longer. Null and empty texts are one end. Repeated rows each
count and score alike; rows of null doc_id have the crc32 of the empty text. With no training rows all
counts are 0 and the model is the even one. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from itertools import accumulate, chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_type, crc_mod, stored

FOLDS, SHORT, CLASS, FREQUENT = 10, 2048, 64, 65_536
HIDDEN, WINDOW, LANES = 16, 32, 512
ROUNDS, TRAIN_LANES, RATE, FAN = 2, 128, 0.01, 32
BUFFER, FLUSH = 1_000_000, 400_000
END = b""  #: no word is empty
F4 = np.float32
ONES = np.ones(SHORT // CLASS + CLASS + 1, F4)
LOG10 = float(np.log(10))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), FOLDS) != 0)


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; sums of a task before the shuffle."""

    def run(batches):
        from collections import Counter

        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return got

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens(t or b""))
            if len(held) > FLUSH:
                yield out()
        if held:
            yield out()

    part = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """The frequent words by place: the model's vocabulary first, the end at place 0."""

    def __init__(self, words: list[bytes], n: list[int], total: int, distinct: int):
        self.place = {w: i for i, w in enumerate(words)}
        self.total, self.distinct = total, distinct
        self.n = np.asarray(n, np.float64)
        self.short = min(SHORT, len(words))
        self.symbol = {w: i + 1 for i, w in enumerate(words[: self.short])}
        self.base = np.log10((self.n + 0.1) / (total + 0.1 * (distinct + 1)))
        self.rest_n, self.rest_v = total - self.n[: self.short].sum(), distinct - int((self.n[: self.short] > 0).sum())
        self.rest = np.log10((self.n + 0.1) / (self.rest_n + 0.1 * (self.rest_v + 1)))

    def ids(self, text: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, text, repeat(-1)), np.int32, len(text))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Model symbols: 0 for other words, places of the vocabulary from 1."""
        return np.where((ids >= 0) & (ids < self.short), ids + 1, 0)

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Model symbols of whole texts, looked up in the small table of the vocabulary alone."""
        parts = [tokens(x or b"") for x in texts]
        cuts = [0, *accumulate(map(len, parts))]
        flat = np.fromiter(map(self.symbol.get, chain.from_iterable(parts), repeat(0)), np.int32, cuts[-1])
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def layout(lengths: list[int], lanes: int, begun: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lane and first step of every document, long ones first after the ``begun`` ones; lane lengths fall."""
    lanes = max(1, min(lanes, len(lengths)))
    heap = [(0, k) for k in range(lanes)]
    lane, first = np.zeros(len(lengths), int), np.zeros(len(lengths), int)
    for d in sorted(range(len(lengths)), key=lambda i: (i >= begun, -lengths[i])):
        used, k = heapq.heappop(heap)
        lane[d], first[d] = k, used
        heapq.heappush(heap, (used + lengths[d], k))
    size = dict((k, used) for used, k in heap)
    order = sorted(size, key=lambda k: -size[k])
    new = {k: i for i, k in enumerate(order)}
    return np.array([new[k] for k in lane]), first, [size[k] for k in order]


def fill(docs: list[np.ndarray], lane: np.ndarray, first: np.ndarray, lanes: int, end: int, begun: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, lanes) of symbols and documents (-1: nothing), and document starts, up to step ``end``."""
    sym = np.zeros((end, lanes), np.int32)
    doc = np.full(sym.shape, -1, np.int32)
    start = np.zeros(sym.shape, bool)
    for d, x in enumerate(docs):
        a, k = first[d], lane[d]
        if a < end:
            b = min(a + len(x), end)
            sym[a:b, k], doc[a:b, k], start[a, k] = x[: b - a], d, d >= begun
    return sym, doc, start


def lay(symbols: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All documents to their ends, and lane lengths."""
    lane, first, size = layout([len(s) for s in symbols], lanes)
    return *fill(symbols, lane, first, len(size), max(size)), np.asarray(size)


class Lanes:
    """Documents side by side in ``width`` lanes. What is unfinished when half of them have run empty goes on,
    with its state, beside the documents that come next, unless it is more than ``BUFFER`` tokens."""

    def __init__(self, width: int):
        self.width, self.left, self.h = width, [], np.zeros((0, HIDDEN), F4)

    def until(self, size: np.ndarray) -> int:
        """The step up to which all windows are at least half full, or what is left is small enough to be kept."""
        half = max(1, self.width // 2)
        step = int(size[half - 1]) // WINDOW if len(size) >= half else 0
        below, above = step, -(-int(size[0]) // WINDOW)
        while below < above:
            middle = (below + above) // 2
            if np.maximum(size - middle * WINDOW, 0).sum() > BUFFER:
                below = middle + 1
            else:
                above = middle
        return below * WINDOW

    def run(self, symbols: list[np.ndarray], step, last: bool = False, reach=lambda n: WINDOW) -> np.ndarray:
        """``step(sym, doc, start, h)`` gives the states after windows of (steps, lanes) of symbols, documents (-1:
        nothing) and starts; ``reach`` their steps by lanes. All documents end if it is the ``last`` run.

        Documents count from the unfinished ones of the run before; those unfinished now come back in their order.
        """
        docs, begun = self.left + symbols, len(self.h)
        if not docs:
            return np.zeros(0, np.int64)
        lane, first, size = layout([len(d) for d in docs], self.width, begun)
        size = np.asarray(size)
        end = int(size[0]) if last else self.until(size)
        sym, doc, start = fill(docs, lane, first, len(size), end, begun)
        h = np.zeros((len(size), HIDDEN), F4)
        h[lane[:begun]] = self.h
        t = 0
        while t < end:
            n = int((size > t).sum())
            to = min(end, t + reach(n))
            h[:n] = step(sym[t:to, :n], doc[t:to, :n], start[t:to, :n], h[:n])
            t = to
        done = np.clip(end - first, 0, [len(d) for d in docs])
        left = [d for d, x in enumerate(docs) if done[d] < len(x)]
        going = [d for d in left if done[d] or d < begun]
        self.h = h[lane[going]]
        waiting = going + [d for d in left if not (done[d] or d < begun)]
        self.left = [docs[d][done[d] :].astype(np.int32) for d in waiting]
        return np.asarray(waiting, np.int64)


def initial(words: Words, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights before training: even states and the frequencies as biases."""
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, words.short
    classes = -(-k // CLASS)
    n = np.zeros(classes * CLASS)
    n[:k] = words.n[:k] + 0.1
    mass = np.concatenate([[words.rest_n + 0.1 * (words.rest_v + 1)], n.reshape(classes, CLASS).sum(1)])
    draw = lambda *s, scale=1.0: (scale * rng.standard_normal(s) / np.sqrt(s[-2])).astype(F4)
    with np.errstate(divide="ignore"):
        inner = np.where(n > 0, np.log(np.maximum(n, 1e-9)), -1e9).reshape(classes, CLASS)
    p = {"emb": 0.3 * rng.standard_normal((k + 1, h)), "w": draw(h, 3 * h), "u": draw(h, 3 * h), "b": np.zeros(3 * h)}
    p |= {"cw": draw(h, classes + 1, scale=0.1), "cb": np.log(mass / mass.sum()), "ow": 0.1 * draw(classes, h, CLASS), "ob": inner}
    return {k: np.ascontiguousarray(v, F4) for k, v in p.items()}


def states(p: dict, gates: np.ndarray, sym: np.ndarray, start: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States before each step of a window, and the one after it; gates: input products of the symbols.

    Inside, lanes are the last axis, so gates are whole rows; ``keep`` gets them as they are.
    """
    k = HIDDEN
    out = np.empty((len(sym), k, sym.shape[1]), F4)
    u, uc = np.ascontiguousarray(-p["u"][:, : 2 * k].T), np.ascontiguousarray(p["u"][:, 2 * k :].T)
    go = (~start).astype(F4)
    inputs = np.ascontiguousarray(gates[sym].transpose(0, 2, 1))
    h = h.T
    for t in range(len(sym)):
        h = np.multiply(h, go[t], out=out[t])
        zr = u @ h
        zr -= inputs[t, : 2 * k]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        rs = zr[k:] * h
        c = uc @ rs
        c += inputs[t, 2 * k :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((zr, rs, c))
        step = c - h
        step *= zr[:k]
        step += h
        h = step
    return out.transpose(0, 2, 1), h.T


def steady(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether products of states, all within -1 and 1, and the weights of a class can neither overflow nor all vanish."""
    reach = np.abs(w).sum(-2)
    return ((b + reach).max(-1) < 60) & ((b - reach).max(-1) > -60)


def softmax(s: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of the columns ``at``, and the unscaled exponentials with their sums; not ``plain``: the
    largest product of each row is taken off first."""
    x = s @ w
    x += b
    if not plain:
        x -= x.max(1, keepdims=True)
    out = x[np.arange(len(s)), at]
    e = np.exp(x, out=x)
    total = e @ ONES[: e.shape[1]]
    return out - np.log(total), e, total


def slopes(s: np.ndarray, w: np.ndarray, e: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the negative log probabilities: of weights, biases and states."""
    e[np.arange(len(s)), at] -= total
    share = 1 / total
    return (s * share[:, None]).T @ e, share @ e, (e @ w.T) * share[:, None]


def likelihood(p: dict, s: np.ndarray, sym: np.ndarray, g: dict | None = None) -> np.ndarray:
    """Natural log probabilities of flat symbols; with ``g``, gradients of the negative sum and ``g['s']``."""
    cls = np.where(sym > 0, (sym - 1) // CLASS + 1, 0)
    out, e, total = softmax(s, p["cw"], p["cb"], cls, bool(steady(p["cw"], p["cb"])))
    if g is not None:
        g["cw"], g["cb"], g["s"] = slopes(s, p["cw"], e, total, cls)
        g["ow"], g["ob"] = np.zeros_like(p["ow"]), np.zeros_like(p["ob"])
    plain = steady(p["ow"], p["ob"]).tolist()
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(1, len(p["ob"]) + 2))
    order, cuts = order[cuts[0] :], cuts - cuts[0]
    sorted_s, inside = s[order], (sym[order] - 1) % CLASS
    more, ds = np.empty(len(order), F4), np.empty_like(sorted_s)
    for c, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if lo == hi:
            continue
        own = sorted_s[lo:hi], p["ow"][c]
        more[lo:hi], e, total = softmax(*own, p["ob"][c], inside[lo:hi], plain[c])
        if g is not None:
            g["ow"][c], g["ob"][c], ds[lo:hi] = slopes(*own, e, total, inside[lo:hi])
    out[order] += more
    if g is not None:
        g["s"][order] += ds
    return out


class Trainer:
    """Adam on windows of laid-out documents; the state is carried, gradients end at the window."""

    def __init__(self, p: dict):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        self.steps = self.seen = 0
        self.lanes = Lanes(TRAIN_LANES)

    def window(self, sym: np.ndarray, doc: np.ndarray, start: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, k = self.p, HIDDEN
        kept: list = []
        s, last = states(p, p["emb"] @ p["w"] + p["b"], sym, start, h, kept)
        real = doc.ravel() >= 0
        n = int(real.sum())
        full = n == len(real)
        before, flat_sym = s.reshape(-1, k), sym.ravel()
        g: dict = {}
        likelihood(p, before if full else before[real], flat_sym if full else flat_sym[real], g)
        n = max(1, n)
        ds = g.pop("s")
        if not full:
            some, ds = ds, np.zeros((s.size // k, k), F4)
            ds[real] = some
        ds = np.ascontiguousarray(ds.reshape(s.shape).transpose(0, 2, 1))
        at = s.transpose(0, 2, 1)
        dh, dg = np.zeros_like(ds[0]), np.empty((len(sym), 3 * k, sym.shape[1]), F4)
        uc, uzr = np.ascontiguousarray(p["u"][:, 2 * k :]), np.ascontiguousarray(p["u"][:, : 2 * k])
        go = (~start).astype(F4)
        for t in range(len(sym) - 1, -1, -1):
            zr, rs, c = kept[t]
            dz = dh * zr[:k]
            dc = np.multiply(dz, 1 - c * c, out=dg[t, 2 * k :])
            drs = uc @ dc
            np.multiply(dz, c - at[t], out=dg[t, :k])
            np.multiply(drs, rs, out=dg[t, k : 2 * k])
            dzr = dg[t, : 2 * k]
            dzr *= 1 - zr
            dh -= dz
            drs *= zr[k:]
            dh += drs
            dh += uzr @ dzr
            dh += ds[t]
            dh *= go[t]
        flat = dg.transpose(0, 2, 1).reshape(-1, 3 * k)
        reset = np.stack([x[1] for x in kept]).transpose(0, 2, 1).reshape(-1, k)
        g["u"] = np.concatenate([before.T @ flat[:, : 2 * k], reset.T @ flat[:, 2 * k :]], 1)
        # one sum per symbol: equal symbols side by side
        order = np.argsort(flat_sym.astype(np.int16), kind="stable")
        by = flat_sym[order]
        cuts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        met, per = by[cuts], np.add.reduceat(flat[order], cuts, axis=0)
        g["w"], g["b"], g["emb"] = p["emb"][met].T @ per, per.sum(0), np.zeros_like(p["emb"])
        g["emb"][met] = per @ p["w"].T
        self.steps += 1
        self.seen += n
        rate, far = RATE / (1 - 0.9**self.steps), 1 / (1 - 0.99**self.steps)
        for name, v in p.items():
            m, q = self.m[name]
            x = g[name]
            x /= n
            x -= m
            x *= 0.1
            m += x
            # the squared gradient, from the moved mean: x holds a tenth of what it moved by
            x *= 9
            x += m
            x *= x
            x -= q
            x *= 0.01
            q += x
            np.multiply(q, far, out=x)
            np.sqrt(x, out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= rate
            v -= x
        return last

    def train(self, symbols: list[np.ndarray], last: bool = True) -> None:
        self.lanes.run(symbols, self.window, last)


def wide(lanes: int) -> int:
    """Steps of a window when scoring: as many symbols as in full lanes, in whole windows."""
    return WINDOW * max(1, LANES // lanes)


class Scorer:
    """Natural log probabilities of documents as symbols, states carried from start to end."""

    def __init__(self, p: dict, lanes: int = LANES):
        self.p, self.gates, self.lanes, self.sums = p, p["emb"] @ p["w"] + p["b"], Lanes(lanes), np.zeros(0)

    def run(self, symbols: list[np.ndarray], last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The sums of all documents, those unfinished before first, and which of them are unfinished now."""
        out = np.concatenate([self.sums, np.zeros(len(symbols))])

        def step(a, doc, start, h):
            s, h = states(self.p, self.gates, a, start, h)
            d, s, a = doc.ravel(), s.reshape(-1, HIDDEN), a.ravel()
            real = d >= 0
            if not real.all():
                d, s, a = d[real], s[real], a[real]
            out[:] += np.bincount(d, likelihood(self.p, s, a), len(out))
            return h

        left = self.lanes.run(symbols, step, last, wide)
        self.sums = out[left]
        return out, left


def score(p: dict, symbols: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log probability of every document as symbols."""
    return Scorer(p, lanes).run(symbols, last=True)[0]


def dump(p: dict) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def load(data: bytes, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, F4, like[k].size, at).reshape(like[k].shape).copy()
        at += 4 * like[k].size
    return out


def buffered(batches, columns: int):
    """Rows of several batches, about ``BUFFER`` tokens (at six bytes) at a time: column lists, text last."""
    held, size = [[] for _ in range(columns)], 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            for h, x in zip(held, row):
                h.append(x)
            size += len(row[-1] or b"") + 6
            if size > 6 * BUFFER:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def train(docs: DataFrame, words: Words) -> dict:
    """Rounds of training in all tasks and averaging."""
    p = initial(words)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    rows = train_rows(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(p)

        def run(batches, now=now):
            from pyspark import TaskContext

            words, t = shared.value, Trainer(now.value)
            for (texts,) in buffered(batches, 1):
                t.train(words.texts(texts), last=False)
            t.train([])
            if t.seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(t.seen)]), pa.array([dump(t.p)])], names=["task", "seen", "p"])

        mine = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text")
        copies = stored(mine.mapInArrow(run, "task bigint, seen double, p binary"), "lm-copies")
        p = averaged(copies, p)
    return p


def averaged(copies: DataFrame, like: dict) -> dict:
    """Mean weights of all copies by tokens seen; ``FAN`` copies meet in one task or on the driver."""

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        seen = part["seen"].to_numpy()
        p = sum(w * np.frombuffer(x, F4).astype(np.float64) for w, x in zip(seen / seen.sum(), part["p"]))
        return pd.DataFrame({"task": [int(part["task"].iloc[0]) // FAN], "seen": [seen.sum()], "p": [p.astype(F4).tobytes()]})

    while copies.count() > FAN:
        copies = copies.groupBy(F.floor(F.col("task") / FAN)).applyInPandas(mean, "task bigint, seen double, p binary")
        copies = stored(copies, "lm-copies")
    rows = [r.asDict() for r in copies.orderBy("task").collect()]
    return load(mean(pd.DataFrame(rows))["p"][0], like) if rows else like


def frequent(table: DataFrame) -> Words:
    """The words whose counts are broadcast, and the totals."""
    total = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the least count class above which there are fewer than FREQUENT words: sixteen classes to a doubling
    level = F.floor(16 * F.log2("n"))
    classes = table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, words = None, 0
    for c in classes:
        words += c["count"]
        if words >= FREQUENT:
            break
        least = c.level
    chosen = [] if least is None else table.where((F.length("word") > 0) & (level >= least)).collect()
    top = sorted(chosen, key=lambda r: (-r.n, bytes(r.word)))
    end = table.where(F.length("word") == 0).select("n").first()
    return Words([END, *(bytes(r.word) for r in top)], [end.n if end else 0, *(r.n for r in top)], total.n or 0, total.v)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    table = stored(counts(train_rows(docs)), "lm-counts")
    words = frequent(table)
    model = train(docs, words)
    shared = spark.sparkContext.broadcast((words, model))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string("uid bigint, n_tokens bigint, n_known bigint, base double, lm double, rare array<struct<word:binary,times:int>>")])

    def ended(rows, sums, done):
        """The ended rows; their ``lm`` held the share of words outside the model's vocabulary."""
        out, at = rows.take(pa.array(done)), rows.schema.get_field_index("lm")
        return out.set_column(at, "lm", pa.array(sums[done] / LOG10 + out.column(at).to_numpy()))

    def run(batches):
        from collections import Counter

        from pyspark import TaskContext

        words, p = shared.value
        scorer, kept = Scorer(p), None
        uid = TaskContext.get().partitionId() << 32
        for ids, texts in buffered(batches, 2):
            parts = [tokens(t or b"") for t in texts]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            every = [*chain.from_iterable(parts)]
            flat = words.ids(every)
            cuts = np.concatenate([[0], np.cumsum(size)])
            known = flat >= 0
            base = np.add.reduceat(np.where(known, words.base[flat], 0), cuts[:-1])
            other = np.add.reduceat(np.where(known & (flat >= words.short), words.rest[flat], 0), cuts[:-1])
            n_known = np.add.reduceat((known & (words.n[flat] > 0)).astype(np.int64), cuts[:-1])
            sym = words.symbols(flat)
            sums, left = scorer.run([sym[a:b] for a, b in zip(cuts, cuts[1:])])
            unknown = np.flatnonzero(~known)
            rare, ends = [every[i] for i in unknown.tolist()], np.searchsorted(unknown, cuts).tolist()
            words_of, times_of, offsets = [], [], [0]
            for a, b in zip(ends, ends[1:]):
                if b > a:
                    n = Counter(rare[a:b])
                    words_of += n.keys()
                    times_of += n.values()
                offsets.append(len(words_of))
            pairs = pa.StructArray.from_arrays([pa.array(words_of, pa.binary()), pa.array(times_of, pa.int32())], ["word", "times"])
            first = pa.array(ids, arrow_type(id_type))
            rare_col = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            cols = [first, pa.array(np.arange(uid, uid + len(ids))), pa.array(size), pa.array(n_known), pa.array(base), pa.array(other), rare_col]
            uid += len(ids)
            rows = pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])
            rows = rows if kept is None else pa.concat_batches([kept, rows])
            kept = rows.take(pa.array(left))
            yield ended(rows, sums, np.setdiff1d(np.arange(len(sums)), left))
        if kept is not None:
            sums, _ = scorer.run([], last=True)
            yield ended(kept, sums, np.arange(len(sums)))

    made = stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "lm-scores")
    log = lambda n, v: F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (n + 0.1 * (v + 1)))
    each = made.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.times").join(table, "word", "left")
    summed = each.groupBy("uid").agg(
        F.sum(F.col("times") * log(float(words.total), words.distinct)).alias("rare_base"),
        F.sum(F.col("times") * log(float(words.rest_n), words.rest_v)).alias("rare_lm"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return made.drop("rare").join(summed, "uid", "left").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(int(words.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("lm") + zero("rare_lm")).alias("score"),
    )


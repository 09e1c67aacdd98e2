r"""Phrase collocations by weighted acyclic automata (``transducers``).

Texts (A-Z lower-cased, null as empty) are cut at ``[.,;:!?\x0A-\x0D]`` into pieces and those at spaces and tabs into
words. Every Arrow batch becomes sorted n-grams and these become count transducers, one per language (null:
``und``), length and prefix range. The transducers of a range meet in one exchange and are united there, counts summed, a
few at a time. A range is taken from the hashes of the first word and, for longer n-grams, of the second too, so that
the n-grams of a word that starts a third of them lie in several ranges. The number of ranges follows that of the input's splits.

Words and pairs are counted in a first pass, triples in a second: only such whose two pairs are frequent, as a
bitmap of their hashes says (of bounded size; what it wrongly lets through is counted and then dropped).

Parts are looked up by composition: a range sends the parts of its phrases, once each, to the ranges of the parts, with the
greatest count of a phrase that holds them; there they are composed with the counts, which gives l, r and the pairs that a
longer phrase covers; the answers go back to the range that asked.

Words are named by 64-bit hashes; the word automata hold the words themselves, and if two words of a
language share a hash the job stops with an error instead of adding them up. A range of a language keeps the best ``top``
phrases and all that tie with the last. Texts without words and no rows give no phrases; repeated rows count as often as
they are there; other columns are not read; long texts are hashed in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import batch_rows, forget, stored
from barloom.llm.transducers import Transducer, starts, union
from barloom.llm.words import mix, spans

LEAST, COVER, MOST_FILTER_BITS = 10, 50, 1 << 26
GAPS = b" \t.,;:!?\n\x0b\x0c\r"
#: n-grams of a range that are united at once.
UNITED = 1 << 22
RECORD = "lang string, size int, range int, kind int, home int, data binary, words binary, tokens bigint"
COUNTS, ASKED, COVERED, WORDS = 0, 1, 2, 3
_types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "double": pa.float64()}


def records(rows: list[tuple], schema: str = RECORD) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _types[f[1]]) for c, f in zip(columns, fields)], names=[f[0] for f in fields])


def range_of(grams: list[np.ndarray], bits: int) -> np.ndarray:
    """2**bits prefix ranges; three bits are of the second word where there is one."""
    if len(grams) == 1:
        return (grams[0] >> np.uint64(64 - bits)).astype(np.int64)
    return ((grams[0] >> np.uint64(67 - bits)) << np.uint64(3) | grams[1] >> np.uint64(61)).astype(np.int64)


def by_range(grams: list[np.ndarray], bits: int, *more: np.ndarray):
    """(range, n-grams, more) for each range; n-grams stay in order."""
    place = range_of(grams, bits)
    order = np.argsort(place, kind="stable")
    first = starts(place[order])
    for at, end in zip(first, [*first[1:], len(order)]):
        rows = order[at:end]
        yield int(place[rows[0]]), [g[rows] for g in grams], *(m[rows] for m in more)


def sentences(batch: pa.RecordBatch):
    """For each language of a batch (lang, text): hashes of its words, whether each goes on in the piece of the one before, and
    a function that gives the words at some places."""
    langs = batch.column(0).to_pylist()
    h, start, end, first, data = spans(batch.column(1), GAPS)
    cuts = np.zeros(256, np.int32)
    cuts[[c for c in GAPS if c not in b" \t"]] = 1
    cuts = np.cumsum(cuts[data], dtype=np.int32) if len(data) else np.zeros(0, np.int32)
    goes_on = np.zeros(len(h), bool)
    goes_on[1:] = cuts[start[1:]] == cuts[start[:-1]]
    goes_on[first[:-1][first[:-1] < len(h)]] = False
    many = np.diff(first)
    for lang in dict.fromkeys(langs):
        at = np.flatnonzero(np.repeat(np.array([x == lang for x in langs]), many))
        text = lambda rows, at=at: [bytes(data[s:e]).lower() for s, e in zip(start[at[rows]], end[at[rows]])]
        yield lang, h[at], goes_on[at], text


def small_counts(texts: DataFrame, bits: int) -> DataFrame:
    """Count transducers of words and pairs, as records."""

    def run(batches):
        for b in batches:
            out = []
            for lang, h, goes_on, text in sentences(b):
                symbols, at, of, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                for i, g, c, rows in by_range([symbols], bits, count, at):
                    out.append((lang, 1, i, COUNTS, -1, Transducer.build(g, c).to_bytes(), b"\n".join(text(rows)), int(c.sum())))
                pair = np.flatnonzero(goes_on)
                key, count = np.unique(of[pair - 1] * len(symbols) + of[pair], return_counts=True)
                for i, g, c in by_range([symbols[key // max(1, len(symbols))], symbols[key % max(1, len(symbols))]], bits, count):
                    out.append((lang, 2, i, COUNTS, -1, Transducer.build(g, c).to_bytes(), None, 0))
            yield records(out)

    return texts.mapInArrow(run, RECORD)


def filter_place(lang: str, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    seed = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"_"), "little"))
    return (mix(mix(first ^ seed) + second) & np.uint64(size - 1)).astype(np.int64)


def triple_counts(texts: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """Count transducers of the triples whose two pairs are frequent."""
    many = pairs.agg(F.sum("tokens")).first()[0] or 0
    size = min(MOST_FILTER_BITS, max(1 << 15, 1 << int(16 * many).bit_length()))

    def places(batches):
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, second = Transducer.from_bytes(data).grams()
                yield pa.RecordBatch.from_arrays([pa.array(filter_place(lang, first, second, size))], names=["h"])

    found = pairs.select("lang", "data").mapInArrow(places, "h bigint").groupBy((F.col("h") / 32768).cast("int").alias("slice"))
    held = np.zeros(size // 8, np.uint8)
    for r in found.agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits")).collect():  # 8 MB at most
        held[r["slice"] * 4096 : (r["slice"] + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        held = shared.value
        for b in batches:
            out = []
            for lang, h, goes_on, _ in sentences(b):
                pair = np.flatnonzero(goes_on)
                place = filter_place(lang, h[pair - 1], h[pair], size)
                frequent = np.zeros(len(h) + 1, bool)
                frequent[pair] = held[place >> 3] >> (place & 7).astype(np.uint8) & 1
                last = np.flatnonzero(frequent[1:-1] & frequent[:-2]) + 1
                if len(last):
                    grams, count = union([([h[last - 2], h[last - 1], h[last]], np.ones(len(last), np.int64))])
                    out += [(lang, 3, i, COUNTS, -1, Transducer.build(g, c).to_bytes(), None, 0) for i, g, c in by_range(grams, bits, count)]
            yield records(out)

    return texts.mapInArrow(run, RECORD)


def gathered(found: DataFrame, finish, schema: str = RECORD) -> DataFrame:
    """``finish(key, rows)`` for the records of each (lang, size, range), which stream by in order of kind."""

    def run(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()

        held, key = [], None
        for r in rows():
            now = (r["lang"], r["size"], r["range"])
            if now != key:
                if key:
                    yield from finish(key, held)
                held, key = Gathered(), now
            held.add(r)
        if key:
            yield from finish(key, held)

    return found.repartition("lang", "size", "range").sortWithinPartitions("lang", "size", "range", "kind").mapInArrow(run, schema)


class Gathered:
    """Records of one range: counts are united a few million n-grams at a time, words checked, the rest kept."""

    def __init__(self) -> None:
        self.parts, self.waiting, self.words, self.tokens, self.rest = [], 0, {}, 0, []

    def add(self, r: dict) -> None:
        if r["kind"] != COUNTS:
            self.rest.append(r)
            return
        t = Transducer.from_bytes(r["data"])
        self.parts.append((t.grams(), t.counts))
        self.waiting += len(t.counts)
        self.tokens += r["tokens"]
        if r["words"]:
            for h, w in zip(self.parts[-1][0][0].tolist(), r["words"].split(b"\n")):
                if self.words.setdefault(h, w) != w:
                    raise ValueError(f"two words share a hash: {w!r} and {self.words[h]!r}; change the seed of words.py")
        if self.waiting > UNITED and len(self.parts) > 1:
            self.parts = [self.counts()]
            self.waiting = 0

    def counts(self) -> tuple[list[np.ndarray], np.ndarray]:
        return union(self.parts)


def frequent(found: DataFrame) -> DataFrame:
    """United counts of at least ``LEAST``, a record a range; tokens: all occurrences of words, or the number of longer n-grams kept."""

    def finish(key, held):
        grams, counts = held.counts()
        keep = counts >= LEAST
        grams, counts = [g[keep] for g in grams], counts[keep]
        words = b"\n".join(held.words[h] for h in grams[0].tolist()) if key[1] == 1 else None
        tokens = held.tokens if key[1] == 1 else len(counts)
        if tokens:
            yield records([(*key, COUNTS, -1, Transducer.build(grams, counts).to_bytes(), words, tokens)])

    return stored(gathered(found, finish), "collocation-counts")


def parts_of(grams: list[np.ndarray]):
    """(cut, part, n-grams of the part): first and rest of every cut."""
    for k in range(1, len(grams)):
        yield k, 0, grams[:k]
        yield k, 1, grams[k:]


def asked_parts(counts: DataFrame, bits: int) -> DataFrame:
    """For each range of phrases and range of parts one record: the parts asked for, with the greatest count of a phrase around them."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                t = Transducer.from_bytes(r["data"])
                grams, asked = t.grams(), {1: [], 2: []}
                for _, _, part in parts_of(grams):
                    asked[len(part)].append((part, t.counts))
                for size, parts in asked.items():
                    if not parts:
                        continue
                    columns = [np.concatenate(c) for c in zip(*(p for p, _ in parts))]
                    around = np.concatenate([c for _, c in parts])
                    order = np.lexsort(columns[::-1])
                    first = starts(*(c[order] for c in columns))
                    most = np.maximum.reduceat(around[order], first)
                    for i, g, m in by_range([c[order][first] for c in columns], bits, most):
                        yield records([(r["lang"], size, i, ASKED, r["size"] << 24 | r["range"], Transducer.build(g, m).to_bytes(), None, 0)])

    return counts.where("size > 1").select("lang", "size", "range", "data").mapInArrow(run, RECORD)


def answered(counts: DataFrame, bits: int) -> DataFrame:
    """Composition of the asked parts with the counts: parts with their counts back to who asked, covered pairs to their own range."""

    def finish(key, held):
        lang, size, place = key
        grams, counts = held.counts()
        own, covered = Transducer.build(grams, counts), np.zeros(len(counts), bool)
        for r in held.rest:
            asked = Transducer.from_bytes(r["data"])
            parts = asked.grams()
            at, count = own.compose(parts)
            if size == 2:
                covered[at[100 * asked.counts >= COVER * count]] = True
            yield records([(lang, r["home"] >> 24, r["home"] & 0xFFFFFF, ASKED, size, Transducer.build(parts, count).to_bytes(), None, 0)])
        if covered.any():
            data = Transducer.build([g[covered] for g in grams], counts[covered]).to_bytes()
            yield records([(lang, size, place, COVERED, size, data, None, 0)])

    return gathered(counts.where("size < 3").unionByName(asked_parts(counts, bits)), finish)


def score(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """floor(1000000 a a / (l r)), exactly."""
    if len(a) and max(a.max(), l.max(), r.max()) >= 3_000_000:
        return np.array([1_000_000 * x * x // (y * z) for x, y, z in zip(a.tolist(), l.tolist(), r.tolist())], np.int64)
    return 1_000_000 * a * a // (l * r)


PHRASES = "lang string, h1 bigint, h2 bigint, h3 bigint, a bigint, l bigint, r bigint, score bigint"


def scored(counts: DataFrame, answers: DataFrame, top: int) -> DataFrame:
    """The best phrases of every range, with all that tie with the last of them."""

    def finish(key, held):
        lang, size, _ = key
        grams, a = held.counts()
        found = {k: [Transducer.from_bytes(r["data"]) for r in held.rest if r["kind"] == ASKED and r["home"] == k] for k in (1, 2)}
        found = {k: Transducer.build(*union([(t.grams(), t.counts) for t in x])) for k, x in found.items() if x}
        sides = {(k, side): found[len(part)].compose(part)[1] for k, side, part in parts_of(grams)}
        l, r = sides[1, 0], sides[1, 1]  # noqa: E741
        best = score(a, l, r)
        for k in range(2, size):
            other = score(a, sides[k, 0], sides[k, 1])
            less = other < best
            best, l, r = np.where(less, other, best), np.where(less, sides[k, 0], l), np.where(less, sides[k, 1], r)  # noqa: E741
        keep = np.ones(len(a), bool)
        for x in held.rest:
            if x["kind"] == COVERED:
                keep[Transducer.build(grams, a).compose(Transducer.from_bytes(x["data"]).grams())[0]] = False
        rows = np.flatnonzero(keep)
        rows = rows[np.lexsort((-a[rows], -best[rows]))]
        if len(rows) > top:
            last = rows[top - 1]
            rows = rows[(best[rows] > best[last]) | (best[rows] == best[last]) & (a[rows] >= a[last])]
        h = [g[rows].view(np.int64).tolist() for g in grams] + [[None] * len(rows)] * (3 - size)
        yield records(list(zip([lang] * len(rows), *h, *(x[rows].tolist() for x in (a, l, r, best)))), PHRASES)

    return gathered(counts.where("size > 1").unionByName(answers), finish, PHRASES)


def words_of(counts: DataFrame) -> DataFrame:
    """(lang, h, word) of the frequent words."""

    def run(batches):
        for b in batches:
            for lang, data, words in zip(*(b.column(i).to_pylist() for i in range(3))):
                (h,) = Transducer.from_bytes(data).grams()
                if len(h):
                    yield records([(lang, x, w.decode()) for x, w in zip(h.view(np.int64).tolist(), words.split(b"\n"))], "lang string, h bigint, word string")

    return counts.where("size = 1").select("lang", "data", "words").mapInArrow(run, "lang string, h bigint, word string")


def collocations(docs: DataFrame, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of every language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    bits = min(20, max(5, int(2 * texts.rdd.getNumPartitions() - 1).bit_length()))
    with batch_rows(spark, 1 << 12, 8 << 20):
        small = frequent(small_counts(texts, bits))
        triples = frequent(triple_counts(texts, small.where("size = 2"), bits))
    counts = small.unionByName(triples)
    found = stored(scored(counts, answered(counts, bits), top), "collocations")
    words = words_of(small)
    for i in (1, 2, 3):
        found = found.join(words.select("lang", F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")), ["lang", f"h{i}"], "left")
    n = small.where("size = 1").groupBy("lang").agg(F.sum("tokens").alias("n"))
    found = found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).join(n, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    done = stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocation-ranks")
    forget(small)
    forget(triples)
    return done

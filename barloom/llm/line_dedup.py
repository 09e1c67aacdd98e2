"""Reversible line dedup: exact reference counts of line keys behind sharded cuckoo filters.

A line's key is the line without ASCII white space at its ends, A-Z in lower case; counts
are kept under 128-bit digests of the keys. The index holds

* ``refs`` (shard, key, n_docs): the exact number of documents that hold each key;
* ``filters`` (shard, filter): a cuckoo filter of the shard's keys, deletable.

Inserting documents asks the filters first: keys they do not know are appended, only the
others meet the exact table. Deleting documents takes their counts back; keys that reach
zero leave table and filter, so the index is what it would be had they never come.

``drop_lines`` removes the lines whose key at least ``min_docs`` documents hold. Cuckoo
filters of just those keys are broadcast if they are small (``BROADCAST_BYTES``, checked)
and spare the shuffle of other lines; beyond that size all line keys are shuffled. Either
way a join with the exact table decides, so filter errors never reach the result. Counts
are summed before the shuffle; a key in a third of all lines is one row per task there,
and the join's hot side is split by adaptive execution.

Null and empty texts are one empty line. Empty keys are never dropped. Each row is a
document: repeated rows count again and are treated alike. An empty table gives an empty
result. Other columns pass through; input columns named like outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import add_columns, row_key, stored

MIN_DOCS, SHARD_KEYS, BROADCAST_BYTES = 10, 25_000, 8 << 20


def keys(text: bytes) -> list[bytes]:
    """Digest of every line's key, empty bytes for empty keys."""
    stripped = (line.strip().lower() for line in text.split(b"\n"))
    return [blake2b(k, digest_size=16).digest() if k else b"" for k in stripped]


class Cuckoo:
    """Cuckoo filter of 16-bit fingerprints, four slots a bucket, arrays of keys at a time."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots
        self.mask = len(self.slots) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of all keys (uint64), doubled until they fit."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / 3.4))))
        while True:
            made = cls(buckets)
            if made.insert(keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        slots = np.frombuffer(data, np.uint16).reshape(-1, 4).copy()
        return cls(len(slots), slots)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(keys)
        return ((self.slots[a] == prints[:, None]) | (self.slots[b] == prints[:, None])).any(1)

    def _fill(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put prints in free slots of their buckets; True where there was one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.slots[b] == 0
        nth = np.cumsum(free, 1) * free
        hit = nth == rank[:, None] + 1
        ok = hit.any(1)
        self.slots[b[ok], hit[ok].argmax(1)] = prints[order][ok]
        out = np.zeros(len(b), bool)
        out[order] = ok
        return out

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys (each once); False if they do not fit."""
        prints, bucket, other = self.places(keys)
        left = ~self._fill(bucket, prints)
        prints, bucket = prints[left], other[left]
        rng = np.random.default_rng(0)
        for _ in range(500):
            if not len(prints):
                return True
            left = ~self._fill(bucket, prints)
            prints, bucket = prints[left], bucket[left]
            # one print of each full bucket pushes a stored one to its other bucket
            _, one = np.unique(bucket, return_index=True)
            slot = rng.integers(0, 4, len(one))
            out = self.slots[bucket[one], slot].copy()
            self.slots[bucket[one], slot] = prints[one]
            prints[one] = out
            bucket[one] = self.other(bucket[one], out)
        return not len(prints)

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        prints, *homes = self.places(keys)
        todo = np.arange(len(keys))
        for bucket in homes:
            absent = []
            while len(todo):
                hit = self.slots[bucket[todo]] == prints[todo][:, None]
                there = hit.any(1)
                absent.append(todo[~there])
                todo = todo[there]
                cell = bucket[todo] * 4 + hit[there].argmax(1)
                _, one = np.unique(cell, return_index=True)
                self.slots.reshape(-1)[cell[one]] = 0
                todo = np.delete(todo, one)
            todo = np.concatenate([*absent, todo])


def words(keys: pd.Series) -> np.ndarray:
    """64 bits of every digest."""
    return np.frombuffer(b"".join(bytes(k)[:8] for k in keys), np.uint64)


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def key_counts(docs: DataFrame) -> DataFrame:
    """(key, n): documents that hold each key; distinct keys of a document before the shuffle."""
    source = docs.select(F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            found = [k for t in b.column(0).to_pylist() for k in set(keys(t or b"")) if k]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["key"])

    return source.mapInArrow(run, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class LineIndex:
    refs: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        """Index of a first batch; the number of shards follows its distinct keys."""
        counts = stored(key_counts(docs), "line-keys")
        shards = max(1, -(-counts.count() // SHARD_KEYS))
        refs = counts.select(shard_of(shards).alias("shard"), "key", F.col("n").alias("n_docs"))
        return cls(refs, filters_of(refs), shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        delta = stored(key_counts(docs).withColumn("shard", shard_of(self.shards)), "line-delta")

        def ask(key, left, right):
            known = Cuckoo.load(bytes(right["filter"].iloc[0])) if len(right) else None
            maybe = known.contains(words(left["key"])) if known and len(left) else np.zeros(len(left), bool)
            return left.assign(maybe=maybe)[["shard", "key", "n", "maybe"]]

        asked = delta.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(ask, "shard int, key binary, n bigint, maybe boolean")
        asked = stored(asked, "line-asked")
        fresh = asked.where(~F.col("maybe")).select("shard", "key", F.col("n").alias("n_docs"))
        met = self.refs.join(asked.where("maybe").select("key", "n"), "key", "full_outer")
        met = met.select(shard_of(self.shards).alias("shard"), "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"))
        refs = stored(met.unionByName(fresh), "line-refs")
        added = refs.join(delta.select("key"), "key", "left_semi").join(self.refs.select("key"), "key", "left_anti")
        return LineIndex(refs, self._changed(refs, added, True), self.shards)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back documents that were inserted before."""
        delta = key_counts(docs)
        met = self.refs.join(delta, "key", "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("n", F.lit(0)))
        met = stored(met.select("shard", "key", "n_docs"), "line-refs")
        refs = met.where("n_docs > 0")
        return LineIndex(refs, self._changed(refs, met.where("n_docs <= 0"), False), self.shards)

    def _changed(self, refs: DataFrame, changed: DataFrame, add: bool) -> DataFrame:
        """Filters after keys came or went; a filter that grows too full is made anew."""

        def change(key, have, keys):
            table = Cuckoo.load(bytes(have["filter"].iloc[0])) if len(have) else Cuckoo(4)
            if len(keys):
                ok = table.insert(words(keys["key"])) if add else table.delete(words(keys["key"])) is None
                if not ok:
                    return pd.DataFrame({"shard": [key[0]], "filter": [None]})
            return pd.DataFrame({"shard": [key[0]], "filter": [table.dump()]})

        made = self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(change, "shard int, filter binary")
        made = stored(made, "line-filters")
        full = made.where("filter IS NULL").select("shard")
        return made.where("filter IS NOT NULL").unionByName(filters_of(refs.join(full, "shard", "left_semi")))

    def drop_lines(self, docs: DataFrame, keep: list[str], min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
        """``keep`` plus n_lines, n_dropped and the kept text (or its SHA-256)."""
        frequent = stored(self.refs.where(F.col("n_docs") >= min_docs).select("key"), "line-frequent")
        n, probe = frequent.count(), None
        # a filter takes 8 bytes a key at most: the count bounds the filters before they are fetched
        if n * 8 <= BROADCAST_BYTES:
            made = filters_of(frequent.withColumn("shard", shard_of(max(1, n // SHARD_KEYS))))
            probe = docs.sparkSession.sparkContext.broadcast([bytes(r["filter"]) for r in made.collect()])
        row = row_key()
        lines = docs.select(row.alias("row"), F.col("text").cast("binary").alias("text"))

        def emit(batches):
            tables = [Cuckoo.load(f) for f in probe.value] if probe else None
            for b in batches:
                rows, pos, key = [], [], []
                for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for i, k in enumerate(keys(t or b"")):
                        if k:
                            rows.append(r)
                            pos.append(i)
                            key.append(k)
                if tables is not None:
                    bits = words(key)
                    ok = np.zeros(len(key), bool)
                    for f in tables:
                        ok |= f.contains(bits)
                    at = np.flatnonzero(ok)
                    rows, pos, key = [rows[i] for i in at], [pos[i] for i in at], [key[i] for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(pos, pa.int32()), pa.array(key, pa.binary())], names=["row", "pos", "key"])

        hits = lines.mapInArrow(emit, "row string, pos int, key binary").join(frequent.select("key"), "key")
        gone = hits.groupBy("row").agg(F.collect_set("pos").alias("__gone")).withColumnRenamed("row", "__row")
        joined = docs.withColumn("__row", row).join(gone, "__row", "left")

        def make():
            def work(texts, gone):
                kept, n, dropped = [], [], []
                for t, g in zip(texts, gone):
                    parts = t.split(b"\n")
                    out = set(g or ())
                    kept.append(b"\n".join([p for i, p in enumerate(parts) if i not in out]) if out else t)
                    n.append(len(parts))
                    dropped.append(len(out))
                text = {"kept_sha256": [sha256(k).hexdigest() for k in kept]} if digest else {"text": [k.decode("utf-8", "replace") for k in kept]}
                return text | {"n_lines": n, "n_dropped": dropped}

            return work

        new = f"n_lines bigint, n_dropped bigint, {'kept_sha256' if digest else 'text'} string"
        return add_columns(joined, keep, new, make, extra=["__gone"])


def filters_of(refs: DataFrame) -> DataFrame:
    """One cuckoo filter per shard; a shard holds about ``SHARD_KEYS`` keys."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "filter": [Cuckoo.of(words(part["key"])).dump()]})

    return stored(refs.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, filter binary"), "line-filters")

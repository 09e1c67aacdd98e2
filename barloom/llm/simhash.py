"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are the majority bits of the XXH64 hashes of a text's word shingles. Two
fingerprints within ``RADIUS`` bits are linked; components of links are the groups.

The 64 bits are grouped into ``PARTS`` partitions of correlated bits (from the exact
co-occurrence of bits over all distinct fingerprints). Thresholds ``t`` of the partitions, -1 for
"not probed", guarantee every pair within RADIUS if ``sum(t + 1) = RADIUS + 1``. For each
fingerprint a dynamic programme over the partitions picks the thresholds of least estimated
cost: the exact size of its own bucket at t = 0, at greater t an estimate from histograms of half
partitions, plus the probes themselves. It then probes all values within t of its own
and verifies what it meets by the distance of the whole fingerprints.

A fingerprint whose probes would meet more than ``CROWD`` others (counted exactly, before any
pair is formed) lies in a crowd of near copies. All crowded ones take the
allocation of one partition of all 64 bits with t = 2, probed from both sides: each posts itself
and its 64 one-bit neighbours, and two of them share a post exactly if they are within two bits. Posts are
reduced to links with the least fingerprint there, so a crowd costs 65 rows a member and no pairs
within it are made. Links between crowded and other fingerprints are found by the others.

Equal fingerprints are one node from the start, so exact copies cost one row. Texts of fewer
words than a shingle are one shingle; without words the fingerprint is zero and links like any
other. Null texts are empty. Null doc_ids link others but name no component (null if no
doc_id is reachable). Rows of one doc_id are kept apart; each gets its own fingerprint.
An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import add_columns, stored
from barloom.llm.components import components

SHINGLE, RADIUS, PARTS, CROWD = 3, 2, 3, 96
CHUNK = 32_768


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` plus ``fp`` (bigint) of every row."""
    return add_columns(docs, keep, "fp bigint", lambda: lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}, text)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(nodes: DataFrame) -> list[list[int]]:
    """The partitions: bits that correlate stand together, sizes as equal as they can be."""

    def co(batches):
        total = np.zeros((64, 64))
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    cells = nodes.select("fp").mapInArrow(co, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    m = np.zeros(4096)
    for r in cells:  # 4,096 sums
        m[r.cell] = r.n
    m = m.reshape(64, 64)
    n = max(1.0, nodes.count())
    p = np.diag(m) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(m / n - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for i in range(PARTS):
        size = -(-len(left) // (PARTS - i))
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            nxt = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def value_of(fp: Column, bits: list[int]) -> Column:
    """The bits of one partition as an integer."""
    out = F.lit(0).cast("bigint")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("bigint")), k))
    return out


class Estimates:
    """Expected rows within 0, 1, 2 bits of a value, from histograms of the two halves of a partition."""

    def __init__(self, width: int, low: np.ndarray, high: np.ndarray, n: int):
        self.cut, self.n = width // 2, max(n, 1)
        self.near = [[h, *self._rings(h)] for h in (low, high)]

    @staticmethod
    def _rings(hist: np.ndarray) -> list[np.ndarray]:
        """Sums of the histogram over all values at one and at two bits."""
        at, bits = np.arange(len(hist)), range(int(np.log2(len(hist))))
        one = sum(hist[at ^ (1 << b)] for b in bits)
        two = sum(hist[at ^ (1 << a) ^ (1 << b)] for a, b in combinations(bits, 2))
        return [one, two]

    def within(self, values: np.ndarray, t: int) -> np.ndarray:
        lo, hi = values & ((1 << self.cut) - 1), values >> self.cut
        return sum(self.near[0][a][lo] * self.near[1][b][hi] for a in range(t + 1) for b in range(t + 1 - a)) / self.n


def masks(width: int, t: int) -> np.ndarray:
    """All differences of at most ``t`` bits in ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def allocate(cost: np.ndarray, total: int = RADIUS + 1) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least cost. cost: (rows, parts, total + 1) by ``t + 1``; the sum of ``t + 1`` is ``total``."""
    rows, parts, _ = cost.shape
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((rows, parts, total + 1), np.int64)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for spent in range(total + 1):
            for t1 in range(spent + 1):
                c = best[:, spent - t1] + cost[:, i, t1]
                better = c < new[:, spent]
                new[better, spent] = c[better]
                took[better, i, spent] = t1
        best = new
    out, spent = np.zeros((rows, parts), np.int64), np.full(rows, total)
    for i in range(parts - 1, -1, -1):
        out[:, i] = took[np.arange(rows), i, spent]
        spent = spent - out[:, i]
    return out - 1, best[:, total]


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within RADIUS bits, one way at least.

    Crowded fingerprints are linked through the least one around a shared post, others pair by pair.
    """
    parts = grouped_bits(nodes)
    named = nodes.select("fp", *[value_of(F.col("fp"), b).alias(f"v{i}") for i, b in enumerate(parts)])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"v{i}").alias("value")) for i in range(PARTS)]))
    posted = stored(named.select("fp", cells.alias("c")).select("fp", "c.part", "c.value"), "posts")
    sizes = stored(posted.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), "post-sizes")

    # histograms of half partitions: at most 2 x 2^11 numbers a partition
    halves = []
    for i, b in enumerate(parts):
        cut = len(b) // 2
        halves += [F.struct(F.lit(2 * i).alias("half"), F.col("value").bitwiseAND((1 << cut) - 1).alias("x")), F.struct(F.lit(2 * i + 1).alias("half"), F.shiftrightunsigned("value", cut).alias("x"))]
    by_part = F.when(F.col("part") == 0, F.array(*halves[:2]))
    for i in range(1, PARTS):
        by_part = by_part.when(F.col("part") == i, F.array(*halves[2 * i : 2 * i + 2]))
    hist = sizes.select("n", F.explode(by_part).alias("h")).groupBy("h.half", "h.x").agg(F.sum("n").alias("n")).collect()
    tables = [np.zeros(1 << (len(b) // 2 if k == 0 else len(b) - len(b) // 2)) for b in parts for k in (0, 1)]
    for r in hist:
        tables[r.half][r.x] = r.n
    n = int(tables[0].sum())
    guess = [Estimates(len(b), tables[2 * i], tables[2 * i + 1], n) for i, b in enumerate(parts)]
    shared = nodes.sparkSession.sparkContext.broadcast((guess, [[masks(len(b), t) for t in range(RADIUS + 1)] for b in parts]))

    own = posted.join(sizes, ["part", "value"]).groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(PARTS)],
        *[F.max(F.when(F.col("part") == i, F.col("value"))).alias(f"v{i}") for i in range(PARTS)],
    )

    def probe(batches):
        guess, around = shared.value
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            fp, size, value = cols[0], cols[1 : 1 + PARTS], cols[1 + PARTS :]
            cost = np.zeros((len(fp), PARTS, RADIUS + 2))
            for i in range(PARTS):
                for t in range(RADIUS + 1):
                    rows = size[i] if t == 0 else np.maximum(size[i], guess[i].within(value[i], t))
                    cost[:, i, t + 1] = rows + len(around[i][t])
            t, _ = allocate(cost)
            out = [[], [], []]
            for i in range(PARTS):
                for k in range(RADIUS + 1):
                    at = np.flatnonzero(t[:, i] == k)
                    near = value[i][at][:, None] ^ around[i][k][None]
                    out[0].append(np.repeat(fp[at], near.shape[1]))
                    out[1].append(np.full(near.size, i, np.int32))
                    out[2].append(near.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["fp", "part", "value"])

    probes = stored(own.mapInArrow(probe, "fp bigint, part int, value bigint"), "probes")
    met = probes.join(sizes, ["part", "value"]).groupBy("fp").agg(F.sum("n").alias("met"))
    crowded = stored(met.where(F.col("met") > CROWD).select("fp"), "crowded")

    light = probes.join(crowded, "fp", "left_anti").select("part", "value", F.col("fp").alias("a"))
    pairs = light.join(posted.withColumnRenamed("fp", "b"), ["part", "value"])
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = pairs.where((F.col("a") != F.col("b")) & (apart <= RADIUS)).select("a", "b").distinct()

    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)])
    posts = stored(crowded.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("post")), "crowd-posts")
    least = posts.groupBy("post").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("post", "b")
    stars = posts.join(least, "post").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def groups(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``keep``, fp, component_id (least doc_id of the component) of every row."""
    return groups_and_links(docs, keep, text, shingle)[0]


def groups_and_links(
    docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text", shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """What ``groups`` gives, and the links (a, b) of fingerprints that made the groups."""
    rows = stored(fingerprints(docs, ["doc_id", *keep], text, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    linked = stored(links(nodes), "links")
    roots = stored(components(linked), "roots")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", *keep, "fp", "component_id"), linked

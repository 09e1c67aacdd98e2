"""Hard negatives by Fagin's threshold algorithm over sharded, per-dimension sorted lists.

Components are integers, ``floor(256 x)``; a score is the integer inner product with an anchor (shorter vectors end in
zeros). An anchor's positives are its ``POSITIVES`` best other rows of its label. Its negatives, for each positive, are the best
``NEGATIVES`` rows of other labels whose score lies in the window from ``LOW`` to ``HIGH`` percent of the positive's.

A shard holds the components of about ``SHARD_ROWS`` rows and, per dimension, the rows in order of that component.
An anchor reads every list from the end that its component's sign prefers (sorted access), scores each row it meets from all
its components (random access) and adds up what the next row of each list could give at most: the threshold.
No row that was not met scores more, so the search of a shard ends once the threshold is strictly below the k-th score
of every window, or below the window itself; ties at that score are met before. Lists are read in steps that double, until
few rows are left. Only rows that can lie in a window are sorted.

Blocks of ``BLOCK`` anchors are dealt to all shards, as a stated query set against all rows in blocks is, and come after their
shard in one task; only k rows a window leave a shard, and ranks are cut before they are shuffled.

Rows whose id, label or vector is null, or which hold a null or non-finite component, take no part. Rows of one id are one
row, that of the least vector, then the least label. Fewer rows than asked: all of them. No rows give no rows. Other columns are not read.
Scores must fit 64 bits; they are summed in double precision only where that is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import forget, stored

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
SHARD_ROWS, BLOCK = 8192, 256
LEFT = 16  #: the rest of a shard is scored at once when it is less than one in so many rows
NEVER = np.int64(-(1 << 62))


def rows_of(df: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec): the rows that take part, with integer components."""
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    v = v.groupBy("id").agg(F.min(F.struct("vec", "label")).alias("r")).select("id", "r.label", "r.vec")
    return v.withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE)))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


class Shard:
    """Rows of a shard and their lists: ``lists[d]`` are the rows by component ``d``, ascending."""

    def __init__(self, ids: bytes, labels: bytes, vecs: bytes, lists: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(vecs, np.int64).reshape(len(self.ids), -1)
        self.lists = np.frombuffer(lists, np.int32).reshape(-1, len(self.ids))
        self.values = np.take_along_axis(self.x.T, self.lists, 1)
        most = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64) if most < 1 << 20 and self.x.shape[1] < 1 << 12 else None

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.real is not None and np.abs(anchor).max(initial=0) < 1 << 20:
            real = anchor.astype(np.float64)
            # many rows are read in one pass, a copy of them costs more than the others' products
            many = 4 * len(rows) > len(self.ids)
            sums = np.einsum("rd,d->r", self.real if many else self.real[rows], real)
            sums = sums[rows] if many else sums
            return sums.astype(np.int64)
        return self.x[rows] @ anchor

    def best(self, anchor: np.ndarray, eligible: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (``low[i]`` <= 100 score <= ``high[i]``): the rows and scores of its k best eligible rows, best first."""
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        up = anchor[dims] > 0
        met, scores = np.zeros(n, bool), np.zeros(n, np.int64)
        depth, step = 0, max(16, n // 32)
        while True:
            deeper = min(n, depth + step) if len(dims) else n
            seen = met.copy()
            if deeper < n:
                seen[self.lists[dims[up], n - deeper : n - depth].ravel()] = True
                seen[self.lists[dims[~up], depth:deeper].ravel()] = True
            if deeper == n or (n - np.count_nonzero(seen)) * LEFT < n:
                seen[:], deeper = True, n  # the few left are scored at once: their lists are longer than they
            fresh = np.flatnonzero(seen & ~met & eligible)
            scores[fresh] = self.scores(fresh, anchor)
            met, depth, step = seen, deeper, 2 * step
            # rows below all windows are not sorted; the others stand by id, as the shard does
            rows = np.flatnonzero(met & eligible & (100 * scores >= low.min()))
            sums = np.sort(100 * scores[rows])
            first, last = np.searchsorted(sums, low, "left"), np.searchsorted(sums, high, "right")
            full = last - first >= k
            kth = np.where(full, sums[np.maximum(last - k, 0)], low) if len(sums) else low
            if depth == n:
                break
            at = np.where(up, n - 1 - depth, depth)
            threshold = int(self.values[dims, at] @ anchor[dims])
            if (100 * threshold < kth).all():
                break
        out, sums = [], 100 * scores[rows]
        for least, most in zip(kth, high):
            held = rows[(sums >= least) & (sums <= most)]
            held = held[np.argsort(-scores[held], kind="stable")][:k]
            out.append((held, scores[held]))
        return out


def shards_of(v: DataFrame, count: int, dims: int) -> DataFrame:
    """One record per shard (shard, ids, labels, vecs, lists)."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = matrix(part["vec"], dims)
        lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        cols = {"ids": part["id"].to_numpy(np.int64), "labels": part["label"].to_numpy(np.int64), "vecs": x, "lists": lists}
        return pd.DataFrame({"shard": [part["shard"].iloc[0]]} | {c: [np.ascontiguousarray(a).tobytes()] for c, a in cols.items()})

    placed = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    packed = placed.groupBy("shard").applyInPandas(pack, "shard int, ids binary, labels binary, vecs binary, lists binary")
    return stored(packed, "sorted-lists")


def over_shards(shards: DataFrame, count: int, anchors: DataFrame, n: int, find, schema: str) -> DataFrame:
    """``find(shard, anchor row)`` for every anchor on every shard.

    A task holds one shard at a time and takes the blocks that follow it: no side is broadcast, since the dealt blocks
    are as many as shards times blocks, and no shard is copied to its blocks.
    """
    blocks = max(1, -(-n // BLOCK))
    row = F.struct("id", "label", "vec", "scores", "others")
    packed = anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(row).alias("anchors"))
    dealt = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    held = shards.withColumn("block", F.lit(-1).cast("bigint"))
    both = held.unionByName(dealt, allowMissingColumns=True)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held, name = None, None
        for b in batches:
            for r in b.itertuples():
                if r.block < 0:
                    held, name = Shard(r.ids, r.labels, r.vecs, r.lists), r.shard
                    continue
                # a shard without rows has no record
                made = [x for a in r.anchors for x in find(held, a)] if r.shard == name else []
                if made:
                    yield pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*made)))))

    return both.repartition(2 * count, "shard").sortWithinPartitions("shard", "block").mapInPandas(run, schema)


def mine(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Hard negatives of the rows where ``is_anchor`` holds (on ``id``): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    v = stored(rows_of(df, label, id_col, vec_col), "mined-rows")
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.count_if(is_anchor).alias("anchors")).first()
    if not facts.anchors:
        return df.sparkSession.createDataFrame([], out)
    dims, count = max(1, facts.dims), max(1, -(-facts.n // SHARD_ROWS))
    shards = shards_of(v, count, dims)
    count = shards.agg(F.max("shard")).first()[0] + 1
    none = F.array().cast("array<bigint>")
    anchors = v.where(is_anchor).withColumns({"scores": none, "others": none})

    def padded(x) -> np.ndarray:
        return np.concatenate([np.asarray(x, np.int64), np.zeros(dims - len(x), np.int64)])

    def positives(shard: Shard, a) -> list:
        eligible = (shard.labels == a["label"]) & (shard.ids != a["id"])
        ((rows, scores),) = shard.best(padded(a["vec"]), eligible, np.array([NEVER]), np.array([-NEVER]), POSITIVES)
        return [(np.full(len(rows), a["id"]), shard.ids[rows], scores)]

    found = over_shards(shards, count, anchors, facts.anchors, positives, "id bigint, other bigint, score bigint")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES)
    best = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "score", "other"))).alias("p"))  # five at most
    best = stored(anchors.select("id", "label", "vec").join(best.select("id", F.col("p.score").alias("scores"), F.col("p.other").alias("others")), "id"), "mined-positives")

    def negatives(shard: Shard, a) -> list:
        scores, eligible = np.asarray(a["scores"], np.int64), shard.labels != a["label"]
        got = shard.best(padded(a["vec"]), eligible, LOW * scores, HIGH * scores, NEGATIVES)
        return [
            (np.full(len(rows), a["id"]), np.full(len(rows), other), np.full(len(rows), score), shard.ids[rows], found)
            for (rows, found), other, score in zip(got, a["others"], scores)
        ]

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = over_shards(shards, count, best, facts.anchors, negatives, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    done = stored(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")
    for x in (v, shards, best):
        forget(x)
    return done

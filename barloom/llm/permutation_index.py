"""Nearest neighbours by inner product through a permutation index.

Vectors are represented by the order of their nearest pivots. A vector ``x`` is lifted by one
component, ``sqrt(M^2 - |x|^2)`` with M the largest norm, so that the largest inner product
is the nearest lifted vector, whatever the norms. Its ``PREFIX`` nearest pivots of ``PIVOTS``
are posted, with their ranks, in the pivots' inverted files; a query ranks rows by the
footrule distance of the permutations, in which a pivot outside the prefix stands at rank
``PREFIX``; that distance falls as the sum of ``PREFIX - max(rank in query, rank in row)``
over shared pivots grows. The ``SHARE`` best rows of a shard, and all that tie
with the last of them, are reranked by the exact inner product.

The index is split by rows: a shard packs about ``SHARD_ROWS`` rows, their vectors and the
inverted files over them into one record. Half of all (pivot, row) pairs are posted, so a file is
stored densely, one byte a row, which is smaller than lists of pairs; a pivot near to a third
of all vectors has one file per shard like any other. Blocks of ``BLOCK`` queries meet every
shard, as stated query sets against all rows in blocks do; the best of each shard are merged.
Pivots are a bounded sample (``PIVOTS`` distinct vectors, the least hashes); every row is indexed.

Recall on the tables is tested against brute force (0.9 at least). Vectors that are null, zero, hold
null or non-finite components, or differ in length from most others take no part, neither as
queries nor as candidates; null ids do not either. Equal scores go to the smaller id. Rows of one id
are one candidate, by the least of their vectors. Fewer candidates than asked: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored

PIVOTS, PREFIX, SHARE, LEAST = 128, 64, 0.15, 256
SHARD_ROWS, BLOCK = 4096, 512


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, part): usable vectors of the commonest length, one row per id, the least vector."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where(F.col("id").isNotNull() & usable(F.col("vec")))
    common = v.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return v.where(F.size("vec") == (common[0].dims if common else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0))[:, None]], 1)


def orders(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The ``PREFIX`` nearest pivots of every row, nearest first."""
    d = (pivots * pivots).sum(1)[None] - 2 * lifted @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :PREFIX]


def pivots_of(v: DataFrame, most: float) -> np.ndarray:
    """A bounded sample of distinct vectors, lifted."""
    drawn = v.select(F.xxhash64("vec").alias("h"), "id").groupBy("h").agg(F.min("id").alias("id")).orderBy("h").limit(PIVOTS)
    kept = v.join(F.broadcast(drawn), "id").orderBy("h").collect()
    return lift(np.array([r.vec for r in kept], np.float64), most)


def build(v: DataFrame, most: float, pivots: np.ndarray, rows: int) -> DataFrame:
    """The index: one record per shard (shard, ids, vecs, files)."""
    shards = max(1, -(-rows // SHARD_ROWS))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = matrix(part["vec"])
        near = orders(lift(x, most), pivots)
        files = np.full((len(pivots), len(x)), PREFIX, np.uint8)
        rank = np.broadcast_to(np.arange(near.shape[1], dtype=np.uint8), near.shape)
        files[near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])] = rank.ravel()
        record = {"shard": [part["shard"].iloc[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()], "files": [files.tobytes()]}
        return pd.DataFrame(record)

    placed = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return stored(placed.groupBy("shard").applyInPandas(pack, "shard int, ids binary, vecs binary, files binary"), "pivot-files")


def search(index: DataFrame, queries: DataFrame, n_queries: int, most: float, pivots: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found rows of other ids."""
    spark = index.sparkSession
    blocks = max(1, -(-n_queries // BLOCK))
    shards = index.count()

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [part["block"].iloc[0]], "qids": [part["id"].to_numpy(np.int64).tobytes()], "qvecs": [matrix(part["vec"]).tobytes()]})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("block").applyInPandas(pack, "block int, qids binary, qvecs binary")
    pairs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1))))).join(index, "shard")
    shared = spark.sparkContext.broadcast(pivots)

    def find(pair: pd.DataFrame) -> pd.DataFrame:
        pivots, out = shared.value, []
        for r in pair.itertuples():
            ids, qids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.qids, np.int64)
            x, q = np.frombuffer(r.vecs).reshape(len(ids), -1), np.frombuffer(r.qvecs).reshape(len(qids), -1)
            files = np.frombuffer(r.files, np.uint8).reshape(-1, len(ids))
            # a query's length does not change which rows are nearest
            near = orders(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
            ranks = np.arange(near.shape[1], dtype=np.uint8)[:, None]
            wanted = min(len(ids), max(LEAST, int(np.ceil(SHARE * len(ids)))))
            for i, qid in enumerate(qids):
                distance = np.maximum(files[near[i]], ranks).sum(0, dtype=np.uint16)
                # all rows that tie with the last of the share are reranked with it
                best = np.flatnonzero(distance <= np.partition(distance, wanted - 1)[wanted - 1])
                best = best[ids[best] != qid]
                score = x[best] @ q[i]
                top = np.lexsort((ids[best], -score))[:k]
                out.append((np.full(len(top), qid), ids[best][top], score[top]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

    found = pairs.groupBy("shard", "block").applyInPandas(find, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Index every usable row of ``df`` and search it for the rows where ``is_query`` holds (on ``id``)."""
    v = stored(vectors(df, id_col, vec_col), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.count_if(is_query).alias("q")).first()
    if not facts.n:
        return v.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    pivots = pivots_of(v, facts.most)
    index = build(v, facts.most, pivots, facts.n)
    return search(index, v.where(is_query), facts.q, facts.most, pivots, k)

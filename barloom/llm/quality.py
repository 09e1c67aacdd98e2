"""Quality classifier: similarity-weighted vote of the nearest labelled documents.

Terms are hashed byte trigrams of the whole text, and one for words that repeat the word
before them (weighted ``REPEATS`` times, as trigrams say little about order). The labelled fit sample (at most
``FIT_ROWS`` rows and ``FIT_BYTES`` of whole texts, in the order of a hash of doc_id, a documented bound) gives term weights and,
by a truncated singular value decomposition, a latent-semantic space of ``LATENT``
dimensions. The labelled vectors are broadcast: FIT_ROWS x LATENT floats, 1 MB. Every
document is projected, its cosines to all labelled vectors come from exact products of
blocks, and the ``NEIGHBOURS`` nearest vote with ``cosine ** POWER`` as weight.

Scoring is one pass over the rows without a shuffle. Null and empty texts have no terms;
their score is the share of label 1 in the fit sample. Without labels of the fit share the
score is 0.5. Cosines count in steps of 1 / ``STEPS``, above the rounding of a matrix product; neighbours of equal cosine
are ranked by their place in the sample, so repeated rows score alike. Rows of null doc_id are scored; they never train.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import add_columns, crc_mod

TERMS, LATENT, NEIGHBOURS, POWER = 4096, 64, 15, 4
REPEATS = 4.0
STEPS = 1 << 20
FIT_ROWS, FIT_BYTES = 4000, 24 << 20
FOLDS = 5


def counts(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of one text, each position counted; the last: repeated words."""
    out = np.zeros(TERMS + 1, np.float32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        h = (h * np.uint32(2654435761)) >> np.uint32(20)
        out[:TERMS] = np.bincount(h, minlength=TERMS)
        words = text.split()
        out[TERMS] = sum(map(eq, words, words[1:]))
    return out


def damped(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    x[..., TERMS] *= REPEATS
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """Latent space and labelled vectors of the fit sample."""
    y = np.asarray(labels, np.float32)
    if not len(y):
        return {"prior": 0.5, "idf": None}
    c = np.stack([counts(t) for t in texts])
    idf = np.log((1 + len(y)) / (1 + (c > 0).sum(0))).astype(np.float32) + 1
    x = damped(c, idf)
    gram = x.T @ x  # TERMS x TERMS: its leading eigenvectors are the latent axes
    rng = np.random.default_rng(0)
    k = min(LATENT, len(y))
    axes = np.linalg.qr(x.T @ rng.standard_normal((len(y), k + 16)).astype(np.float32))[0]
    for _ in range(4):
        axes = np.linalg.qr(gram @ axes)[0]
    small = axes.T @ gram @ axes
    values, turn = np.linalg.eigh(small)
    axes = (axes @ turn[:, np.argsort(-values)[:k]]).astype(np.float32)
    z = x @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return {"prior": float(y.mean()), "idf": idf, "axes": axes, "z": z.astype(np.float32), "y": y}


def vote(model: dict, texts: list[bytes]) -> np.ndarray:
    out = np.full(len(texts), model["prior"])
    if model["idf"] is None:
        return out
    block = 128
    for i in range(0, len(texts), block):
        c = np.stack([counts(t) for t in texts[i : i + block]])
        z = damped(c, model["idf"]) @ model["axes"]
        size = np.linalg.norm(z, axis=1, keepdims=True)
        near = (z / np.maximum(size, 1e-9)) @ model["z"].T
        k = min(NEIGHBOURS, near.shape[1])
        # whole steps of the cosine, then the place from the end: no two neighbours rank alike
        level = np.rint(near.astype(np.float64) * STEPS).astype(np.int64)
        rank = level * near.shape[1] - np.arange(near.shape[1])
        top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        w = np.maximum(np.take_along_axis(level, top, 1) / STEPS, 1e-6) ** POWER
        score = (w * model["y"][top]).sum(1) / w.sum(1)
        some = (c.sum(1) > 0) & (size[:, 0] > 1e-9)
        out[i : i + block][some] = score[some]
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """Labelled documents outside the held-out fold, ``rows`` and ``FIT_BYTES`` at most, in the order of
    a hash: (doc_id, text, __y). Texts are taken whole; only ids and lengths of ``rows`` rows pass the driver here.
    """
    known = labels.select(F.col("doc_id"), F.col(label).alias("__y")).where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(crc_mod(F.col("doc_id"), FOLDS) != 0).dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("__place", F.monotonically_increasing_id())
    spark = docs.sparkSession
    order = {r.doc_id: (r["__place"], r["__y"]) for r in known.collect()}
    if not order:
        return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(0).alias("__y")).where("false")
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in order], docs.select("doc_id").schema))
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(wanted, "doc_id")
    sizes = {r.doc_id: r["size"] for r in sized.groupBy("doc_id").agg(F.sum("size").alias("size")).collect()}
    taken, used = [], 0
    for k in sorted(sizes, key=lambda k: order[k][0]):
        if used + sizes[k] <= FIT_BYTES:
            used += sizes[k]
            taken.append((k, order[k][1]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("__y", T.IntegerType())])
    chosen = F.broadcast(spark.createDataFrame(taken, schema))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id").select("doc_id", "text", "__y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Fit on the bounded sample; repeated doc_ids count once."""
    rows = {r.doc_id: r for r in sample(docs, labels, label).collect()}
    rows = [rows[k] for k in sorted(rows)]
    return fit([bytes(r.text or b"") for r in rows], [r["__y"] for r in rows])


def score(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` plus the score (0 to 1) of every row as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, keep, f"{name} double", lambda: lambda texts: {name: vote(shared.value, texts)})

"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, piece ids.

Every stage works on the whole texts its predecessor kept; extra columns of documents pass through
untouched, whatever their names: all columns but the text travel in one struct. n_chars follows the text where
lines were dropped. Null texts are empty texts, null ids are ids like any other, rows of equal id and text are
one document to the stages that drop documents, empty tables stay empty, texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, line_dedup, ngram_join, pieces, quality, simhash
from barloom.llm.common import new_path, ready, row_key, stored, table
from barloom.llm.components import components

QUALITY = 0.3  #: documents that score less are rejected
SHINGLE = 5  #: words of a shingle of near copies


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, all columns in one struct: operators' own columns meet no others."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"__rest.`{c}`").alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ready(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(packed(docs), model, ["doc_id", "text", "__rest"], "__quality")
    return unpacked(scored.where(F.col("__quality") >= QUALITY), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten of them hold."""
    ready(spark)
    index = line_dedup.LineIndex.build(docs)
    out = unpacked(index.drop_lines(packed(docs), ["doc_id", "__rest"]), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, Jaccard similarity of 0.8 or more, of their sets or multisets.

    No radius of 64 bits holds all texts of that similarity, so the exact join finds all pairs of similar sets; pairs of
    SimHash groups are compared first. A fingerprint stands for a multiset: texts whose fingerprints link and
    whose sets are apart (a passage many times over, with other ends) are copies if their multisets are that similar.
    A fingerprint's texts are compared with the one of least key, linked fingerprints by these. Only exact similarities
    link. The least doc_id of a group stays (a null id only where there is no other), of rows of that id the least text key, of rows of
    that id and text the one whose other columns come first as JSON. Texts without words are one group.
    """
    ready(spark)
    rows = packed(docs).withColumns({"__row": row_key(), "key": ngram_join.text_key()})
    met, links = simhash.groups_and_links(rows, ("key",), shingle=SHINGLE)
    met = stored(met.select("key", "fp", "component_id").distinct(), "copy-groups")
    least = met.groupBy("component_id").agg(F.min("key").alias("a"))
    seeds = stored(met.join(least, "component_id").where("key <> a").select("a", F.col("key").alias("b")).distinct(), "copy-seeds")
    found = stored(ngram_join.similar_texts(rows, seeds=seeds), "near-copies")
    found = with_bags(rows, found, met, links)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    kept = found.groupBy("root").agg(one).select(F.concat_ws(":", F.coalesce(F.col("one.doc_id").cast("string"), F.lit("none")), "one.key").alias("__row"))
    single = rows.join(stored(kept, "kept"), "__row", "left_semi").groupBy("__row")
    single = single.agg(F.min_by(F.struct("text", "__rest"), F.to_json("__rest")).alias("r")).select("r.text", "r.__rest")
    return unpacked(single, docs.columns)


def with_bags(rows: DataFrame, found: DataFrame, met: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` with one root for components that SimHash links by texts of similar multisets; ``met``: (key, fp) of the texts."""
    lead = met.groupBy("fp").agg(F.min("key").alias("lead"))
    same = met.join(lead, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    a, b = (lead.select(F.col("fp").alias(x), F.col("lead").alias(f"key_{x}")) for x in "ab")
    across = links.join(a, "a").join(b, "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    roots = found.where("n > 0").select("key", "root").distinct()
    a, b = (roots.select(F.col("key").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = stored(same.unionByName(across).join(a, "a").join(b, "b").where("root_a <> root_b").distinct(), "copy-bags")
    if apart.isEmpty():
        return found
    texts = rows.select("key", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    near = ngram_join.similar_bags(texts, apart.select("a", "b").distinct())
    more = components(apart.join(near, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    more = stored(more.select(F.col("node").alias("root"), F.col("root").alias("whole")), "copy-roots")
    return found.join(more, "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of equal id and text stay or go together."""
    ready(spark)
    found = decontaminate.found(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("row").alias("__row")).distinct()
    rows = packed(docs).withColumn("__row", row_key())
    return unpacked(rows.join(stored(found, "contaminated"), "__row", "left_anti"), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number and the decoded text of the whole kept texts."""
    ready(spark)
    return pieces.encode(docs, ["doc_id"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: A trained classifier, XXH64 fingerprints and piece ids are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import arrow_ids, collocations, decontaminate, hard_negatives, language_model, line_dedup, ngram_join, permutation_index, pieces, quality, secrets, simhash, toxicity
from barloom.llm.common import crc_mod, table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the recurrent network."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return judged(toxicity.score(docs, model, ["doc_id"]), 0.5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold leave every document."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.LineIndex.build(docs).drop_lines(docs, ["doc_id"], digest=True)


LINES_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
  l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM d),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
  m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, scanned once per blob and rule version."""
    return secrets.per_document(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model likelihood of every document."""
    return language_model.scores(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the vote of its nearest labelled documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return judged(quality.score(docs, model, ["doc_id"]), 0.3)


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with their best place."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.marked(docs, benchmark, ["doc_id"])


def op9_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as Arrow sequence files and read back."""
    return arrow_ids.read(*arrow_ids.write(table(spark, sf_dir, "documents")))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the decoded text."""
    return pieces.digests(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, relabelled)


NEGATIVES_SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c AS (SELECT id, label, unnest(vec) AS x, unnest(range(len(vec))) AS d FROM v),
  s AS (SELECT a.id AS anchor_id, b.id, any_value(a.label) = any_value(b.label) AS same, sum(a.x * b.x)::BIGINT AS score
    FROM c a JOIN c b ON a.d = b.d AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY a.id, b.id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its component under Jaccard similarity."""
    found = ngram_join.similar_texts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


SHINGLES_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
  g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
  r AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.node = p.a)
SELECT s.doc_id, len(any_value(s.grams))::BIGINT AS n_shingles, min(r.node) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
  g AS (SELECT lang, 1 AS k, unnest(words) AS gram FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) FROM w),
  f AS MATERIALIZED (SELECT lang, k, gram, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
  t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS MATERIALIZED (SELECT lang, k, gram, f, string_split(gram, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
  u AS (SELECT lang, gram, f, 1 AS cut, words[1] AS first, array_to_string(words[2:], ' ') AS rest FROM c
    UNION ALL SELECT lang, gram, f, 2, words[1] || ' ' || words[2], words[3] FROM c WHERE k = 3),
  s AS (SELECT u.lang, u.gram, cut, u.f AS a, y.f AS l, z.f AS r, 1000000 * u.f * u.f // (y.f * z.f) AS score
    FROM u JOIN f y ON y.lang = u.lang AND y.gram = u.first JOIN f z ON z.lang = u.lang AND z.gram = u.rest),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
  d AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, words[1] || ' ' || words[2] AS part FROM c WHERE k = 3
    UNION ALL SELECT lang, f, words[2] || ' ' || words[3] FROM c WHERE k = 3) GROUP BY lang, part),
  o AS (SELECT b.lang, gram AS phrase, a, l, r, score FROM b LEFT JOIN d ON d.lang = b.lang AND d.part = b.gram
    WHERE d.f IS NULL OR 100 * d.f < 50 * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN t ON o.lang = t.lang
QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


QUERIES = {f.__name__: f for f in (op1_permutation_index, op2_toxicity, op3_simhash, op4_line_dedup, op5_secrets, op6_language_model, op7_quality, op8_decontaminate, op9_arrow_ids, op10_pieces, op11_hard_negatives, op12_ngram_join, op13_collocations)}
ORACLES: dict[str, str] = {"op4_line_dedup": LINES_SQL, "op5_secrets": secrets.SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_ngram_join": SHINGLES_SQL, "op13_collocations": COLLOCATIONS_SQL}

"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is reduced to the address of its content (SHA-256). The ledger
keeps, as tables in the shared folder, which (blob, rule version) pairs were scanned and the
spans found. A scan takes only pairs that are not in it, one text per blob, and findings are
joined back to all paths. A rule version is the digest of its pattern, so a changed rule is
scanned anew over all blobs and the others are not.

A scan writes its findings before it marks its pairs, both under the scan's own id, and
findings without a mark are ignored: a job that is lost half-way is simply repeated. Only
DataFrame functions run. Texts that hold no match of a rule cost one search; of the others
the pieces between matches give the positions, summed per blob and rule in a window.

Copies are scanned once, whatever their number. Findings of one blob are as many as its text
holds. A blob with a third of all paths only appears as short rows in the join back, where
adaptive execution splits them. Null text is the empty text; repeated rows each get their
result; an empty table gives an empty result; columns other than path and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import new_path


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, kept where ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


# The rules of the contract, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RULES = (Rule("assign", ASSIGN, 2, 12), Rule("access", ACCESS, 0, 18), Rule("hex", HEX, 0, 16))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def narrowed(rule: Rule) -> str:
    """The pattern searched for. A run of one class is matched whole, so its least length can
    stand in the pattern: the matches are those that pass the length."""
    if rule.pattern == HEX:
        return f"[0-9a-f]{{{rule.least},}}"
    if rule.pattern == ACCESS:
        return f"AKIA[A-Z0-9]{{{max(1, rule.least - 4)},}}"
    return rule.pattern


class Ledger:
    """Tables ``findings`` and ``scanned`` of a folder; reading sees completed scans only."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_path(spark, "blob-ledger")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(schema).parquet(path)

    def scanned(self) -> DataFrame | None:
        return self._read("scanned", "scan string, blob string, version string")

    def findings(self) -> DataFrame:
        """(blob, kind, version, start, end) of completed scans."""
        schema = "scan string, blob string, kind string, version string, start long, end long"
        found, marks = self._read("findings", schema), self.scanned()
        if found is None or marks is None:
            return self.spark.createDataFrame([], "blob string, kind string, version string, start long, end long")
        return found.join(marks, ["scan", "blob", "version"], "left_semi").drop("scan")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
        """Scan the blobs of ``versions`` for the rules they were not scanned for yet."""
        scan = new_path(self.spark, "").rpartition("-")[2]
        named = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        marks = self.scanned()
        if marks is None:
            todo = named.dropDuplicates(["blob"])
            pairs = named.select("blob").distinct().select(F.lit(scan).alias("scan"), "blob", F.explode(F.array(*[F.lit(r.version) for r in rules])).alias("version"))
        else:
            every = named.select("blob").distinct().select("blob", F.explode(F.array(*[F.lit(r.version) for r in rules])).alias("version"))
            pairs = every.join(marks.select("blob", "version"), ["blob", "version"], "left_anti").withColumn("scan", F.lit(scan))
            missing = pairs.groupBy("blob").agg(F.collect_set("version").alias("versions"))
            todo = named.dropDuplicates(["blob"]).join(missing, "blob")
        self._spans(todo, rules, marks is not None).select(F.lit(scan).alias("scan"), "blob", "kind", "version", "start", "end").write.mode("append").parquet(f"{self.folder}/findings")
        pairs.select("scan", "blob", "version").write.mode("append").parquet(f"{self.folder}/scanned")

    def _spans(self, blobs: DataFrame, rules: tuple[Rule, ...], partly: bool) -> DataFrame:
        """(blob, kind, version, start, end) of the passing matches, in code points."""
        found = []
        for r in rules:
            pattern = narrowed(r)
            whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
            gaps = F.transform(F.split("text", pattern, -1), F.length)
            sizes = F.transform(whole, F.length)
            own = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(r.group)), F.length) if r.group else sizes
            hit = F.col("text").rlike(pattern)
            if partly:
                hit = hit & F.array_contains("versions", r.version)
            zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), own.alias("own"))
            found.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(hit, zipped).alias("m")))
        ruled = blobs.select("blob", F.explode(F.array(*found)).alias("r")).where(F.col("r.m").isNotNull())
        each = ruled.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.m").alias("i", "m"))
        before = Window.partitionBy("blob", "kind", "version").orderBy("i")
        end = F.sum(F.col("m.gap").cast("long") + F.coalesce(F.col("m.size").cast("long"), F.lit(0))).over(before)
        placed = each.withColumn("end", end).where(F.col("m.own") >= F.col("least"))
        return placed.select("blob", "kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end")


def by_path(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Per version of a path: its blob and the sorted spans of the rules' present versions."""
    place = {r.kind: i for i, r in enumerate(rules)}
    ranked = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    wanted = [r.version for r in rules]
    spans = ledger.findings().where(F.col("version").isin(wanted)).withColumn("rank", ranked[F.col("kind")])
    per_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    return versions.select(F.col(path).alias("doc_id"), blob_of(F.col(text)).alias("blob")).join(per_blob, "blob", "left")


def joined(spans: Column) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(text, ","), F.lit(""))


def per_document(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Counts and span digests of every document, scanned through the ledger."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs)
    found = by_path(docs, ledger)
    n = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0))
    counts = [F.when(F.col("spans").isNull(), 0).otherwise(n(r.kind)).cast("long").alias(f"n_{r.kind}") for r in RULES]
    text = joined(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


# The pieces between matches and the matches alternate, so running sums of lengths give the spans.
_SQL_KIND = """SELECT doc_id, {rank} AS rank, '{kind}' AS kind, i, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS start,
    length(whole[i]) AS size, length(own[i]) AS own FROM (SELECT doc_id, gaps, whole, own, unnest(range(1, len(whole) + 1)) AS i FROM
    (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS own FROM d))"""
_ANY = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN_SQL = _ANY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
  {_SQL_KIND.format(rank=0, kind='assign', pattern=_ASSIGN_SQL, group=2)} UNION ALL
  {_SQL_KIND.format(rank=1, kind='access', pattern=ACCESS, group=0)} UNION ALL
  {_SQL_KIND.format(rank=2, kind='hex', pattern=HEX, group=0)}),
s AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM m WHERE own >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 ELSE 16 END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

An item of ``L`` words has ``n`` shingles of ``SHINGLE`` words (a shorter one has one shingle, all its
words). A document holds it if some window of ``n`` shingles has a weighted Jaccard similarity of
``SIMILARITY`` or more, shingles weighted by how often they occur.

1. Seeds. Such a window shares all but a ninth of its shingles with the item, so among every ``STRIDE``-th
   shingle of the text one at least is the item's (``stride_of`` gives the largest step for which that holds).
   Only documents with a seed go on, and only windows that start at a shared shingle and hold enough of them: a
   best window starts at one. This loses no window of the required similarity.
2. Each of these windows gets a fingerprint, the majority bits of its shingle hashes. Distinct fingerprints meet
   the items' of their own size in ``BLOCKS`` blocks: two that differ in at most ``RADIUS`` bits differ in at most
   ``RADIUS // BLOCKS`` bits of some block, and the items post every value that near, so none is missed.
   A passage in many documents is one fingerprint there.
3. Windows are verified against the items they met by the exact similarity of their shingle multisets.

``RADIUS`` follows from the similarity: two multisets of ``n`` with 8/9 in common are 64 * acos(8/9) / pi = 9.7 bits apart
on average with a deviation of 2.9; 23 bits are 4.8 deviations, about one window in 10^6 at the very bound.

All on DataFrame functions. The items' shingles are broadcast if their counted number is at most ``SMALL``, likewise
the keys of seeded documents; beyond that the joins shuffle. A passage in a third of all documents
adds rows in proportion to its places: items are one row on the other side of each join.

Words are cut at ASCII white space and lowered. Null and empty texts hold nothing, null and empty items are nowhere;
items of equal text are one, named by the least id. A text shorter than the item is one window. Repeated
rows get the same result; ties go to the least item id, then the first place; empty tables give empty results.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import row_key, stored

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 23, 8
WIDTH = 64 // BLOCKS
SMALL = 200_000
_LANES = 0x0000000100000001


def words(text: Column) -> Column:
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(clean != "", F.split(clean, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(w: Column, size: int, step: Column | None = None) -> Column:
    """Hashes of the word shingles at every ``step``-th place of the words ``w``."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - size, F.lit(1) if step is None else step), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, each).otherwise(F.array().cast("array<bigint>"))


def needed(both: Column | int):
    """Shared shingles without which two multisets of ``both`` in sum are less similar than asked."""
    share = SIMILARITY / (1 + SIMILARITY)
    return ceil(share * both - 1e-9) if isinstance(both, int) else F.ceil(F.lit(share) * both - 1e-9).cast("int")


def stride_of(sizes: list[int]) -> int:
    """The largest step at which every similar window of these sizes has a shared shingle."""
    holds = lambda step: all(n // step > n - needed(2 * n) for n in sizes)
    return max([s for s in range(1, 9) if holds(s)], default=1)


def fingerprint(grams: Column) -> Column:
    """Bits set in over half of an array of hashes; two counters of 32 bits are summed at a time."""
    n, zero = F.size(grams), F.lit(0).cast("bigint")

    def counted(s: int) -> Column:
        return F.aggregate(grams, zero, lambda a, g: a + F.shiftrightunsigned(g, s).bitwiseAND(F.lit(_LANES)))

    bits = []
    for s in range(32):
        both = counted(s)
        low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32)
        bits += [(s, low), (s + 32, high)]
    out = zero
    for place, count in bits:
        out = out.bitwiseOR(F.shiftleft((2 * count > n).cast("bigint"), place))
    return out


def blocks(fp: Column) -> Column:
    """The blocks of a fingerprint with their numbers."""
    cut = [F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for k in range(BLOCKS)]
    return F.array(*[F.struct(F.lit(k).alias("block"), c.alias("value")) for k, c in enumerate(cut)])


def met(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(n, fp, item): window fingerprints within ``RADIUS`` bits of an item of their size."""
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << WIDTH) - 1)), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)
    keys = items.select("item", "n", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("b"))
    keys = keys.select("item", "n", "item_fp", "b.block", "b.value", F.explode(near).alias("mask"))
    keys = keys.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    posts = windows.select("n", "fp").distinct().select("n", "fp", F.explode(blocks(F.col("fp"))).alias("b"))
    pairs = posts.select("n", "fp", "b.block", "b.value").join(hinted(stored(keys, "item-keys")), ["n", "block", "value"])
    close = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return stored(close.select("n", "fp", "item").distinct(), "met")


def hinted(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, size, grams, n, fp): distinct item texts, the words of a shingle and the number of shingles."""
    cut = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    named = cut.groupBy("w").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("w"))
    sized = named.withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    grams = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("w"), k)) for k in range(1, SHINGLE + 1)])
    made = stored(sized.select("item", "item_id", "size", grams.alias("grams")), "items")
    return made.withColumns({"n": F.size("grams"), "fp": fingerprint(F.col("grams"))})


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, start, similarity): per row key and item its most similar window."""
    items = stored(items_of(benchmark), "item-prints")
    sizes = items.groupBy("size").agg(F.collect_set("n").alias("n")).orderBy("size").collect()
    rows = docs.select(row_key().alias("row"), F.col("text"))
    parts = [of_size(rows, items.where(F.col("size") == s["size"]), s["size"], s["n"]) for s in sizes]
    if not parts:
        return docs.sparkSession.createDataFrame([], "row string, item_id bigint, start int, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def of_size(rows: DataFrame, items: DataFrame, size: int, numbers: list[int]) -> DataFrame:
    """``found`` for the items whose shingles have ``size`` words."""
    counts = items.select("item", "n", F.explode("grams").alias("gram")).groupBy("item", "n", "gram").agg(F.count(F.lit(1)).alias("times"))
    counts = stored(counts, "item-grams")
    seeds = hinted(counts.select("gram").distinct())
    cut = rows.select("row", words(F.col("text")).alias("w"))
    # a text shorter than an item is read at every place: the guarantee of the step is for whole windows
    step = F.when(F.size("w") < size + max(numbers), 1).otherwise(stride_of(numbers))
    probes = cut.select("row", F.explode(shingles(F.col("w"), size, step)).alias("gram"))
    seeded = stored(probes.join(seeds, "gram", "left_semi").select("row").distinct(), "seeded")
    texts = rows.join(hinted(seeded), "row", "left_semi").select("row", words(F.col("text")).alias("w"))
    texts = texts.select("row", shingles(F.col("w"), size).alias("all")).dropDuplicates(["row"])
    texts = stored(texts, "seeded-grams")

    # places of the items' shingles, then the starts around which enough of them stand
    placed = texts.select("row", F.size("all").alias("length"), F.posexplode("all").alias("pos", "gram"))
    hits = placed.join(hinted(counts.select("gram", "item", "n")), "gram")
    runs = hits.groupBy("row", "item", "n", "length").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    runs = runs.withColumns({"m": F.least("n", "length"), "need": needed(F.col("n") + F.least("n", "length"))}).where(F.size("at") >= F.col("need"))
    near = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda j: F.get("at", j + F.col("need") - 1) < F.get("at", j) + F.col("n"))
    starts = F.array_distinct(F.transform(near, lambda j: F.least(F.get("at", j), F.col("length") - F.col("m"))))
    cells = runs.select("row", F.explode(starts).alias("start"), "n", "m").distinct()
    per_row = cells.groupBy("row").agg(F.collect_list(F.struct("start", "n", "m")).alias("cells"))
    cutout = F.transform("cells", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.slice(F.col("all"), c["start"] + 1, c["m"]).alias("grams")))
    windows = per_row.join(texts, "row").select("row", F.explode(cutout).alias("c")).select("row", "c.start", "c.n", "c.grams")
    windows = stored(windows.withColumn("fp", fingerprint(F.col("grams"))), "windows")

    # exact similarity of the multisets of what the blocks met
    pairs = windows.join(hinted(met(windows, items)), ["n", "fp"])
    held = pairs.select("row", "start", "n", "item", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    held = held.groupBy("row", "start", "n", "m", "item", "gram").agg(F.count(F.lit(1)).alias("own"))
    shared = held.join(hinted(counts), ["item", "n", "gram"]).groupBy("row", "start", "n", "m", "item").agg(F.sum(F.least("own", "times")).alias("both"))
    alike = (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("similarity")
    sure = shared.select("row", "start", "n", "item", alike).where(F.col("similarity") >= SIMILARITY)
    best = sure.groupBy("row", "item").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    named = best.join(items.select("item", "item_id"), "item")
    return named.select("row", "item_id", (-F.col("b.col2")).cast("int").alias("start"), "b.similarity")


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus contaminated, n_items, item_id, start and similarity of the best place (null if none)."""
    new = ("contaminated", "n_items", "item_id", "start", "similarity")
    ranked = F.struct("similarity", (-F.col("item_id")).alias("i"), (-F.col("start")).alias("s"))
    per_row = found(docs, benchmark).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max(ranked).alias("b"))
    per_row = stored(per_row, "contaminated").withColumnRenamed("row", "__row")
    carried = [F.col(f"`{c}`") for c in keep if c not in new]
    joined = docs.select(*carried, row_key().alias("__row")).join(hinted(per_row), "__row", "left")
    return joined.select(
        *carried,
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).alias("n_items"),
        (-F.col("b.i")).alias("item_id"),
        (-F.col("b.s")).alias("start"),
        F.col("b.similarity").alias("similarity"),
    )

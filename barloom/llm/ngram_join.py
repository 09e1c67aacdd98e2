"""N-gram Jaccard join: all texts whose sets of word shingles have a Jaccard similarity of 4/5 or more.

A text is the set of the hashes of its shingles of ``SHINGLE`` words (A-Z lower-cased; a shorter text has one
shingle, all its words; a text without words has none and links with nothing). Equal sets are one *node*.

Grouped prefix join. Shingles have one common order: rare ones by hash, those met often by how often. Of two sets
with the similarity, the first ``n - ceil(4 n / 5) + 1`` shingles of each share one. Nodes of identical prefixes
and size collapse into one *group*; a group posts its prefix once. Posts are dealt by shingle in the only
exchange of all posts, and only what shares a shingle leaves it. Group pairs pass if size and position
allow the similarity; they expand to members, whose parity sketches give an upper bound of the overlap; what is
left is compared by the sets themselves, made from the whole texts.

Only components count, so pairs of one component need no comparison. A shingle of at most ``FEW``
groups gives its pairs at once. In a greater one all groups are compared with two of them, members of a group with its
least; then all pairs that are still in different components are compared, first their sketches, the posts of a shingle
in blocks of about ``BLOCK`` nodes, each pair of blocks a task's worth of its own. No pair is left out.

Rows that repeat an id or a text are rows of one node; null texts are empty; a null id gets the least id of its
component, if there is one. No rows give no rows. Other columns, whatever their names, are not read. Long texts are
hashed in parts; their sets are as long as they are, one text at a time. The sets are of 64-bit hashes: two different
shingles of one pair that collide (below 1e-12 a pair) would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch_rows, forget, stored
from barloom.llm.components import components
from barloom.llm.words import mix, shingle_bags, shingle_sets

SHINGLE, FEW, BLOCK = 5, 64, 4096
#: Shingles that are ordered by how often they are met: a bound of what is broadcast. Any order is right.
FREQUENT = 1 << 18
WINDOW, LOCAL_TIMES, LEAST_BITS, MOST_FILTER_BITS = 1 << 20, 3, 512, 1 << 27


def needed(n: int) -> int:
    """Shingles that a set of ``n`` shares with any similar one, at least."""
    return -(-4 * n // 5)


def name(values: np.ndarray, seed: int) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(values.tobytes(), seed)
    return x - (1 << 64) if x >> 63 else x


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by their low bits: differing bits are at most the differing shingles."""
    bits = max(LEAST_BITS, 1 << int(2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def sketches_allow(a: bytes, b: bytes, sizes: int) -> bool:
    """Whether sets of together ``sizes`` shingles may be similar, by their sketches."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= sizes - 2 * -(-4 * sizes // 9)


def batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    made = [c if isinstance(c, pa.Array) else pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(made, names=[f[0] for f in fields])


FACTS = "doc_id bigint, key bigint, node bigint, n int, sketch binary, gram bigint, times bigint"


def facts_of(texts: DataFrame) -> DataFrame:
    """One row per text (a node's sketch comes with its first text in a task), and counts of shingles a task meets often."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(held), return_counts=True)
        grams, times = grams[times >= LOCAL_TIMES].view(np.int64), times[times >= LOCAL_TIMES]
        none = [None] * len(grams)
        return batch(FACTS, none, none, none, none, none, grams, times)

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        for b in batches:
            sets, nodes, marks = shingle_sets(b.column(2), SHINGLE), [], []
            for g in sets:
                node = name(g, 7)
                nodes.append(node)
                marks.append(None if node in seen or not len(g) else sketch(g))
                if node not in seen:
                    seen.add(node)
                    held.append(g)
                    size += len(g)
            none = [None] * len(nodes)
            yield batch(FACTS, b.column(0), b.column(1), nodes, [len(g) for g in sets], marks, none, none)
            if size >= WINDOW:
                yield often(held)
                held, size = [], 0
        if size:
            yield often(held)

    return texts.mapInArrow(run, FACTS)


def frequent(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count), by shingle: the ``FREQUENT`` most met or fewer, cut at a power of two."""
    sums = facts.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") > FEW)
    sums = stored(sums, "join-frequent")
    classes = sums.groupBy(F.floor(F.log2("times")).alias("c")).count().orderBy(F.desc("c")).collect()
    held, least = 0, 64
    for r in classes:
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.c
    rows = sums.where(F.floor(F.log2("times")) >= least).collect()
    forget(sums)
    grams = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r.times for r in rows], np.int64)[order]


POSTS = "gram bigint, grp bigint, n int, pos int"


def posts_of(texts: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Posts of the groups' prefixes; a node's group as a post of the node at position -1. Each once a task."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def ordered(grams: np.ndarray) -> np.ndarray:
        often, times = shared.value
        if not len(often):
            return grams
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        return grams[np.argsort(np.where(often[at] == grams, times[at], 0), kind="stable")]

    def run(batches):
        nodes: set[int] = set()
        groups: set[int] = set()
        for b in batches:
            grams, sizes, grps, counts = [], [], [], []
            for g in shingle_sets(b.column(2), SHINGLE):
                node = name(g, 7)
                if node in nodes or not len(g):
                    continue
                nodes.add(node)
                prefix = ordered(g)[: len(g) - needed(len(g)) + 1].view(np.int64)
                group = name(prefix, len(g))
                grams.append(np.array([node]))
                if group not in groups:
                    groups.add(group)
                    grams.append(prefix)
                sizes.append(sum(len(x) for x in grams) - sum(sizes))
                grps.append(group)
                counts.append(len(g))
            if grams:
                first = np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield batch(POSTS, np.concatenate(grams), np.repeat(np.array(grps, np.int64), sizes), np.repeat(np.array(counts), sizes), np.arange(len(first)) - first - 1)

    return texts.mapInArrow(run, POSTS)


MET = "kind tinyint, a bigint, b bigint, n int, pos int"
MEMBER, PAIR, CROWD = 0, 1, 2


def allowed(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` may be similar if the shingle at these positions is the first they share."""
    return (9 * np.minimum(n - pos, m - at) >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[dict, np.ndarray, bool]]:
    """Rows in pieces that end with a bucket (runs of equal ``gram``): (columns, run ids, whole); a bucket of over ``most`` rows
    comes alone, in pieces of which ``whole`` is False."""
    kept, open_crowd = None, None
    for b in batches:
        rows = {f: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(b.schema.names)}
        rows = rows if kept is None else {k: np.concatenate([kept[k], v]) for k, v in rows.items()}
        kept = None
        gram = rows["gram"]
        if not len(gram):
            continue
        if open_crowd is not None:
            n = int(np.searchsorted(gram != open_crowd, True)) if (gram != open_crowd).any() else len(gram)
            if n:
                yield {k: v[:n] for k, v in rows.items()}, np.zeros(n, np.int64), False
                rows = {k: v[n:] for k, v in rows.items()}
                gram = rows["gram"]
            if not len(gram):
                continue
            open_crowd = None
        last = int(np.flatnonzero(gram == gram[-1])[0])
        if last:
            done = {k: v[:last] for k, v in rows.items()}
            yield done, np.cumsum(np.concatenate([[0], done["gram"][1:] != done["gram"][:-1]])), True
        rest = {k: v[last:] for k, v in rows.items()}
        if len(rest["gram"]) > most:
            open_crowd = rest["gram"][0]
            yield rest, np.zeros(len(rest["gram"]), np.int64), False
        else:
            kept = rest
    if kept is not None:
        yield kept, np.zeros(len(kept["gram"]), np.int64), True


def meet(posts: DataFrame) -> DataFrame:
    """What shares a shingle: members of groups, group pairs, posts of crowds (shingles of over ``FEW`` groups)."""

    def out(kind, a, b, n=None, pos=None):
        zero = np.zeros(len(a), np.int64)
        return batch(MET, zero + kind, a, b, zero if n is None else n, zero if pos is None else pos)

    def run(batches):
        def plain():
            for b in batches:
                member = b.column(3).to_numpy() < 0
                if member.any():
                    found = b.filter(pa.array(member))
                    waiting.append(out(MEMBER, found.column(0), found.column(1), found.column(2)))
                yield b.filter(pa.array(~member))

        waiting: list[pa.RecordBatch] = []
        for rows, run_of, whole in buckets(plain(), 1 << 16):
            yield from waiting
            waiting.clear()
            new = np.ones(len(run_of), bool)
            new[1:] = (run_of[1:] != run_of[:-1]) | (rows["grp"][1:] != rows["grp"][:-1])
            run_of = run_of[new]
            gram, grp, n, pos = (rows[c][new].astype(np.int64) for c in ("gram", "grp", "n", "pos"))
            size = np.bincount(run_of)[run_of] if len(run_of) else run_of
            crowd = (size > FEW) | (not whole)
            if crowd.any():
                yield out(CROWD, gram[crowd], grp[crowd], n[crowd], pos[crowd])
            few = (size > 1) & ~crowd
            run_of, grp, n, pos = run_of[few], grp[few], n[few], pos[few]
            left, right = [], []
            for d in range(1, FEW):
                same = np.flatnonzero(run_of[d:] == run_of[:-d])
                if not len(same):
                    break
                same = same[allowed(n[same], pos[same], n[same + d], pos[same + d])]
                left.append(np.minimum(grp[same], grp[same + d]))
                right.append(np.maximum(grp[same], grp[same + d]))
            if left and sum(map(len, left)):
                pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
                yield out(PAIR, pairs[:, 0], pairs[:, 1])
        yield from waiting

    dealt = posts.repartition("gram").sortWithinPartitions("gram", "n", "grp")
    return dealt.mapInArrow(run, MET)


def by_sketch(pairs: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node pairs (a, b) that sketches allow, and (node, key) of their texts."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = facts.where("sketch is not null").select("node", "key", "n", "sketch").join(met, "node", "left_semi")
    known = stored(known.groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "join-sketches")
    a, b = (known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "sa", "sb")

    def run(batches):
        for x in batches:
            sizes, sa, sb = (x.column(i).to_pylist() for i in (2, 3, 4))
            yield x.select([0, 1]).filter(pa.array([sketches_allow(*y) for y in zip(sa, sb, sizes)], pa.bool_()))

    near = stored(both.mapInArrow(run, "a bigint, b bigint"), "join-near")
    met = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = stored(known.select("node", "key").join(met, "node", "left_semi"), "join-keys")
    forget(known)
    return near, keys


def texts_by_key(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, text) of the wanted keys; a bitmap of their hashes keeps other texts out of the exchange."""
    count = keys.count()
    bits = min(MOST_FILTER_BITS, max(1 << 15, 1 << (16 * count).bit_length()))
    bit = F.pmod(F.xxhash64("key"), F.lit(bits))
    rows = keys.select(bit.alias("h")).groupBy((F.col("h") / 32768).cast("int").alias("slice"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in rows.agg(F.bitmap_construct_agg((F.col("h") % 32768)).alias("bits")).collect():  # 16 MB at most
        bitmap[r["slice"] * 4096 : (r["slice"] + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        held, seen = shared.value, set()
        for b in batches:
            h, keep = b.column(2).to_numpy(), np.zeros(b.num_rows, bool)
            maybe = np.flatnonzero(held[h >> 3] >> (h & 7).astype(np.uint8) & 1)
            for i, k in zip(maybe, b.column(0).to_numpy()[maybe].tolist()):
                if k not in seen:
                    seen.add(k)
                    keep[i] = True
            yield b.select([0, 1]).filter(pa.array(keep))

    found = texts.select("key", "text", bit.alias("h")).mapInArrow(run, "key bigint, text binary")
    return found.join(keys, "key").dropDuplicates(["key"]).select("node", "text")


def verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """The node pairs (a, b) whose sets are similar, by the sets themselves."""
    near, keys = by_sketch(pairs, facts)
    held = stored(texts_by_key(texts, keys), "join-texts")
    a, b = (held.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")

    def run(batches):
        last, grams = None, None
        for x in batches:
            keep = []
            for i, (a, b) in enumerate(zip(x.column(0).to_pylist(), x.column(1).to_pylist())):
                if last != a:
                    (grams,), last = shingle_sets(x.column(2).slice(i, 1), SHINGLE), a
                (other,) = shingle_sets(x.column(3).slice(i, 1), SHINGLE)
                right = name(grams, 7) == a and name(other, 7) == b  # not another text of the same key
                both = len(np.intersect1d(grams, other, assume_unique=True))
                keep.append(right and 9 * both >= 4 * (len(grams) + len(other)))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = near.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    links = stored(both.mapInArrow(run, "a bigint, b bigint"), "join-links")
    for x in (near, keys, held):
        forget(x)
    return links


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(crowd: DataFrame) -> DataFrame:
    """Group pairs (a, b) of every post of a crowd with two of the crowd, which differ from shingle to shingle."""
    post, drawn = F.struct("grp", "n", "pos"), F.xxhash64("grp", "gram")
    first = crowd.groupBy("gram").agg(F.array(F.min_by(post, drawn), F.max_by(post, drawn)).alias("p"))
    met = crowd.join(first.select("gram", F.explode("p").alias("p")), "gram").where("grp <> p.grp")
    return met.where(may("n", "pos", "p.n", "p.pos")).select(F.col("grp").alias("a"), F.col("p.grp").alias("b"))


def may(n: str, pos: str, m: str, at: str) -> str:
    return f"9 * least({n} - {pos}, {m} - {at}) >= 4 * ({n} + {m}) and 5 * least({n}, {m}) >= 4 * greatest({n}, {m})"


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one a row, folded to ``size`` bytes."""
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def pairs_allowed(marks: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``sketches_allow`` for the rows ``i`` against ``j``."""
    length, ok = np.array([len(m) for m in marks]), np.zeros(len(i), bool)
    kinds = {k: np.flatnonzero(length == k) for k in np.unique(length)}
    held = {k: np.frombuffer(b"".join(marks[x] for x in at), np.uint8).reshape(len(at), -1) for k, at in kinds.items()}
    place = np.zeros(len(marks), np.int64)
    for at in kinds.values():
        place[at] = np.arange(len(at))
    for k in kinds:
        for m in kinds:
            which = np.flatnonzero((length[i] == k) & (length[j] == m))
            left, right = folded(held[k], min(k, m)), folded(held[m], min(k, m))
            for part in np.array_split(which, len(which) // (1 << 14) + 1):
                sizes = n[i[part]] + n[j[part]]
                differ = np.bitwise_count(left[place[i[part]]] ^ right[place[j[part]]]).sum(1, dtype=np.int64)
                ok[part] = differ <= sizes - 2 * -(-4 * sizes // 9)
    return ok


def across(crowd: DataFrame, rooted: DataFrame, spread: DataFrame, facts: DataFrame) -> DataFrame:
    """Node pairs (a, b) of crowds in different components that size, position and sketches allow."""
    open_ = crowd.join(spread, "grp").groupBy("gram").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    posts = crowd.join(open_.where("least <> most").select("gram"), "gram", "left_semi").join(rooted, "grp").drop("grp")
    posts = stored(posts, "join-crowds")
    parts = posts.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    met = posts.select("node").distinct()
    marks = facts.where("sketch is not null").join(met, "node", "left_semi").groupBy("node").agg(F.max("sketch").alias("sketch"))
    placed = posts.join(parts, "gram").withColumn("part", F.pmod(F.hash("node"), F.col("parts"))).join(marks, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = placed.select("gram", "node", "n", "pos", "root", "sketch", "part", other)
    cells = cells.select("gram", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "n", "node", "pos", "root", "sketch")
    fields = ["part", "j", "n", "node", "pos", "root", "sketch"]

    def run(batches):
        def marked():
            for b in batches:
                cols = {f: b.column(k) for k, f in enumerate(b.schema.names)}
                cell = mix(mix(cols["gram"].to_numpy().view(np.uint64)) ^ (cols["i"].to_numpy().astype(np.uint64) << np.uint64(32) | cols["j"].to_numpy().astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *[cols[f] for f in fields]], names=["gram", *fields])

        for rows, run_of, _ in buckets(marked(), 1 << 62):
            edges = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                part, j, n, node, pos, root = (rows[c][lo:hi].astype(np.int64) for c in fields[:-1])
                sketches = list(rows["sketch"][lo:hi])
                right = np.flatnonzero(part == j)
                left = np.flatnonzero(part != j) if (part != j).any() else right
                for at in range(0, len(left) if len(right) else 0, 256):
                    x = left[at : at + 256, None]
                    p, q = np.nonzero(allowed(n[x], pos[x], n[right][None], pos[right][None]) & (root[x] < root[right][None]))
                    p, q = left[at + p], right[q]
                    if left is not right:
                        y, z = np.nonzero(allowed(n[x], pos[x], n[right][None], pos[right][None]) & (root[x] > root[right][None]))
                        p, q = np.concatenate([p, left[at + y]]), np.concatenate([q, right[z]])
                    ok = pairs_allowed(sketches, n, p, q)
                    if ok.any():
                        yield batch("a bigint, b bigint", np.minimum(node[p], node[q])[ok], np.maximum(node[p], node[q])[ok])

    return cells.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(run, "a bigint, b bigint")


def roots_of(texts: DataFrame, facts: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes that have a similar one; texts are (doc_id, key, text), ``seeds`` pairs of keys (a, b) to compare first."""
    met = stored(meet(posts_of(texts, frequent(facts))), "join-met")
    members = met.where(F.col("kind") == MEMBER).select(F.col("a").alias("node"), F.col("b").alias("grp")).distinct()
    leaders = members.groupBy("grp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members"))
    leaders = stored(leaders, "join-groups")
    pairs = met.where(F.col("kind") == PAIR).select("a", "b").distinct()
    crowd = met.where(F.col("kind") == CROWD).select(F.col("a").alias("gram"), F.col("b").alias("grp"), "n", "pos")

    def leads(found: DataFrame) -> DataFrame:
        a, b = (leaders.select(F.col("grp").alias(x), F.col("lead").alias(f"l{x}")) for x in "ab")
        return found.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))

    many = leaders.where("members > 1")
    inside = members.join(many, "grp").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    first = leads(pairs.unionByName(stars(crowd).distinct())).unionByName(inside)
    if seeds is not None:
        a, b = (facts.where("n > 0").select(F.col("key").alias(x), F.col("node").alias(f"n{x}")).distinct() for x in "ab")
        first = first.unionByName(seeds.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    first = stored(ordered_pairs(first), "join-pairs")
    links = verified(first, facts, texts)
    roots = stored(components(links), "join-roots")

    rooted = members.join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "join-members")
    spread = stored(rooted.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")), "join-spread")
    mixed = spread.join(many, "grp").where("low <> high").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    a, b = (spread.join(leaders, "grp").select(F.col("grp").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"), F.col("members").alias(f"m_{x}")) for x in "ab")
    apart = pairs.join(a, "a").join(b, "b").where("(m_a > 1 or m_b > 1) and not (low_a = high_a and low_a = low_b and low_a = high_b)").select("a", "b")
    more = mixed.unionByName(apart)
    a, b = (rooted.select(F.col("grp").alias(x), F.col("node").alias(f"node_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    second = more.join(a, "a").join(b, "b").where("root_a <> root_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    second = ordered_pairs(second.unionByName(across(crowd, rooted, spread, facts)))
    second = stored(second.join(first, ["a", "b"], "left_anti"), "join-pairs")
    if not second.isEmpty():
        found = verified(second, facts, texts)
        roots = stored(components(links.unionByName(found)), "join-roots")
    for x in (met, leaders, first, second, rooted, spread, links):
        forget(x)
    return roots


def text_key(text: str = "text"):
    """Names a text; a null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seeds: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, n, root, component_id) of every row: ``component_id`` is the least id reachable by links, ``root``
    names the component, ``key`` the text (``text_key``). ``seeds`` are pairs of keys (a, b) that are compared first."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_key(text).alias("key"), whole.cast("binary").alias("text"))
    with batch_rows(spark, 1 << 14):
        facts = stored(facts_of(texts), "join-facts")
        roots = roots_of(texts, facts, seeds)
    rows = facts.where("node is not null").select("doc_id", "key", "node", "n")
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ids.join(named, "root").select("node", "root", "component_id")
    out = rows.join(named, "node").select("doc_id", "key", "n", "root", "component_id")
    return out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def similar_bags(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys whose multisets of shingles have a Jaccard similarity of 4/5 or more; texts are (key, text as binary)."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().select(F.col("key").alias("node"), "key")
    held = stored(texts_by_key(texts, keys), "join-texts")
    a, b = (held.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")

    def run(batches):
        for x in batches:
            keep = []
            for i in range(x.num_rows):
                (one,), (other,) = (shingle_bags(x.column(c).slice(i, 1), SHINGLE) for c in (2, 3))
                grams, times = np.unique(one, return_counts=True)
                more, other_times = np.unique(other, return_counts=True)
                _, p, q = np.intersect1d(grams, more, assume_unique=True, return_indices=True)
                both = int(np.minimum(times[p], other_times[q]).sum())
                keep.append(9 * both >= 4 * (len(one) + len(other)))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")

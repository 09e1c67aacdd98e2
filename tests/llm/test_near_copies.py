"""Near copies against the Jaccard similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline as cp
from barloom.llm import ngram_join


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    """doc_id -> least doc_id of its component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            continue
        both = len(a & b)
        if 5 * both >= 4 * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def edited(rnd, words, vocabulary, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = rnd.choice(vocabulary)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    got = {r.doc_id: r for r in ngram_join.similar_texts(df).collect()}
    assert {d: r.n for d, r in got.items()} == {d: len(shingles(t)) for d, t in rows}
    # texts without words link with nothing, to the pipeline they are copies
    assert {d: r.component_id for d, r in got.items() if r.n} == {d: want[d] for d, r in got.items() if r.n}
    assert all(r.component_id == d for d, r in got.items() if not r.n)
    kept = [r.doc_id for r in cp.drop_copies(spark, df, "").collect()]
    assert sorted(kept) == sorted(set(want.values()))
    return want


def test_edited_copies(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for n, edits in ((200, 2), (200, 4), (200, 5), (600, 6), (600, 12), (30, 1), (9, 1), (4, 0), (4, 1)):
        for _ in range(15):
            base = [rnd.choice(words) for _ in range(n)]
            rows += [base, edited(rnd, base, words, edits)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows += [passage + [rnd.choice(words) for _ in range(rnd.choice([5, 15, 40, 90]))] for _ in range(120)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(5000, ""), (5001, None), (5002, " \n"), (5003, "One"), (5004, "one")]
    want = check(spark, rows)
    assert sum(want[2 * i + 1] == 2 * i for i in range(15)) == 15  # two edits of 200 words


def test_crowd_with_a_passage(spark):
    """A crowd of near copies of several edits, not all similar to each other, and outliers at one shingle."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(150)]
    rows = [edited(rnd, base, words, rnd.choice([0, 1, 2, 3, 4, 6, 9])) for _ in range(300)]
    want = check(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])
    assert 1 < len(set(want.values())) < 200
    assert ngram_join.similar_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_blocks_groups_and_odd_rows(spark, monkeypatch):
    """Small bounds: crowds in several blocks, groups of several members, repeated ids and texts, clashing columns."""
    monkeypatch.setattr(ngram_join, "FEW", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "LOCAL_TIMES", 10**6)
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for n, copies in ((60, 40), (120, 40), (20, 20)):
        base = [rnd.choice(words) for _ in range(n)]
        rows += [edited(rnd, base, words, rnd.choice([0, 1, 1, 2, 3])) for _ in range(copies)]
    want = check(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])
    assert 1 < len(set(want.values())) < len(rows)
    text = " ".join(rows[0])
    odd = [(1, text, 5, "x"), (1, text, 6, "y"), (None, text, 7, "z"), (3, text.upper(), None, None), (None, None, 1, "n"), (4, "", 1, "n")]
    found = ngram_join.similar_texts(spark.createDataFrame(odd, "doc_id bigint, text string, n int, root string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n > 0) for r in found) == [(0, 0, False), (0, 1, True), (1, 1, True), (1, 1, True), (3, 1, True), (4, 4, False)]


def test_simhash_links_texts_of_similar_multisets(spark):
    """A passage many times over with other ends: the sets are apart, fingerprints and multisets are not."""
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(4000)]
    new = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, other = new(11), new(11)
    rows = [passage * 60 + new(12) for _ in range(4)]  # copies of each other
    rows += [passage * 20 + new(12), other * 60 + new(12), new(100)]  # as near by fingerprint but not by multiset, and others
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    assert len(set(brute(rows).values())) == len(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in cp.drop_copies(spark, df, "").collect()) == [0, 4, 5, 6]
    found = {r.doc_id: r.component_id for r in ngram_join.similar_texts(df).collect()}
    assert found == {i: i for i, _ in rows}  # the join of sets is as it was

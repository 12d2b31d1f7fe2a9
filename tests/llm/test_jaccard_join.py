import random
import re
from collections import defaultdict

import numpy as np

from feedloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, node string, n int"


def shingle_set(text, size=3):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < size else zip(*(w[k:] for k in range(size))))


def classes(rows, percent=90, size=3):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 30, 80, 200, 700]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = words  # chains: copies of copies
            rows.append(" ".join(words).title() if rng.random() < 0.2 else "\n ".join(words))
    rng.shuffle(rows)
    return [(1000 + 3 * k, t) for k, t in enumerate(rows)]


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {r[0]: (r[1], r[2]) for r in J.jaccard_classes(df, **more).collect()}


def test_equals_brute_force(spark):
    rows = near_copies(1) + [(1, ""), (2, None), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "One  two\tthree")]
    assert result(spark, rows) == classes(rows)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = near_copies(2, groups=4, size=14)
    monkeypatch.setattr(J, "MOST_SHINGLES", 500)
    assert result(spark, rows) == classes(rows)


def test_repeated_ids_nulls_and_empty(spark):
    long = " ".join(f"v{k}" for k in range(5000))
    df = spark.createDataFrame([(1, long, "", 1), (1, long, "", 1), (2, long + " end", "", 1), (None, long, "", 1), (3, "a b c", None, None)], SCHEMA)
    got = sorted((tuple(r) for r in J.jaccard_classes(df).collect()), key=str)
    assert got == [(1, 4998, 1), (1, 4998, 1), (2, 4999, 1), (3, 1, 3), (None, 4998, None)]
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == [1, 3, None]
    assert J.jaccard_classes(df.limit(0)).count() == 0 and J.one_of_each(df.limit(0)).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**6, 120)
    sets = [np.unique(np.where(rng.random(120) < 0.04, rng.integers(0, 10**6, 120), base)) for _ in range(40)] + [np.arange(k, k + 30) for k in range(20)]
    found = defaultdict(set)
    for i, linked in J.PrefixTree(sets).links(np.arange(len(sets)), 90):
        found[i] |= set(linked.tolist())
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))}
        assert found[i] - {i} == want - {i}


def test_linked_sets_share_three_parts():
    rng = np.random.default_rng(4)
    bounds = J.size_classes(1 << 20)
    for n in [10, 11, 19, 20, 37, 100, 150, 151, 1000]:
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        most = (2 * n) * 10 // 190
        b = a.copy()
        b[: most // 2] = rng.integers(0, 2**62, most // 2).astype(np.uint64)
        assert set(J.part_keys(a, 90, bounds).tolist()) & set(J.part_keys(b, 90, bounds).tolist())


def test_one_id_on_two_texts(spark):
    """(3, X), (5, X), (5, Y): 5 is a copy of 3, so all of it is 3's, and only 3 stays; 7 and 8 meet through 9's two texts."""
    x, y, z, w, v = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyzwv")
    rows = [(3, x), (5, x), (5, y), (7, z), (8, w), (9, z), (9, w), (11, None), (11, v), (11, "")]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    got = {(r["doc_id"], r["component_id"]) for r in J.jaccard_classes(df).collect()}
    assert got == {(3, 3), (5, 3), (7, 7), (8, 7), (9, 7), (11, 11)}
    kept = [(r["doc_id"], (r["text"] or "")[:2]) for r in J.one_of_each(df).collect()]
    assert sorted(kept) == [(3, "x0"), (7, "z0"), (11, "v0")]


def test_five_words_and_four_fifths(spark):
    rows = near_copies(5, groups=6, size=9)
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(df, percent=80, size=5).collect()}
    assert got == classes(rows, 80, 5)

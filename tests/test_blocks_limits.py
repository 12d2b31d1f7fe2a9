"""Limits, stop rules and numbering against loops written out in Python, with groups cut into tiny blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import blocks, limits
from feedloom.operators.fallback import first_nonempty_source, first_unblocked_source, usable_sources

WIDTH = 3


def candidates(seed, groups=60):
    """Groups of cards with limits; one group holds a third of all cards."""
    rng = random.Random(seed)
    cards = []
    for g in range(groups):
        n = 150 if g == 0 else rng.randint(0, 12)
        most, least = rng.randint(-4, 14), rng.randint(-3, 12)
        cards += [(g, i + 1, rng.choice(["", "a", "b"]), most, least) for i in range(n)]
    rng.shuffle(cards)
    return cards


def by_group(cards):
    out = {}
    for c in sorted(cards):
        out.setdefault(c[0], []).append(c)
    return out


def run_loop(cards, engine):
    """The early stop, card by card. Only non-empty texts are posts."""
    most, least = cards[0][3], cards[0][4]
    found = []
    for _, pos, text, _, _ in cards[:most]:
        if text:
            found.append(pos)
            if engine == "a" and len(found) >= least:
                break
        if engine == "b" and len(found) >= least:
            break
    return found


@pytest.mark.parametrize("engine", ["a", "b"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cap_and_stop_equal_the_loop(spark, engine, seed):
    cards = candidates(seed)
    df = spark.createDataFrame(cards, "g int, pos long, texto string, most int, least int")
    capped = limits.cap_candidates(df, ["g"], "most", width=WIDTH)
    stop = limits.stop_at_min_a if engine == "a" else limits.stop_at_min_b
    got = {}
    for r in stop(capped.where(F.col("texto") != ""), ["g"], "least", width=WIDTH).collect():
        got.setdefault(r.g, []).append(r.pos)
    want = {g: run_loop(c, engine) for g, c in by_group(cards).items()}
    assert {g: sorted(p) for g, p in got.items()} == {g: p for g, p in want.items() if p}


@pytest.mark.parametrize("limit", [3, 0, -2, -9, 5000])
def test_cap_by_number(spark, limit):
    cards = candidates(7)
    df = spark.createDataFrame(cards, "g int, pos long, texto string, most int, least int")
    got = limits.cap_candidates(df, ["g"], limit, width=WIDTH).select("g", "pos").collect()
    want = [(g, c[1]) for g, cs in by_group(cards).items() for c in cs[:limit]]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("k", [1, 4, 33, 40])
def test_first_rows_by_number(spark, k):
    cards = candidates(9)
    df = spark.createDataFrame(cards, "g int, pos long, texto string, most int, least int")
    want = [(g, c[1]) for g, cs in by_group(cards).items() for c in cs[:k]]
    for cut_in_tasks in (True, False):
        got = blocks.first_rows(df, ["g"], "pos", k, width=WIDTH, cut_in_tasks=cut_in_tasks)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.select("g", "pos").collect())) == want


def test_dense_number_with_gaps_and_negative_order(spark):
    rng = random.Random(4)
    rows = [(g, o) for g in range(5) for o in rng.sample(range(-50, 50), 30 if g else 90)]
    got = blocks.dense_number(spark.createDataFrame(rows, "g int, o long"), ["g"], "o", width=WIDTH)
    want = []
    for g in range(5):
        want += [(g, o, i) for i, o in enumerate(sorted(o for h, o in rows if h == g), 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_attach_and_group_size(spark):
    rows = [(g, o) for g in range(4) for o in range(3 * g * g)]
    df = spark.createDataFrame(rows, "g int, o long")
    facts = spark.createDataFrame([(g, f"f{g}") for g in (1, 3, 9)], "g int, f string")
    got = blocks.attach(df, facts, ["g"], "o", width=WIDTH)
    assert sorted(map(tuple, got.collect())) == [(g, o, f"f{g}") for g, o in rows if g in (1, 3)]
    sized = blocks.with_group_size(df, ["g"], "o", "n", width=WIDTH)
    assert sorted(map(tuple, sized.collect())) == [(g, o, 3 * g * g) for g, o in rows]


def test_first_nonempty_source(spark):
    rows = [(t, p, o) for t in range(5) for p in range(4) for o in range(10) if (t + p) % 3 or p == 3]
    df = spark.createDataFrame(rows, "t int, priority int, o long")
    got = first_nonempty_source(df, ["t"], "o", width=WIDTH)
    best = {t: min(p for u, p, _ in rows if u == t) for t in range(5)}
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[1] == best[r[0]]]


def test_sources_by_landing_page_and_status(spark):
    rows = [
        (1, 1, "https://a/login"), (1, 2, "https://b/x"), (1, 3, "https://a/y"),
        (2, 1, "https://a/login"), (2, 2, "https://b/login"), (2, 3, "https://a/login"),
        (3, 1, "https://a/z"), (3, 2, "https://b/z"),
        (4, 1, "https://a/login"),
        (5, 1, "https://a/login"), (5, 2, "https://b/login"), (5, 3, "https://a/login"), (5, 4, "https://a/login"),
        (6, 1, "https://a/login"), (6, 2, None), (6, 3, "https://a/q"), (7, 1, None), (7, 2, None),
    ]
    df = spark.createDataFrame(rows, "t int, priority int, url string")
    got = first_unblocked_source(df, ["t"], ["login"])
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 3), (7, 2)]
    status = spark.createDataFrame([(1, "ok"), (2, "timeout"), (3, None)], "t int, status string")
    assert [r.t for r in usable_sources(status).collect()] == [1]


# ---------------------------------------------------------------------------------------- scrolls


def scroll_cases(seed, groups=150):
    """Overlapping scrolls with limits, also empty scrolls, zero and negative limits, and one hot group."""
    rng = random.Random(seed)
    cases = {}
    for g in range(groups):
        n = 12 if g == 0 else rng.randint(0, 6)
        size = 60 if g == 0 else 5
        scrolls = [
            [(rng.choice("abcdefgh"), rng.choice([None, "t"])) for _ in range(rng.randint(0, size))]
            for _ in range(n)
        ]
        cases[g] = (scrolls, rng.randint(-1, 9), rng.randint(-1, 12), rng.randint(-1, 7))
    return cases


def scroll_loop(scrolls, least, most, max_scrolls):
    found, n = [], 0
    while len(found) < most and n < max_scrolls:
        if n >= len(scrolls):
            break
        for record in scrolls[n]:
            if record not in found:
                found.append(record)
        if len(found) >= least and n > 0:
            break
        n += 1
    return found


def scroll_rows(spark, cases):
    rows = [
        (g, s, p, *record, least, most, last)
        for g, (scrolls, least, most, last) in cases.items()
        for s, cards in enumerate(scrolls)
        for p, record in enumerate(cards, 1)
    ]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(
        rows, "g int, scroll int, pos long, texto string, timestamp string, least int, most int, last int"
    )


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_scroll_stop_equals_the_loop(spark, seed):
    cases = scroll_cases(seed)
    got = {}
    result = limits.scroll_stop(
        scroll_rows(spark, cases), ["g"], ["texto", "timestamp"], "least", "most", "last", width=WIDTH
    )
    for r in result.orderBy("numero").collect():
        got.setdefault(r.g, []).append((r.numero, r.texto, r.timestamp))
    want = {g: scroll_loop(*case) for g, case in cases.items()}
    assert got == {g: [(i, *r) for i, r in enumerate(w, 1)] for g, w in want.items() if w}


@pytest.mark.parametrize(
    "scrolls, least, most, last, want",
    [
        (["ab", "bc", "d"], 3, 9, 5, "abc"),
        (["abc"], 10, 2, 5, "abc"),
        (["abc", "d"], 10, 2, 5, "abc"),
        (["ab", "c"], 1, 9, 0, ""),
        (["ab", "c"], 1, 0, 5, ""),
        (["abc", "", "d"], 3, 9, 5, "abc"),
        (["abc", "d", "e"], 0, 9, 5, "abcd"),
    ],
)
def test_scroll_stop_cases(spark, scrolls, least, most, last, want):
    rows = [(1, s, p, c) for s, cards in enumerate(scrolls) for p, c in enumerate(cards, 1)]
    df = spark.createDataFrame(rows, "g int, scroll int, pos long, texto string")
    got = limits.scroll_stop(df, ["g"], ["texto"], least, most, last).orderBy("numero").collect()
    assert [(r.texto, r.numero) for r in got] == [(c, i) for i, c in enumerate(want, 1)]


def test_strict_max_cuts_the_overshoot(spark):
    df = spark.createDataFrame([(1, 0, p, c) for p, c in enumerate("abc", 1)], "g int, scroll int, pos long, texto string")
    got = limits.scroll_stop(df, ["g"], ["texto"], 10, 2, 5, strict_max=True).collect()
    assert sorted(r.texto for r in got) == ["a", "b"]


def test_first_sightings_treat_nulls_as_equal(spark):
    rows = [(1, 0, 2, "a", None), (1, 0, 5, "a", None), (1, 1, 1, "a", None), (1, 1, 2, "a", "t")]
    df = spark.createDataFrame(rows, "g int, scroll int, pos long, texto string, timestamp string")
    got = limits.first_sightings(df, ["g"], ["texto", "timestamp"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", None, 0, 2), (1, "a", "t", 1, 2)], key=str)


def test_positions_out_of_range_fail_loudly(spark):
    df = spark.createDataFrame([(1, -1, 1, "a")], "g int, scroll int, pos long, texto string")
    with pytest.raises(Exception, match="out of range"):
        limits.first_sightings(df, ["g"], ["texto"]).collect()


def test_scroll_progress(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 3, 1, "d")]
    df = spark.createDataFrame(rows, "g int, scroll int, pos long, texto string")
    got = limits.scroll_progress(df, ["g"], ["texto"], 3, 9, 10)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2, 2), (1, 1, 0, 2), (1, 2, 1, 3)]


def test_null_keys_are_a_group(spark):
    rows = [(g, o, o // 4) for g in (None, 1) for o in range(10)]
    df = spark.createDataFrame(rows, "g int, o long, p int")
    key = str
    numbered = blocks.dense_number(df, ["g"], "o", width=WIDTH).collect()
    assert sorted(map(tuple, numbered), key=key) == sorted([(g, o, p, o + 1) for g, o, p in rows], key=key)
    first = blocks.first_rows(df.withColumn("k", F.lit(7)), ["g"], "o", "k", width=WIDTH).collect()
    assert sorted([(r.g, r.o) for r in first], key=key) == sorted([(g, o) for g, o, _ in rows if o < 7], key=key)
    sized = blocks.with_group_size(df, ["g"], "o", "n", width=WIDTH).collect()
    assert len(sized) == 20 and {r.n for r in sized} == {10}
    lowest = first_nonempty_source(df, ["g"], "o", "p", width=WIDTH).collect()
    assert sorted(map(tuple, lowest), key=key) == sorted([r for r in rows if r[2] == 0], key=key)
    facts = spark.createDataFrame([(None, "x"), (1, "y")], "g int, f string")
    assert len(blocks.attach(df, facts, ["g"], "o", width=WIDTH).collect()) == 20
    cards = spark.createDataFrame([(None, 0, 1, "a"), (None, 1, 1, "b"), (1, 0, 1, "a")], "g int, scroll int, pos long, texto string")
    assert len(limits.scroll_stop(cards, ["g"], ["texto"], 9, 9, 9).collect()) == 3


def test_dense_numbers_of_sparse_orders(spark):
    """Hash ids, strings and nulls as orders, a hot group and a null one: as a plain window, with one cell a range."""
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"k{k % 7}", (k * 0x9E3779B97F4A7C15) % 2**63 - 2**62, f"s{k * 7919 % 10007}") for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, id bigint, name string").repartition(7)
    for order in (["id"], ["name", "id"]):
        want = df.withColumn("numero", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("long"))
        got = blocks.dense_number_by_ranges(df, ["key"], order)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and got.count() == 3000
    assert blocks.dense_number_by_ranges(df.limit(0), ["key"], ["id"]).count() == 0

"""The operators that SQL can express, on rows made to be awkward: nulls, empty, long, repeated and clashing ones."""

import random

import duckdb
import pyarrow as pa
import pytest

from feedloom.llm import decontaminate, license_scan, line_templates, mix_sources, quality_rules

ITEMS = [
    (1, " ".join(f"q{k}" for k in range(20))),
    (2, "Short item, of SIX words here"),
    (3, "single"),
    (4, ""),
    (5, None),
    (6, " ".join(f"q{k}" for k in range(7, 27))),
    (6, "été Über straße naïve"),
    (None, "an item without id"),
]


def documents():
    rng = random.Random(5)
    vocab = "the of and to in a is that for it was with by on house river stone light walk green seven".split()
    prose = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 14))) for _ in range(400)]
    rows = []
    for k in range(60):
        lines = [rng.choice(prose) for _ in range(rng.randrange(1, 30))]
        if k % 4 == 0:
            lines.insert(0, f"Posted by user{k} on day {k} at 10:{k} in the forum")
        if k % 5 == 0:
            lines.append(f"Written for the {rng.choice(vocab)} edition by staff of the {rng.choice(vocab)} desk today")
        if k % 6 == 0:
            lines.append("Q3, q4 q5 " + " ".join(f"q{j}" for j in range(6, 6 + k // 2)))
        if k % 7 == 0:
            lines.append("x ÉTÉ été ÜBER Über straße NAïVE naïve single")
        if k % 9 == 0:
            lines.append("Licensed under the Apache License, Version 2.0. " + license_scan.TEMPLATES["isc-grant"][: 60 + 3 * k])
        rows.append((k, "\n".join(lines), rng.choice(["en", "de", None, "xx"]), rng.choice(["s1", "s2", None, "é"])))
    rows += [(60, None, "en", "s1"), (61, "", "en", None), (62, " \n\t\n ", None, "s1"), (63, "A A A A A A A", "en", "s2")]
    rows += [(64, "### $$$ %%% " * 60, "en", "s2"), (65, "LOUD WORDS!! " * 80, "en", "s2"), (66, "same same same other " * 3000, "en", "s1")]
    rows += [rows[3], rows[3], (3, rows[4][1], "en", "s1"), (None, rows[5][1], "en", "s1"), (None, "short item of six words here", "en", "s1")]
    return rows


QUERIES = {
    "op3": (lambda d, b: quality_rules.judged(d).drop("js_chars", "js_words"), quality_rules.ORACLE),
    "op5": (lambda d, b: decontaminate.contamination(d, b).drop("mark"), decontaminate.ORACLE),
    "op6": (lambda d, b: line_templates.line_counts(d), line_templates.ORACLE),
    "op9": (lambda d, b: license_scan.scan_licenses(d), license_scan.ORACLE),
}
CLASHING = "mark string, words string, text_ int, line string, _cuts string, d int, m int, n_words int, lang_ string, s string, at int"


def frames(spark, rows):
    more = ["x", "y", 1, "z", "c", 2, 3, 4, "l", "s", 5]
    docs = spark.createDataFrame([(*r, *more) for r in rows], "doc_id bigint, text string, lang string, source string, " + CLASHING)
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, name):
    rows = documents()
    run, sql = QUERIES[name]
    got = run(*frames(spark, rows))
    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[k] for r in rows] for k, c in enumerate(["doc_id", "text", "lang", "source"])}))
    con.register("benchmark", pa.table({c: [r[k] for r in ITEMS] for k, c in enumerate(["item_id", "text"])}))
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert names == got.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(spark, name):
    docs, items = frames(spark, documents()[:1])
    assert QUERIES[name][0](docs.limit(0), items).count() == 0


def test_spans_and_documents_are_removed(spark):
    docs, items = frames(spark, documents())
    bad = {(r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect() if r["contaminated"]}
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r["contaminated"] for r in decontaminate.contamination(docs, items).collect())
    assert bad
    cut = decontaminate.without_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in cut.where("doc_id IN (2, 30, 60)").collect()}
    assert text[2] == documents()[2][1] and text[60] is None and "q9" not in text[30] and "q9" in documents()[30][1]
    empty = decontaminate.contamination(docs, items.limit(0))
    assert empty.where("n_hit > 0 OR contaminated").count() == 0 and empty.count() == docs.count()


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items = frames(spark, documents())
    want = sorted(map(repr, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 7)
    assert sorted(map(repr, decontaminate.contamination(docs, items).collect())) == want


def test_recurring_lines_go(spark):
    docs, _ = frames(spark, [r for r in documents() if r[0] is not None and r[0] < 60])
    out = line_templates.without_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text LIKE 'Posted by%'").count() == 0
    templates = {r["template"] for r in line_templates.line_templates(docs).where("dropped").collect()}
    assert "Posted by <*> on day <*> at <*> in the forum" in templates


def test_reference_distances(spark):
    docs, _ = frames(spark, documents())
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).where("doc_id >= 60").collect()}
    assert not got[60]["kept"] and got[60]["n_words"] == 0
    assert got[63]["n_repeat_words"] == 7 and got[63]["base_failed"]
    assert got[66]["n_repeat_words"] == got[66]["n_words"] == 12000
    assert got[64]["n_symbols"] == 540


def test_mix_equals_sql_on_unique_rows(spark):
    rows = [r for r in documents()[:67] if r[0] is not None]
    docs, _ = frames(spark, rows)
    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[k] for r in rows] for k, c in enumerate(["doc_id", "text", "lang", "source"])}))
    got = mix_sources.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(mix_sources.ORACLE).fetchall()))


def test_licenses_by_containment(spark):
    grant = license_scan.TEMPLATES["isc-grant"].split()
    texts = ["lead " * 50 + " ".join(grant) + " tail" * 30, "lead " * 7 + " ".join(grant[: int(len(grant) * 0.9)]), " ".join(grant[: len(grant) // 2]), "x " * 200 + "released UNDER the mit license!", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: "isc-grant", 1: "isc-grant", 2: "", 3: "mit-notice", 4: ""}


def test_adjacent_licenses_are_all_found(spark):
    # Notices of 5 words, 3 shingles, one in the other: a window of 16 words holds much besides any one of them.
    words = [f"w{k}" for k in range(60)]
    templates = {f"notice-{k:02}": " ".join(words[k : k + 5]) for k in range(len(words) - 4)}
    docs = spark.createDataFrame([(k, "lead " * k + " ".join(words)) for k in range(8)], "doc_id bigint, text string")
    got = license_scan.scan_licenses(docs, license_scan.template_table(spark, templates)).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {k: ",".join(sorted(templates)) for k in range(8)}


def test_texts_without_common_words_are_far(spark):
    """Plain letters of no language pass the count rules and the character classes; the bin of other words sets them apart."""
    rng = random.Random(8)
    listed, rest = quality_rules.COMMON["en"], [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmn"]

    def prose(share):
        return " ".join(rng.choice(listed if rng.random() < share else rest) for _ in range(200))

    rows = [(k, prose(0.25), "en", "s") for k in range(40)] + [(100 + k, prose(0.0), "en", "s") for k in range(4)] + [(200, " ".join(prose(0.0).split()[:99]), "en", "s")]
    got = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[k]["kept"] for k in range(40))
    assert all(not got[100 + k]["kept"] and not got[100 + k]["base_failed"] for k in range(4))
    assert got[200]["kept"]  # too short to be judged by its words

import pytest
from pyspark.sql import functions as F

from feedloom import functions as f
from feedloom import presets
from feedloom.sources.requests import candidate_urls, read_requests, with_defaults


def values(spark, texts, *columns):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_targets(spark):
    raw = [" #a", "##a#", "@u@"]
    got = values(
        spark, raw, f.clean_target("t", "#"), f.clean_target("t", "@"), f.file_target("t", "#"), f.file_target("t", "@")
    )
    assert got == [
        ("a", "#a", " #a", " #a"),
        ("#a#", "##a#", "a", "##a#"),
        ("@u@", "u@", "@u@", "u"),
    ]


def test_no_second_strip_after_the_sigil(spark):
    assert values(spark, ["# a "], f.clean_target("t", "#")) == [(" a",)]


def test_strip_equals_python(spark):
    texts = [f"{chr(c)}x{chr(c)}y{chr(c)}" for c in range(1, 0x3100)] + ["", "  \t\n"]
    got = values(spark, texts, f.strip_ws("t"), f.non_blank("t"))
    assert got == [(t.strip(), bool(t.strip())) for t in texts]


def test_non_blank_of_null(spark):
    assert values(spark, [None], f.non_blank("t")) == [(False,)]


def test_handle(spark):
    assert values(spark, [" @a@b "], f.clean_handle("t")) == [("ab",)]


@pytest.mark.parametrize(
    "term, kept",
    [(None, 4), ("", 4), ("100%", 1), ("a_b", 1), ("HELLO", 1)],
)
def test_keyword(spark, term, kept):
    texts = ["costs 100%", "x a_b y", "say hello", "axb 100"]
    assert sum(r[0] for r in values(spark, texts, f.keyword_ci("t", term))) == kept


def test_keyword_per_row(spark):
    rows = [("Hello", "hell"), ("Hello", None), ("Hello", "no"), ("Hello", "")]
    df = spark.createDataFrame(rows, "t string, k string")
    assert [r[0] for r in df.select(f.keyword_ci("t", F.col("k"))).collect()] == [True, True, False, True]


def test_hashtag(spark):
    texts = ["#xy", "a x b", "x", "#X"]
    assert values(spark, texts, f.hashtag_cs("t", "x")) == [(True,), (True,), (False,), (False,)]
    assert all(r[0] for r in values(spark, texts, f.hashtag_cs("t", None)))
    assert all(r[0] for r in values(spark, texts, f.hashtag_cs("t", "")))


def test_blocked(spark):
    urls = ["https://x.com/i/flow/login?a", "https://x.com/a", None]
    assert values(spark, urls, f.not_blocked("t", ["login"])) == [(False,), (True,), (True,)]


def test_required_keys(spark):
    texts = ['{"a": 1, "b": null}', '{"a": 1}', "no json", None]
    assert values(spark, texts, f.has_required_keys("t", ["a", "b"])) == [(True,), (False,), (False,), (False,)]


def test_patterns_over_match(spark):
    hosts = ["netflix.com", "X.COM", "example.org", None]
    assert values(spark, hosts, f.any_pattern("t", ["x.com"])) == [(True,), (True,), (False,), (None,)]


def test_time(spark):
    got = values(spark, ["2024-01-02T03:04:05.000Z", "3h", "", None], F.unix_millis(f.parse_time("t")))
    assert got == [(1704164645000,), (None,), (None,), (None,)]


def test_preview(spark):
    assert values(spark, ["ab", "x" * 60], f.preview_text("t")) == [("ab...",), ("x" * 50 + "...",)]


def test_defaults_and_urls(spark):
    asked = read_requests(
        spark,
        [
            {"kind": "hashtag", "engine": "a", "target": " #b c"},
            {"kind": "hashtag", "engine": "b", "target": "t", "max_tweets": 0},
            {"kind": "user", "engine": "a", "target": "@u"},
            {"kind": "user", "engine": "b", "target": "u", "max_scrolls": 7},
        ],
    )
    ready = with_defaults(asked)
    limits = {r.req_id: (r.clean, r.max_tweets, r.min_tweets, r.max_scrolls) for r in ready.collect()}
    assert limits == {1: ("b c", 30, 10, 10), 2: ("t", 0, 10, 5), 3: ("u", 30, 10, 10), 4: ("u", 30, 10, 7)}
    urls = {(r.req_id, r.priority): r.requested_url for r in candidate_urls(ready).collect()}
    assert [urls[1, i] for i in range(1, 5)] == [t.replace("{t}", "b c") for t in presets.HASHTAG_URLS_A]
    assert [urls[2, i] for i in range(1, 5)] == [t.replace("{t}", "t") for t in presets.HASHTAG_URLS_B]
    assert urls[3, 1] == "https://twitter.com/u" and (3, 2) not in urls
    assert urls[4, 3] == "https://twitter.com/search?q=from%3Au&src=typed_query&f=live"

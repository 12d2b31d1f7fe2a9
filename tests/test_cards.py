import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from feedloom import presets
from feedloom.functions import markup
from feedloom.operators.cards import (
    card_fields,
    explode_cards,
    explode_cards_flat,
    kept_posts,
    page_posts,
    quarantined,
    read_cards,
    read_cards_by_spec,
)
from feedloom.schema import PAGE_CARDS_TYPE

ALL = {"A_lenient": presets.HASHTAG_A, "A_strict": presets.USER_A, "B_plain": presets.HASHTAG_B, "B_visible": presets.USER_B}


def card(body, tag="article"):
    return f"<{tag} data-testid='tweet'>{body}</{tag}>"


TEXT = "<div data-testid='tweetText'>{}</div>".format
USER = "<div data-testid='User-Name'><span>{}</span></div>".format
TIME = "<time datetime='2024-01-01T00:00:00.000Z'>3h</time>"


def posts(spark, html, spec, term=None):
    cards = read_cards(spark.createDataFrame([(html,)], "html string"), spec)
    rows = cards.select(F.explode(kept_posts(F.col("cards"), spec, term)).alias("p")).select("p.*")
    return [(r.texto, r.usuario, r.timestamp, r.numero) for r in rows.collect()]


def test_all_modes_read_a_plain_card(spark):
    html = card(TEXT(" hi <b>you</b> &amp; me ") + USER("@bob") + TIME)
    for mode, spec in ALL.items():
        user = "bob" if mode == "B_visible" else "@bob"
        assert posts(spark, html, spec) == [("hi you & me", user, "2024-01-01T00:00:00.000Z", 1)], mode


@pytest.mark.parametrize(
    "mode, text",
    [("A_lenient", "t"), ("A_strict", ""), ("B_plain", None), ("B_visible", "t\nu")],
)
def test_empty_first_match(spark, mode, text):
    """Two text matches, the first one empty."""
    html = card(TEXT("") + TEXT("t") + USER("u") + TIME.replace("3h", ""))
    got = [p[0] for p in posts(spark, html, ALL[mode])]
    assert got == ([] if text is None else [text])


def test_plain_goes_on_to_the_next_selector(spark):
    html = card(TEXT("") + "<div class='a css-901oao b'>second</div>")
    assert posts(spark, html, presets.HASHTAG_B) == [("second", "Unknown", "", 1)]


def test_lenient_joins_non_blank_matches(spark):
    html = card(TEXT("a") + TEXT(" ") + TEXT("b"))
    assert posts(spark, html, presets.HASHTAG_A) == [("a b", "Unknown", "", 1)]


def test_lenient_falls_back_to_the_whole_card(spark):
    assert posts(spark, card("<i>w</i>"), presets.HASHTAG_A) == [("w", "Unknown", "", 1)]
    assert posts(spark, card(" <br> "), presets.HASHTAG_A) == []


def test_strict_needs_all_three_elements(spark):
    parts = {"text": TEXT("t"), "user": USER("u"), "time": TIME}
    for missing in parts:
        html = card("".join(v for k, v in parts.items() if k != missing))
        assert posts(spark, html, presets.USER_A) == []


def test_time_rules(spark):
    bare = card(TEXT("t") + USER("u") + "<time>3h</time>")
    for mode, want in [("A_lenient", None), ("A_strict", None), ("B_plain", None), ("B_visible", "3h")]:
        assert posts(spark, bare, ALL[mode])[0][2] == want
    none = card(TEXT("t") + USER("u"))
    for mode in ("A_lenient", "B_plain", "B_visible"):
        assert posts(spark, none, ALL[mode])[0][2] == ""
    empty = card(TEXT("t") + "<time datetime=''>3h</time>")
    assert posts(spark, empty, presets.HASHTAG_B)[0][2] == ""
    assert posts(spark, empty, presets.USER_B)[0][2] == "3h"


def test_visible_user_selectors_in_order(spark):
    html = card(TEXT("t") + "<a class='user'>@@late</a><span class='x username'> @ea@rly </span>")
    assert posts(spark, html, presets.USER_B)[0][1] == "early"


def test_visible_trims_and_filters_on_untrimmed_text(spark):
    html = card(TEXT("<pre> x </pre>"))
    assert posts(spark, html, presets.USER_B, "x") == [("x", "Unknown", "", 1)]
    assert posts(spark, html, presets.USER_B, "y") == []


def test_nested_card(spark):
    html = card(TEXT("outer") + card(TEXT("inner")))
    first = {m: posts(spark, html, s)[0][0] for m, s in ALL.items() if m != "A_strict"}
    assert first == {"A_lenient": "outer inner", "B_plain": "outer", "B_visible": "outer"}
    assert [p[0] for p in posts(spark, html, presets.HASHTAG_B)] == ["outer", "inner"]
    assert [p[3] for p in posts(spark, html, presets.HASHTAG_B)] == [1, 2]


def test_container_fallback_is_per_page(spark):
    cells = "<div data-testid='cellInnerDiv'>" + TEXT("c") + "</div>"
    assert [p[0] for p in posts(spark, cells + card(TEXT("d"), "div"), presets.HASHTAG_A)] == ["c"]
    assert [p[0] for p in posts(spark, cells + card(TEXT("a")), presets.HASHTAG_A)] == ["a"]
    assert [p[0] for p in posts(spark, cells + card(TEXT("d"), "div"), presets.USER_B)] == ["d"]


def test_no_cards(spark):
    pages = spark.createDataFrame([(1, "<p>nothing</p>"), (2, ""), (3, None)], "id int, html string")
    got = read_cards(pages, presets.HASHTAG_A).select("id", "found", F.size("cards"), "page_error")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, None), (2, 0, 0, None), (3, 0, 0, "no markup")]


def test_keyword_splits_over_tags_and_entities(spark):
    html = card(TEXT("py<b>th</b>&#111;n rocks"))
    assert len(posts(spark, html, presets.HASHTAG_A, "PYTHON")) == 1


def test_cap_is_passed_into_reading(spark):
    html = "".join(card(TEXT(str(i))) for i in range(7))
    pages = spark.createDataFrame([(html, 3), (html, 0), (html, None)], "html string, cap int")
    got = read_cards(pages, presets.HASHTAG_A, F.col("cap")).select("cap", "found", F.size("cards"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(3, 7, 3), (0, 7, 0), (None, 7, 7)], key=str)


@pytest.mark.parametrize(
    "most, least, engine, want",
    [
        (3, 10, "a", [1, 2, 3]),
        (0, 10, "a", []),
        (-2, 10, "a", [1, 2, 3]),
        (-9, 10, "b", []),
        (9, 2, "a", [1, 2]),
        (9, 0, "a", [1]),
        (9, -3, "a", [1]),
        (9, 0, "b", [1]),
        (9, 2, "b", [1, 2]),
    ],
)
def test_page_limits(spark, most, least, engine, want):
    html = "".join(card(TEXT(str(i))) for i in range(5))
    cards = read_cards(spark.createDataFrame([(html,)], "html string"), presets.HASHTAG_A)
    got = page_posts(cards, presets.HASHTAG_A, engine, F.lit(most), F.lit(least)).select("posts.numero")
    assert got.collect()[0][0] == want


def test_min_zero_differs_between_engines(spark):
    html = card(TEXT("")) + card(TEXT("a")) + card(TEXT("b"))
    pages = spark.createDataFrame([(html,)], "html string")
    for engine, spec, want in [("a", presets.HASHTAG_A, [2]), ("b", presets.HASHTAG_B, [])]:
        got = page_posts(read_cards(pages, spec), spec, engine, F.lit(30), F.lit(0)).select("posts.numero")
        assert got.collect()[0][0] == want


def test_unreadable_cards_are_set_aside(spark, monkeypatch):
    good = markup.PageTree.text

    def text(self, n, rendering):
        if self.attrs[n].get("id") == "bad":
            raise ValueError("broken")
        return good(self, n, rendering)

    monkeypatch.setattr(markup.PageTree, "text", text)
    html = card(TEXT("a")) + card("<div data-testid='tweetText' id='bad'>b</div>") + card(TEXT("c"))
    reader = markup.Reader.of(presets.HASHTAG_A)
    (page,) = markup.page_cards(html, [reader])
    assert [c["error"] for c in page["cards"]] == [None, "ValueError: broken", None]
    assert [c["pos"] for c in page["cards"]] == [1, 2, 3]

    def feed(self, html):
        raise RuntimeError("no page")

    monkeypatch.setattr(markup.PageTree, "feed", feed)
    assert markup.page_cards(html, [reader]) == [{
        "found": 0,
        "cards": [],
        "error": "RuntimeError: no page",
    }]


def test_quarantine_and_results_split(spark):
    schema = "id int, page_error string, found int, cards array<struct<pos:long,texts:array<array<string>>,users:array<array<string>>,times:array<array<struct<attr:string,text:string>>>,whole:string,error:string>>"
    ok = (1, [["a"], [], []], [[]], [[]], "a", None)
    bad = (2, [], [], [], None, "ValueError: x")
    cards = spark.createDataFrame([(1, None, 2, [ok, bad]), (2, "RuntimeError: y", 0, [])], schema)
    assert sorted(map(tuple, quarantined(cards, ["id"]).collect())) == [(1, 2, "ValueError: x"), (2, None, "RuntimeError: y")]
    kept = cards.select(F.explode(kept_posts(F.col("cards"), presets.HASHTAG_A)).alias("p")).select("p.numero")
    assert [r[0] for r in kept.collect()] == [1]


@pytest.mark.parametrize("engine, least, want", [("a", 0, [2]), ("b", 0, [2]), ("b", 1, [2]), ("b", 2, [2, 3])])
def test_early_stop_passes_over_unreadable_cards(spark, engine, least, want):
    schema = "found int, cards array<struct<pos:long,texts:array<array<string>>,users:array<array<string>>,times:array<array<struct<attr:string,text:string>>>,whole:string,error:string>>"
    bad = (1, [], [], [], None, "ValueError: x")
    good = [(i, [["a"], [], []], [[]], [[]], "a", None) for i in (2, 3)]
    cards = spark.createDataFrame([(3, [bad, *good])], schema)
    got = page_posts(cards, presets.HASHTAG_B, engine, F.lit(30), F.lit(least)).select("posts.numero")
    assert got.collect()[0][0] == want


def test_flat_and_tree_agree(spark, sf_dir):
    from feedloom.catalog import views as v

    flat = explode_cards_flat(spark.read.parquet(f"{sf_dir}/pages.parquet").drop("url"), v.FLAT_LINKS, "texto")
    tree = explode_cards(v.pages(spark, sf_dir).drop("url"), v.LINK_SPEC)
    tree = tree.select("page_id", "pos", card_fields(F.col("card"), v.LINK_SPEC)["texto"].alias("texto"))
    assert flat.count() == tree.count() > 0
    assert flat.exceptAll(tree).count() == 0


def text_of(html, rendering="lines"):
    return markup.page_text(html, rendering)


def test_rendered_text():
    assert text_of("<p>a<p>b</p><div>c<span>d</span></div>e") == "a\nb\ncd\ne"
    assert text_of("<p>a<p>b</p><div>c</div>", "inner_text") == "a\n\nb\n\nc"
    assert text_of("a<br>b<br/><br>c") == "a\nb\n\nc"
    assert text_of("<script>x<p></script><style>y</style>z<!-- c --><template>t</template>") == "z"
    assert text_of("a \n\t b  <b> c</b> &lt;d&gt; &eacute;") == "a b c <d> é"
    assert text_of("<pre>a  b\n c</pre>", "inner_text") == "a  b\n c"
    assert text_of("x<div hidden>h</div><span style='display: none'>n</span>y") == "xy"
    assert text_of("a&nbsp;b&nbsp;") == "a b"
    assert text_of("a&nbsp;b", "inner_text") == "a\xa0b"
    assert text_of("<p>a <br> b </p> <p> c</p>") == "a\nb\nc"
    assert text_of("<p>a<br></p><p>b</p>", "inner_text") == "a\n\n\nb"
    assert text_of("<ul><li>a<li>b</ul>c") == "a\nb\nc"
    assert text_of("<b><p>a</b>b</p>c") == "ab\nc"


def test_selectors():
    tree = markup.PageTree()
    tree.feed(
        "<div class='a b'><span id=1>x</span></div><span class='b' id=2></span>"
        "<div data-testid='User-Name'><p><span id=3></span></p></div><DIV DATA-TESTID=User-Name></DIV>"
    )
    tree.finish()

    def ids(selector):
        return [tree.attrs[n].get("id") for n in tree.select(markup.parse_selector(selector))]

    assert ids("span") == ["1", "2", "3"]
    assert ids("div[data-testid='User-Name'] span") == ["3"]
    assert len(ids("div.b.a")) == 1 and len(ids(".b")) == 2
    assert len(ids('div[data-testid="User-Name"]')) == 2
    for bad in ("a > b", "a:hover", "a, b", "*"):
        with pytest.raises(ValueError):
            markup.parse_selector(bad)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a</p><![foo[x]]><p>b</p>", "a\nb"),
        ("<p>a</p><![ <p>b</p>", "a\nb"),
        ("<p>a</p><!-- x <b>c</b>", "a"),
        ("<p>a</p><![CDATA[ c ", "a"),
        ("<p>a</p><!DOCTYPE [ <p>b</p>", "a\nb"),
    ],
)
def test_malformed_declarations_are_comments(html, text):
    got = markup.page_text(html, "lines")
    assert [line for line in got.split("\n") if line][0] == "a" and "<" not in got and "x" not in got
    reader = markup.Reader.of(presets.HASHTAG_A.with_selectors(containers=("p",), text=("p",), user=("b",), time=("a",)))
    (page,) = markup.page_cards(html, [reader])
    assert page["error"] is None and page["found"] >= 1


def test_lost_markup_is_quarantined(spark):
    pages = spark.createDataFrame([(1, "<p>no cards</p>"), (2, None), (3, "")], "id int, html string")
    cards = read_cards(pages, presets.HASHTAG_A)
    assert [tuple(r) for r in quarantined(cards, ["id"]).collect()] == [(2, None, "no markup")]


def test_nested_cards_take_no_longer_than_their_text():
    """Unclosed articles stand in one another: each card's text is a slice, and only what a mode reads is rendered."""
    import time

    html = "<article>x" * 4000
    for preset in (presets.HASHTAG_A, presets.USER_B):
        reader = markup.Reader.of(preset.with_selectors(containers=("article",), text=("p",), user=("b i",), time=("a",)))
        start = time.perf_counter()
        (page,) = markup.page_cards(html, [reader])
        assert time.perf_counter() - start < 2
        assert page["found"] == 4000
        assert [len(c["whole"].replace("\n", "")) for c in page["cards"][:3999:500]] == list(range(4000, 0, -500))


def test_one_parse_serves_every_spec(spark, monkeypatch):
    html = card(TEXT("a<p>b</p>") + "<time datetime='t'>now</time>") + "<div class='tweet'><p class='tweet-text'>c</p></div>"
    specs = [presets.HASHTAG_A, presets.HASHTAG_B, presets.USER_A, presets.USER_B]
    readers = [markup.Reader.of(s) for s in specs]
    alone = [markup.page_cards(html, [r])[0] for r in readers]
    feeds = []
    feed = markup.PageTree.feed
    monkeypatch.setattr(markup.PageTree, "feed", lambda self, text: (feeds.append(text), feed(self, text))[1])
    assert markup.page_cards(html, readers) == alone and len(feeds) == 1
    assert [len(p["cards"]) for p in markup.page_cards(html, readers, [0, None, 1, 5])] == [0, 1, 1, 1]
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    both = read_cards_by_spec(pages, specs).orderBy("id").collect()
    assert [both[0][f"_{i}"].found for i in range(4)] == [p["found"] for p in alone]
    plan = read_cards_by_spec(pages, specs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_cards_of_a_batch_are_not_all_python_objects_at_once():
    """Five hundred pages in one batch: the cards are those of each page alone, and few of them stand as Python objects."""
    html = "<ul>" + "".join(f"<li><a href='/{k}'>post <b>{k}</b></a></li>" for k in range(60)) + "</ul>"
    pages = [f"{html}<p>{k}</p>" if k % 50 else None for k in range(500)]
    spec = presets.HASHTAG_A.with_selectors(containers=("li",), text=("a",), user=("b",), time=("a",), time_attr="href")
    readers = [markup.Reader.of(spec), markup.Reader.of(presets.USER_B.with_selectors(containers=("li",), text=("a",), user=("b",), time=("b",)))]
    limits = pa.array([[k % 70 if k % 3 else None, 5] for k in range(500)], pa.list_(pa.int64()))
    tracemalloc.start()
    got = markup.cards_array(pa.array(pages), limits, readers, to_arrow_type(T.ArrayType(PAGE_CARDS_TYPE)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 << 20
    assert got.to_pylist() == [markup.page_cards(h, readers, c) for h, c in zip(pages, limits.to_pylist())]
    assert len(markup.cards_array(pa.array([], pa.string()), limits.slice(0, 0), readers, got.type)) == 0

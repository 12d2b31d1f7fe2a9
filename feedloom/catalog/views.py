"""The given tables seen as pages, cards, posts, scrolls and requests."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import presets
from feedloom.operators.blocks import dense_number
from feedloom.operators.cards import explode_cards_flat, read_cards
from feedloom.schema import PAGE_SCHEMA
from feedloom.session import run_dir
from feedloom.functions.urls import target_urls
from feedloom.sources.pages import land_pages, read_pages
from feedloom.sources.requests import read_requests

# Cards of two kinds: navigation links (flat markup), and articles (nested, with unclosed paragraphs).
# The leading selectors match nothing in these pages, so the ordered fallback is exercised.
LINK_CONTAINERS = ("section.feed", "li")
LINK_SPEC = presets.HASHTAG_A.with_selectors(
    containers=LINK_CONTAINERS, text=("b.headline", "a"), user=("b",), time=("a",), time_attr="href"
)
ARTICLE_CONTAINERS = ("section.feed", "article", "div")


def article_spec(preset: presets.CardSpec) -> presets.CardSpec:
    """A mode's rules over the articles: paragraphs as text, the heading as author, no time element."""
    return preset.with_selectors(
        containers=ARTICLE_CONTAINERS, text=("p.lead", "p"), user=("h1",), time=("time",)
    )


FLAT_LINKS = [(r'(?s)<section class="feed">(.*?)</section>', 1), (r'(?s)<li><a href="[^"]*">(.*?)</a></li>', 1)]

LANG_IN_URL = r"^https?://[^/]+/([a-z]+)/"


SCHEMAS = {
    "pages": PAGE_SCHEMA,
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its columns declared so that planning does not have to read files."""
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


_LANDED: dict[tuple[str, str], str] = {}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, landed in small files once per application: the given table is one row group, which one task would parse."""
    path = os.path.join(sf_dir, "pages.parquet")
    key = (spark.sparkContext.applicationId, path)
    if key in _LANDED:
        try:
            return read_pages(spark, _LANDED[key])
        except AnalysisException:  # the shared folder was cleaned
            pass
    folder = run_dir(spark, "pages")
    landed = land_pages(read_pages(spark, path).select("page_id", "url", "html"), folder)
    _LANDED[key] = folder
    return landed


def link_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_pages(spark, os.path.join(sf_dir, "pages.parquet"))
    return explode_cards_flat(given.drop("url"), FLAT_LINKS, "texto")


def posts_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the cards of one target each, in turn order."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("target"),
        (F.col("turn") + 1).alias("pos"),
        F.col("text").alias("texto"),
        F.col("role").alias("usuario"),
        F.lit(None).cast("string").alias("timestamp"),
    )


def posts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of a target (language) found through a candidate source."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("target"),
        F.col("source").alias("candidate"),
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("priority"),
        F.col("doc_id").alias("pos"),
        F.col("text").alias("texto"),
    )


SCROLL_CARDS = 5


def scrolls_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as cards, five per scroll; event kind and rounded value make the record."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    numbered = dense_number(events, ["user_id"], "event_id", "_p")
    at = F.col("_p") - 1
    return numbered.select(
        F.col("user_id").alias("target"),
        F.floor(at / SCROLL_CARDS).cast("int").alias("scroll"),
        (at % SCROLL_CARDS + 1).alias("pos"),
        F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("long")).alias("texto"),
        F.col("event_type").alias("usuario"),
        F.lit(None).cast("string").alias("timestamp"),
    )


def capture_status(url: str) -> Column:
    return F.when(F.contains(F.col(url), F.lit("://m.")), "error").otherwise("ok")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures. Mobile hosts stand for captures that failed."""
    return pages(spark, sf_dir).select(
        F.col("url").alias("requested_url"),
        F.lit(0).alias("scroll"),
        "url",
        capture_status("url").alias("status"),
        "html",
    )


def address_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages filed under their language: the candidates of that target, in page order."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", LANG_IN_URL, 1).alias("clean"),
        F.col("page_id").alias("priority"),
        F.col("url").alias("requested_url"),
    )


# (max_tweets, min_tweets) per request; zero and negative limits are reachable and have exact meanings.
LIMIT_GRID = ((30, 10), (5, 3), (0, 10), (-1, 1), (4, 0), (None, None))


def requests(spark: SparkSession, sf_dir: str, kind: str, engine: str) -> DataFrame:
    """For every target filed in the page table one request per limit pair, targets raw with a sigil."""
    targets = address_book(spark, sf_dir).select("clean").distinct()
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(most).cast("int").alias("max_tweets"),
                F.lit(least).cast("int").alias("min_tweets"),
            )
            for i, (most, least) in enumerate(LIMIT_GRID)
        ]
    )
    code = F.ascii("clean") * 256 + F.ascii(F.substring("clean", 2, 1))
    sigil = presets.SIGIL[kind]
    return targets.select("clean", F.explode(grid).alias("g")).select(
        (code * 100 + F.col("g.i")).cast("long").alias("req_id"),
        F.lit(kind).alias("kind"),
        F.lit(engine).alias("engine"),
        F.concat(F.lit(f" {sigil}"), "clean").alias("target"),
        "g.max_tweets",
        "g.min_tweets",
        F.lit(None).cast("int").alias("max_scrolls"),
    )


def host_scrolls(
    spark: SparkSession, sf_dir: str, spec: presets.CardSpec
) -> tuple[DataFrame, DataFrame]:
    """(extracted snapshots, address book) of profiles: a host is the profile, its pages are the scrolls of
    one of three addresses (by query string, by fragment, plain)."""
    rank = F.when(F.contains("url", F.lit("?")), 1).when(F.contains("url", F.lit("#")), 2).otherwise(3)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    filed = table(spark, sf_dir, "pages").select(
        "page_id",
        host.alias("clean"),
        rank.alias("priority"),
        F.concat(host, F.lit("/"), rank).alias("requested_url"),
    )
    numbered = dense_number(filed.select("page_id", "requested_url"), ["requested_url"], "page_id", "_n")
    cards = read_cards(pages(spark, sf_dir), spec)
    captures = cards.join(numbered, "page_id").select(
        "requested_url",
        (F.col("_n") - 1).cast("int").alias("scroll"),
        "url",
        F.lit("ok").alias("status"),
        "found",
        "cards",
    )
    return captures, filed.select("clean", "priority", "requested_url").distinct()


def host_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile request per host, with limits small enough to stop before the last page."""
    hosts = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("clean")
    )
    return hosts.groupBy("clean").agg(F.min("page_id").alias("req_id")).select(
        "req_id",
        F.lit("user").alias("kind"),
        F.lit("b").alias("engine"),
        F.concat(F.lit("@"), "clean").alias("target"),
        F.lit(20).alias("max_tweets"),
        F.lit(12).alias("min_tweets"),
        F.lit(None).cast("int").alias("max_scrolls"),
    )


# Links written as the posts that the shipped selectors look for.
POST_MARKUP = (
    '<article data-testid="tweet"><div data-testid="User-Name"><span>@ana</span></div>'
    '<div data-testid="tweetText">$2</div><time datetime="$1">now</time></article>'
)
# (max_tweets, min_tweets, max_scrolls) of requests by address template.
SCROLL_GRID = ((30, 10, None), (5, 3, 0), (12, 4, 2), (-1, 1, 7), (4, 0, 1), (None, None, None), (200, 90, 40))


def captured_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page captured twice: as a scroll of one of its language's four hashtag addresses, and of one of three profile addresses."""
    html = F.regexp_replace("html", r'(?s)<li><a href="([^"]*)">(.*?)</a></li>', POST_MARKUP)
    seen = pages(spark, sf_dir).select("page_id", "url", F.regexp_extract("url", LANG_IN_URL, 1).alias("clean"), html.alias("html"))
    places = dense_number(seen.select("page_id", "clean"), ["clean"], "page_id", "_n").select("page_id", (F.col("_n") - 1).cast("int").alias("n"))
    lists = [target_urls("clean", presets.HASHTAG_URLS_A), target_urls("clean", presets.USER_URLS_B)]
    both = [F.struct(F.get(u, F.col("n") % k).alias("requested_url"), F.floor(F.col("n") / k).cast("int").alias("scroll")) for u, k in zip(lists, (4, 3))]
    filed = seen.join(F.broadcast(places), "page_id").withColumn("_at", F.explode(F.array(*both)))
    return filed.select("_at.requested_url", "_at.scroll", "url", capture_status("url").alias("status"), "html")


def scroll_requests(spark: SparkSession, sf_dir: str, kind: str, engine: str) -> DataFrame:
    """For every language one request per limits of SCROLL_GRID, written down and read back as a user's list of requests is."""
    names = ("max_tweets", "min_tweets", "max_scrolls")
    grid = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(x).cast("int").alias(c) for c, x in zip(names, row)]) for i, row in enumerate(SCROLL_GRID)])
    targets = address_book(spark, sf_dir).select("clean").distinct().select("clean", F.explode(grid).alias("g"))
    code = F.ascii("clean") * 256 + F.ascii(F.substring("clean", 2, 1))
    rows = targets.select(
        (code * 100 + F.col("g.i")).cast("long").alias("req_id"), F.lit(kind).alias("kind"), F.lit(engine).alias("engine"),
        F.concat(F.lit(f" {presets.SIGIL[kind]}"), "clean").alias("target"), *[f"g.{c}" for c in names],
    )
    folder = run_dir(spark, "requests")
    rows.write.parquet(folder)
    return read_requests(spark, folder)

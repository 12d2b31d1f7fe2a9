"""Page -> cards -> posts.

A page's cards stay one array column of the page's own row until the page-local rules (candidate cap,
field choice, keep filters, early stop) have been applied with array functions. None of that shuffles,
and no key can become hot, because a page is one row. Only what survives is exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.markup import cards_by_spec, cards_of_page
from feedloom.functions.predicates import hashtag_cs, keyword_ci, non_blank
from feedloom.functions.text import clean_handle, strip_ws
from feedloom.presets import UNKNOWN_USER, CardSpec


def read_cards(pages: DataFrame, spec: CardSpec, cap: Column | None = None) -> DataFrame:
    """Replace ``html`` by ``found`` (cards on the page), ``cards`` (array) and ``page_error``; NULL markup is an error."""
    kept = [c for c in pages.columns if c != "html"]
    return (
        pages.withColumn("_page", cards_of_page("html", spec, cap))
        .select(
            *kept,
            "_page.found",
            "_page.cards",
            F.when(F.col("html").isNull(), "no markup").otherwise(F.col("_page.error")).alias("page_error"),
        )
    )


def read_cards_by_spec(pages: DataFrame, specs: Sequence[CardSpec], caps: Sequence[Column] | None = None) -> DataFrame:
    """Replace ``html`` by one column per spec, ``_0``, ``_1`` …, of PAGE_CARDS_TYPE; every page is parsed once."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.withColumn("_pages", cards_by_spec("html", specs, caps)).select(
        *kept, *[F.get("_pages", F.lit(i)).alias(f"_{i}") for i in range(len(specs))]
    )


def explode_cards(pages: DataFrame, spec: CardSpec, cap: Column | None = None) -> DataFrame:
    """One row per card, with its 1-based position on the page."""
    cards = read_cards(pages, spec, cap)
    kept = [c for c in cards.columns if c not in ("cards", "page_error")]
    return cards.select(*kept, F.explode("cards").alias("card")).select(
        *kept, F.col("card.pos").alias("pos"), "card"
    )


def explode_cards_flat(pages: DataFrame, patterns: list[tuple[str, int]], out: str = "card_html") -> DataFrame:
    """``explode_cards`` for flat markup: (regex, group) pairs in order, the first with a match wins.

    Stays in the JVM; use it where cards do not nest.
    """
    nothing = F.array().cast("array<string>")
    picked = F.coalesce(
        *[F.nullif(F.regexp_extract_all("html", F.lit(p), F.lit(g)), nothing) for p, g in patterns]
    )
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(picked).alias("_i", out)).select(
        *kept, (F.col("_i") + 1).cast("long").alias("pos"), out
    )


def _first_nonempty(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _first_present(lists: Column, n: int, value: Callable[[Column], Column]) -> Column:
    """``value`` of the first match of the first selector that has a match; NULL if none has."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for i in range(n):
        hits = F.get(lists, F.lit(i))
        chosen = chosen.when(F.size(hits) > 0, value(F.get(hits, F.lit(0))))
    return chosen


def card_text(card: Column, spec: CardSpec) -> Column:
    """The card's text by the mode's rule; NULL where the mode finds none."""
    texts, n = card["texts"], len(spec.text)
    if spec.mode == "A_lenient":
        joined = [F.array_join(F.filter(F.get(texts, F.lit(i)), non_blank), " ") for i in range(n)]
        return _first_nonempty([*joined, card["whole"]])
    if spec.mode == "A_strict":
        return F.get(F.get(texts, F.lit(0)), F.lit(0))
    if spec.mode == "B_plain":
        return _first_nonempty([F.get(F.get(texts, F.lit(i)), F.lit(0)) for i in range(n)])
    if spec.mode == "B_visible":
        return _first_nonempty([_first_present(texts, n, lambda x: x), card["whole"]])
    raise ValueError(f"unknown mode: {spec.mode}")


def card_user(card: Column, spec: CardSpec) -> Column:
    """The author block's text, ``Unknown`` where there is none."""
    users = card["users"]
    if spec.mode == "B_visible":
        found = _first_present(users, len(spec.user), clean_handle)
    else:
        found = F.get(F.get(users, F.lit(0)), F.lit(0))
    return F.coalesce(found, F.lit(UNKNOWN_USER))


def card_time(card: Column, spec: CardSpec) -> Column:
    """The time element's attribute: ``""`` without an element, NULL without the attribute.

    B_visible reads the element's text instead of an absent or empty attribute.
    """
    times = card["times"]
    if spec.mode == "B_visible":
        found = _first_present(
            times, len(spec.time), lambda t: F.coalesce(F.nullif(t["attr"], F.lit("")), t["text"])
        )
        return F.coalesce(found, F.lit(""))
    hits = F.get(times, F.lit(0))
    return F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["attr"]).otherwise(F.lit(""))


def card_fields(card: Column, spec: CardSpec) -> Column:
    """The card's fields by the mode's rules, with its source position, before any filter.

    ``sound`` is false for a card that could not be read, and in strict mode for one that lacks an
    element: presence counts there, not value, so empty text is kept.
    """
    sound = card["error"].isNull()
    if spec.mode == "A_strict":
        for name in ("texts", "users", "times"):
            sound = sound & (F.size(F.get(card[name], F.lit(0))) > 0)
    return F.struct(
        card_text(card, spec).alias("texto"),
        card_user(card, spec).alias("usuario"),
        card_time(card, spec).alias("timestamp"),
        card["pos"].alias("numero"),
        F.coalesce(sound, F.lit(False)).alias("sound"),
    )


def _is_post(fields: Column, spec: CardSpec, term: Column | str | None) -> Column:
    text = fields["texto"]
    keep = fields["sound"]
    if spec.mode != "A_strict":
        keep = keep & non_blank(text)
    if spec.mode in ("A_lenient", "A_strict"):
        keep = keep & keyword_ci(text, term)
    if spec.mode == "B_visible":
        keep = keep & hashtag_cs(text, term)
    return keep


def kept_posts(cards: Column, spec: CardSpec, term: Column | str | None = None) -> Column:
    """The posts among an array of cards. ``term`` is the keyword (A modes) or the tag (B_visible).

    Fields are built first and judged after, so each is worked out once per card.
    """
    posts = F.filter(
        F.transform(cards, lambda c: card_fields(c, spec)), lambda p: _is_post(p, spec, term)
    )
    if spec.mode == "B_visible":
        return F.transform(posts, lambda p: p.withField("texto", strip_ws(p["texto"])))
    return posts


def candidate_cap(found: Column, limit: Column) -> Column:
    """How many cards ``cards[:limit]`` holds: a negative limit drops that many from the end."""
    return F.when(limit >= 0, F.least(limit, found)).otherwise(F.greatest(found + limit, F.lit(0)))


def capped(cards: Column, found: Column, limit: Column) -> Column:
    """``cards[:limit]``. ``cards`` may already be cut, but at no fewer than the limit."""
    return F.slice(cards, F.lit(1), candidate_cap(found, limit).cast("int"))


def stopped_at_min(kept: Column, first_seen: Column, least: Column, engine: str) -> Column:
    """The page's kept posts up to the early stop.

    Engine A looks after each kept post, so at least one passes. Engine B looks after each candidate it
    could read, so with a minimum of zero or less only the first of those (``first_seen``) is ever used.
    """
    first = F.slice(kept, F.lit(1), F.greatest(least, F.lit(1)).cast("int"))
    if engine == "a":
        return first
    return F.when(least > 0, first).otherwise(
        F.filter(kept, lambda p: p["numero"] == first_seen)
    )


def page_posts(
    cards: DataFrame,
    spec: CardSpec,
    engine: str,
    limit: Column,
    least: Column,
    term: Column | str | None = None,
) -> DataFrame:
    """Add ``posts``: the page's posts after cap, field choice, filters and early stop, in page order."""
    taken = capped(F.col("cards"), F.col("found"), limit)
    read = F.filter(taken, lambda c: c["error"].isNull())
    first_seen = F.get(read, F.lit(0))["pos"]
    return cards.withColumn(
        "posts", stopped_at_min(kept_posts(read, spec, term), first_seen, least, engine)
    )


def quarantined(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Pages and cards that could not be read, with the reason; ``cards`` comes from ``read_cards`` and is read once."""
    page = F.struct(F.lit(None).cast("long").alias("pos"), F.col("page_error").alias("error"))
    bad = F.transform(
        F.filter("cards", lambda c: c["error"].isNotNull()), lambda c: F.struct(c["pos"].alias("pos"), c["error"].alias("error"))
    )
    # The outer form: an inner explode would have the cards worked out a second time to filter on them.
    faults = F.when(F.col("page_error").isNotNull(), F.array(page)).otherwise(bad)
    rows = cards.select(*keys, F.explode_outer(faults).alias("fault"))
    return rows.where(F.col("fault").isNotNull()).select(*keys, "fault.pos", "fault.error")

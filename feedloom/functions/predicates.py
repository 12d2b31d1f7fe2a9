"""Row predicates as boolean columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import WHITESPACE, _col


def non_blank(c: Column | str) -> Column:
    """Text with something other than whitespace in it. NULL counts as blank."""
    return F.coalesce(F.ltrim(_col(c), F.lit(WHITESPACE)) != "", F.lit(False))


def keyword_ci(c: Column | str, term: Column | str | None) -> Column:
    """``term`` occurs in the text, case aside. No term keeps all rows, and so does an empty one.

    A substring test, not LIKE: ``%`` and ``_`` in a term mean themselves. A Python string is the term;
    pass a Column for one term per row.
    """
    if term is None:
        return F.lit(True)
    needle = F.lit(term) if isinstance(term, str) else term
    return needle.isNull() | F.contains(F.lower(_col(c)), F.lower(needle))


def hashtag_cs(c: Column | str, tag: Column | str | None) -> Column:
    """``#tag`` or `` tag `` occurs in the untrimmed text, case counts. No or empty tag keeps all rows."""
    if tag is None or (isinstance(tag, str) and tag == ""):
        return F.lit(True)
    text = _col(c)
    if isinstance(tag, str):
        return F.contains(text, F.lit("#" + tag)) | F.contains(text, F.lit(f" {tag} "))
    return (
        tag.isNull()
        | (tag == "")
        | F.contains(text, F.concat(F.lit("#"), tag))
        | F.contains(text, F.concat(F.lit(" "), tag, F.lit(" ")))
    )


def not_blocked(url: Column | str, markers: Sequence[str]) -> Column:
    """The final URL carries none of the markers. Run it before extraction: it reaches the scan.

    An unknown final URL is not a sign-in page.
    """
    u = _col(url)
    return reduce(
        lambda a, b: a & b, [u.isNull() | ~F.contains(u, F.lit(m)) for m in markers], F.lit(True)
    )


def any_pattern(c: Column | str, patterns: Sequence[str]) -> Column:
    """Any of the strings occurs, case aside, as in ``LIKE '%p%'``. Host names are ASCII.

    Over-matches on purpose: ``x.com`` also matches ``netflix.com``.
    """
    text = _col(c)
    return reduce(lambda a, b: a | b, [text.ilike(f"%{p}%") for p in patterns], F.lit(False))


def has_required_keys(json_text: Column | str, keys: Sequence[str]) -> Column:
    """The flat JSON record has every key. Text that is no JSON object has none."""
    names = F.json_object_keys(_col(json_text))
    return reduce(
        lambda a, b: a & b,
        [F.coalesce(F.array_contains(names, k), F.lit(False)) for k in keys],
        F.lit(True),
    )

"""URL columns: the ordered addresses a target's pages are captured from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import presets
from feedloom.functions.text import _col


def fill_template(template: str, target: Column) -> Column:
    """Put the target into the template's ``{t}`` as it is, without percent-encoding."""
    before, after = template.split("{t}")
    return F.concat(F.lit(before), target, F.lit(after))


def target_urls(target: Column | str, templates: Sequence[str]) -> Column:
    """The templates filled in, in order, as an array to ``posexplode``."""
    t = _col(target)
    return F.array(*[fill_template(tpl, t) for tpl in templates])


ALL_TEMPLATES = tuple(dict.fromkeys([*presets.HASHTAG_URLS_A, *presets.USER_URLS_A, *presets.USER_URLS_B]))


def made_from(url: Column | str, templates: Sequence[str]) -> Column:
    """Whether the address has the shape of one of the templates. Prefix tests reach the scan.

    A template that ends with the target takes in what others are made from (a profile's address begins every search), so
    addresses of a longer known template that is not asked for are left out of it.
    """
    u = _col(url)

    def shaped(template: str) -> Column:
        before, after = template.split("{t}")
        test = u.startswith(before)
        return test & u.endswith(after) if after else test

    tests = []
    for template in templates:
        before, after = template.split("{t}")
        longer = [t for t in ALL_TEMPLATES if t != template and t.startswith(before)] if not after else []
        tests.append(reduce(lambda a, b: a & ~b, map(shaped, longer), shaped(template)))
    return reduce(lambda a, b: a | b, tests)


def urls_by_kind(target: Column | str, kind: Column | str, engine: Column | str) -> Column:
    """The list for each request's kind and engine. The two engines try the hosts in another order."""
    k, e = _col(kind), _col(engine)
    return (
        F.when((k == "hashtag") & (e == "a"), target_urls(target, presets.HASHTAG_URLS_A))
        .when((k == "hashtag") & (e == "b"), target_urls(target, presets.HASHTAG_URLS_B))
        .when((k == "user") & (e == "a"), target_urls(target, presets.USER_URLS_A))
        .when((k == "user") & (e == "b"), target_urls(target, presets.USER_URLS_B))
    )


def host_of(url: Column | str) -> Column:
    """Host part of an http(s) address; NULL when there is none, also for text that is no URL."""
    host = F.regexp_extract(_col(url), r"^https?://([^/?#]+)", 1)
    return F.nullif(host, F.lit(""))

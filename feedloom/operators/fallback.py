"""Choosing one source per target, in set form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.predicates import not_blocked
from feedloom.operators.blocks import BLOCK_WIDTH, keep_lowest


def first_nonempty_source(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    priority: str = "priority",
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Rows of the lowest-numbered source that has any row left after filtering; no mixing.

    ``order`` spreads a large source: an id of the rows or of their pages.
    """
    return keep_lowest(rows, keys, priority, order, width)


def first_nonempty_page(
    pages: DataFrame, keys: Sequence[str], order: Sequence[str], posts: str = "posts"
) -> DataFrame:
    """``first_nonempty_source`` while each page's posts are still one array.

    One aggregate with map-side combining: each task sends one page per target, however many sources
    a target has. Pages without posts have no rank, which keeps ``posts`` from being worked out a second time
    in a filter. Targets without any post have NULL. Where a page was captured twice, the lesser array of posts
    counts, whatever the order of rows.
    """
    rank = F.when(F.size(posts) > 0, F.struct(*order, posts))
    return pages.groupBy(*keys).agg(F.min_by(posts, rank).alias(posts))


def first_unblocked_source(
    sources: DataFrame,
    keys: Sequence[str],
    markers: Sequence[str],
    priority: str = "priority",
    url: str = "url",
) -> DataFrame:
    """For each group, the lowest-numbered source whose final URL is no sign-in page.

    ``sources`` holds every candidate; one that was not captured has a NULL URL. Decided by the URL alone, not by what
    the page holds. If all are sign-in pages or missing, the last candidate is the answer. Returns (keys, priority).
    """
    free = F.min(F.when(F.col(url).isNotNull() & not_blocked(url, markers), F.col(priority)))
    return sources.groupBy(*keys).agg(F.coalesce(free, F.max(priority)).alias(priority))


def usable_sources(sources: DataFrame, status: str | Column = "status") -> DataFrame:
    """Leave out captures that failed or timed out; the next source takes over."""
    c = F.col(status) if isinstance(status, str) else status
    return sources.where(c == "ok")

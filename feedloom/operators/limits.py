"""Candidate caps and stop rules over tables of cards, for groups of any size.

Jobs apply the same rules page by page on arrays (``operators.cards``); these are the forms for candidates
that come as rows. ``pos`` is the 1-based candidate position in its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.blocks import BLOCK_WIDTH, block_of, first_rows, group_columns, with_group_size
from feedloom.operators.cards import candidate_cap


def cap_candidates(
    rows: DataFrame,
    keys: Sequence[str],
    limit: int | str,
    pos: str = "pos",
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """``cards[:limit]`` before any filter. ``limit`` is a number or a column constant in a group.

    A limit of zero or more is a plain row filter. Only negative limits need the group's size.
    """
    if isinstance(limit, int) and limit >= 0:
        return rows.where(F.col(pos) <= limit)
    bound = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    sized = with_group_size(rows, keys, pos, "_found", width)
    return sized.where(F.col(pos) <= candidate_cap(F.col("_found"), bound)).drop("_found")


def stop_at_min_a(
    kept: DataFrame, keys: Sequence[str], least: int | str, pos: str = "pos", width: int = BLOCK_WIDTH
) -> DataFrame:
    """Engine A's early stop over the rows that passed the filters: the first ``max(least, 1)``."""
    if isinstance(least, int):
        return first_rows(kept, keys, pos, max(least, 1), width)
    rows = kept.withColumn("_k", F.greatest(F.col(least), F.lit(1)))
    return first_rows(rows, keys, pos, "_k", width).drop("_k")


def stop_at_min_b(
    kept: DataFrame, keys: Sequence[str], least: int | str, pos: str = "pos", width: int = BLOCK_WIDTH
) -> DataFrame:
    """Engine B's early stop: the first ``least`` rows; for zero or less only candidate 1, if it was kept."""
    if isinstance(least, int):
        return first_rows(kept, keys, pos, least, width) if least > 0 else kept.where(F.col(pos) == 1)
    seen = kept.where((F.col(least) > 0) | (F.col(pos) == 1)).withColumn(
        "_k", F.greatest(F.col(least), F.lit(1))
    )
    return first_rows(seen, keys, pos, "_k", width).drop("_k")


def seen_at(scroll: Column, pos: Column) -> Column:
    """(scroll, pos) as one long that sorts the same way, so its minimum is a hash aggregate."""
    fits = scroll.between(0, 2**31 - 1) & pos.between(0, 2**32 - 1)
    return F.when(fits, F.shiftleft(scroll.cast("long"), 32) + pos).otherwise(
        F.raise_error(F.lit("scroll or card position out of range")).cast("long")
    )


def first_sightings(rows: DataFrame, keys: Sequence[str], record: Sequence[str]) -> DataFrame:
    """Each distinct record of a group once, where it was first seen: (keys, record, scroll, pos).

    An aggregate with map-side combining: repeats of a hot record never leave their task. NULLs are equal.
    ``pos`` is the card's position in its scroll.
    """
    return (
        rows.groupBy(*keys, *record)
        .agg(F.min(seen_at(F.col("scroll"), F.col("pos"))).alias("_at"))
        .select(
            *keys,
            *record,
            F.shiftright("_at", 32).cast("int").alias("scroll"),
            (F.col("_at") % F.lit(1 << 32)).alias("pos"),
        )
    )


def value_of(limit: int | str) -> Column:
    return F.lit(limit) if isinstance(limit, int) else F.col(limit)


def _live(most: int | str, max_scrolls: int | str) -> Column:
    """Scrolls that are looked at at all; for other rows nothing can follow."""
    return (value_of(most) > 0) & (F.col("scroll") < value_of(max_scrolls))


def _grouping(keys: Sequence[str], *limits: int | str) -> list[str]:
    return list(dict.fromkeys([*keys, *[x for x in limits if isinstance(x, str)]]))


def _is_reached(earlier: Column, scroll: Column, least: int | str, most: int | str) -> Column:
    """Whether a scroll is still looked at, given the distinct records of the scrolls before it.

    The loop goes on while there are fewer than ``most`` records, and ends after any scroll but the
    first that leaves at least ``least``. Scrolls are counted from 0 without holes, so scroll 1 is always
    looked at unless ``most`` ends it.
    """
    return (earlier < value_of(most)) & ((scroll <= 1) | (earlier < value_of(least)))


def scroll_stop(
    rows: DataFrame,
    keys: Sequence[str],
    record: Sequence[str],
    least: int | str,
    most: int | str,
    max_scrolls: int | str,
    strict_max: bool = False,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Distinct records of overlapping scrolls up to the stop rule, numbered 1..n.

    A group stops after the first scroll (0-based) at which it has ``least`` records and is past
    scroll 0, or has ``most`` records, or is the last one allowed. The whole stopping scroll counts, so the
    result may exceed ``most``; ``strict_max`` cuts it. Limits may be names of columns that are constant in
    a group.

    A group's window runs over counts per scroll (and per block of a very long scroll), never over
    cards; cards meet it by an equi-join on the same.
    """
    by = _grouping(keys, least, most, max_scrolls)
    seen = first_sightings(rows.where(_live(most, max_scrolls)), by, record)
    group = group_columns(seen, by)
    seen = seen.withColumns({**group, "_block": block_of("pos", width)})
    cell = [*group, "scroll", "_block"]
    whole = Window.partitionBy(*group)
    before = whole.orderBy("scroll", "_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.orderBy("scroll").rangeBetween(Window.unboundedPreceding, -1)
    cells = (
        seen.groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.any_value(value_of(least)).alias("_least"),
            F.any_value(value_of(most)).alias("_most"),
        )
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                "_earlier": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
            }
        )
        .where(_is_reached(F.col("_earlier"), F.col("scroll"), "_least", "_most"))
        .select(*cell, "_before")
    )
    inside = Window.partitionBy(*cell).orderBy("pos")
    numbered = seen.join(cells, cell).withColumn(
        "numero", (F.col("_before") + F.row_number().over(inside)).cast("long")
    )
    if strict_max:
        numbered = numbered.where(F.col("numero") <= value_of(most))
    return numbered.select(*by, *record, "scroll", "pos", "numero")


def scroll_progress(
    rows: DataFrame,
    keys: Sequence[str],
    record: Sequence[str],
    least: int | str,
    most: int | str,
    max_scrolls: int | str,
    captured: DataFrame | None = None,
) -> DataFrame:
    """The scrolls looked at, with new and total distinct records after each.

    ``captured`` lists (keys, scroll) where scrolls may be empty; by default those of ``rows``.
    """
    by = _grouping(keys, least, most, max_scrolls)
    live = _live(most, max_scrolls)
    seen = first_sightings(rows.where(live), by, record)
    shown = (rows if captured is None else captured).where(live)
    counts = (
        seen.select(*by, "scroll", F.lit(1).alias("_n"))
        .unionByName(shown.select(*by, F.col("scroll").cast("int"), F.lit(0).alias("_n")))
        .groupBy(*by, "scroll")
        .agg(F.sum("_n").alias("n_new"))
    )
    order = Window.partitionBy(*by).orderBy("scroll")
    return (
        counts.withColumn(
            "n_unique", F.sum("n_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
        )
        .where(_is_reached(F.col("n_unique") - F.col("n_new"), F.col("scroll"), least, most))
        .select(*by, "scroll", "n_new", "n_unique")
    )

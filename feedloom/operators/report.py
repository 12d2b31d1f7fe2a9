"""Counts per extraction and per stage. All are aggregates with map-side combining."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.blocks import first_rows
from feedloom.functions.text import preview_text


def result_count(posts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def stage_report(rows: DataFrame, keys: Sequence[str], stages: Mapping[str, Column]) -> DataFrame:
    """One row per group: candidates found, and how many pass each named condition, in one scan."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("found"),
        *[F.count_if(cond).alias(name) for name, cond in stages.items()],
    )


def shortfall_report(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Groups with fewer candidates than asked for are flagged, not dropped."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("found"), (n < least).alias("shortfall"))


def group_has_any(rows: DataFrame, keys: Sequence[str], name: str, names: Sequence[str]) -> DataFrame:
    """Whether each group has a record whose name is in the list."""
    return rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col(name).isin(*names)), F.lit(False)).alias("has_any")
    )


def preview(posts: DataFrame, keys: Sequence[str], n: int = 3, width: int = 50) -> DataFrame:
    """The first ``n`` posts of each group, text cut short."""
    return first_rows(posts, keys, "numero", n).select(
        *keys, "numero", "usuario", preview_text("texto", width).alias("sample")
    )

"""Ordered work inside groups of any size.

A window partitioned by a key puts the whole key into one task, and one key may hold a third of all rows.
Here a group is cut into *blocks*: runs of its order column of a fixed width, so a block never holds more
rows than the width. Rows are counted per (key, block) with map-side combining; only that small table
is windowed per key; its running totals go back to the rows by an equi-join on (key, block). A large
group is thus spread over the tasks by its blocks, and results are exact for any skew. Blocks are a
function of the data, so a lost executor's work is redone alike.

The order column must be unique inside a group (for ``attach`` and ``keep_lowest`` it only decides how finely
a group is spread). NULL keys are a group like any other.

Blocks of a fixed width suit ids that lie close together. Where they are sparse (hashes, clock readings) or no integers at all, number the
rows with ``dense_number_by_ranges`` first and use that number as the order: its cells follow the rows, not the ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import run_dir

BLOCK_WIDTH = 1 << 20


def block_of(order: Column | str, width: int = BLOCK_WIDTH) -> Column:
    """The block an integer falls into, named by its lowest value; NULLs have a block before all."""
    c = (F.col(order) if isinstance(order, str) else order).cast("long")
    return F.coalesce(c - F.pmod(c, F.lit(width)), F.lit(-(2**63)))


def group_columns(rows: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns that are equal just where the keys are equal or both NULL, to join and sort groups by.

    A plain equi-join would drop NULL keys, and a struct of the keys would be slower to sort.
    """
    out = {}
    for i, key in enumerate(keys):
        field = rows.schema[key]
        zero = None
        if isinstance(field.dataType, T.StringType):
            zero = F.lit("")
        elif isinstance(field.dataType, T.NumericType):
            zero = F.lit(0).cast(field.dataType)
        if zero is None:
            out[f"_key{i}"] = F.struct(key)
        else:
            out[f"_key{i}"] = F.coalesce(F.col(key), zero)
            out[f"_null{i}"] = F.col(key).isNull()
    return out


def _blocked(
    rows: DataFrame, keys: Sequence[str], order: str, width: int
) -> tuple[DataFrame, list[str]]:
    """The rows with their group and block, and the names of the group's columns."""
    group = group_columns(rows, keys)
    return rows.withColumns({**group, "_block": block_of(order, width)}), list(group)


def _counted(blocked: DataFrame, group: list[str], *carried: Column) -> DataFrame:
    """Per cell the number of the group's rows before it (``_before``) and in all (``_total``)."""
    cells = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"), *carried)
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_total": F.sum("_n").over(whole),
        }
    )


def _place(group: list[str], order: str) -> Column:
    """A row's number in its group, once its cell's ``_before`` is known."""
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    return (F.col("_before") + F.row_number().over(inside)).cast("long")


def dense_number(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "numero",
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Number the rows of each group 1..n by ``order``, without gaps."""
    blocked, group = _blocked(rows, keys, order, width)
    cell = [*group, "_block"]
    counts = _counted(blocked, group).select(*cell, "_before")
    placed = blocked.join(counts, cell).withColumn(out, _place(group, order))
    return placed.select(*rows.columns, out)


def dense_number_by_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "numero") -> DataFrame:
    """``dense_number`` for order columns of any sortable types and any spacing, unique together inside a group.

    Rows are cut into ranges of (keys, order) with about as many rows each and sorted there; a row's number is the rows of its
    group in earlier ranges plus its place in its own. A group has one cell per range that holds some of it, so cells stay as few as
    ranges, however large the group and however far apart its ids. The ranges come from a sample, so the sorted rows are written to
    the shared folder once: counts and numbers are taken from the same cut, also when work is redone.
    """
    spark = rows.sparkSession
    by = [*keys, *order]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_row": inside})
    folder = run_dir(spark, "ranges")
    sorted_.write.parquet(folder)
    kept = spark.read.schema(sorted_.schema).parquet(folder)
    group = group_columns(kept, keys)
    kept = kept.withColumns(group)
    cell = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = kept.groupBy(*cell).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    cells = cells.select(*cell, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return kept.join(cells, cell).select(*rows.columns, (F.col("_base") + F.col("_row")).cast("long").alias(out))


def first_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    k: int | str,
    width: int = BLOCK_WIDTH,
    cut_in_tasks: bool = False,
) -> DataFrame:
    """The first ``k`` rows of each group by ``order``.

    ``k`` is a number, or the name of a column that is constant inside a group. Rows go block by block, and blocks that
    start after the limit are dropped before their rows are sorted. With ``cut_in_tasks`` each map task keeps the first k
    rows of a group, and one task gets those of all map tasks: a caller's choice for a small number ``k``.
    """
    if cut_in_tasks:
        group = Window.partitionBy(*keys).orderBy(order)
        return (
            rows.withColumn("_rn", F.row_number().over(group)).where(F.col("_rn") <= k).drop("_rn")
        )
    bound = F.lit(k) if isinstance(k, int) else F.col(k)
    blocked, group = _blocked(rows, keys, order, width)
    cell = [*group, "_block"]
    counts = _counted(blocked, group, F.any_value(bound).alias("_bound"))
    begun = counts.where(F.col("_before") < F.col("_bound")).select(*cell, "_before")
    placed = blocked.join(begun, cell).withColumn("_place", _place(group, order))
    return placed.where(F.col("_place") <= bound).select(*rows.columns)


def with_group_size(
    rows: DataFrame, keys: Sequence[str], order: str, out: str, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Add the number of rows in the group, joined by block so that a large group stays spread out."""
    blocked, group = _blocked(rows, keys, order, width)
    cell = [*group, "_block"]
    totals = _counted(blocked, group).select(*cell, F.col("_total").alias(out))
    return blocked.join(totals, cell).select(*rows.columns, out)


def attach(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], order: str, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Inner-join one row of ``facts`` per group to the group's rows, spread by block.

    The facts meet the table of (key, block) first and travel on with it, so a large group is not
    gathered the way a plain join on the key would gather it.
    """
    added = [c for c in facts.columns if c not in keys]
    blocked, group = _blocked(rows, keys, order, width)
    cell = [*group, "_block"]
    known = facts.withColumns(group_columns(facts, keys)).select(*group, *added)
    cells = blocked.select(*cell).distinct().join(known, group)
    return blocked.join(cells, cell).select(*rows.columns, *added)


def keep_lowest(
    rows: DataFrame, keys: Sequence[str], rank: str, order: str, width: int = BLOCK_WIDTH
) -> DataFrame:
    """All rows of each group whose ``rank`` is the group's lowest.

    The winner is found on the (key, rank, block) table; the rows meet it by a semi-join on the same
    three, so neither a large group nor a large winner is gathered.
    """
    blocked, group = _blocked(rows, keys, order, width)
    cell = [*group, "_block", rank]
    best = F.min(rank).over(Window.partitionBy(*group))
    cells = blocked.select(*cell).distinct().withColumn("_best", best)
    winners = cells.where(F.col(rank) == F.col("_best")).select(*cell)
    return blocked.join(winners, cell, "left_semi").select(*rows.columns)

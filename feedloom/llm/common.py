"""What the operators share: intermediate tables, input columns, folds, connected classes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids or hashes is broadcast (about 16 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of one file of a narrow table whose number of rows is known.
FILE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new temporary folder is set (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="feedloom-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, lost tasks are redone from files.

    ``rows``, a bound of its rows where one is known, keeps narrow tables in files of FILE_ROWS.
    """
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows, else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """The columns doc_id, text (null: empty) and ``more`` only, so that further columns cannot clash."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned: crc32 of the id as text leaves 0 by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """One row (doc_id, label) per labelled document outside the held-out fold; the greater label where rows differ."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(name).cast("int")).alias("label"))
    )


def share_of(salt: str, *cols: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *cols), 11) / F.lit(float(1 << 53))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the least label among a node's neighbours and then that label's own label, so that chains shorten
    by doubling. Rounds are cut by written tables; nodes and labels stay in Spark.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    rows = both.count()
    first = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp"))
    labels = stored(first, "labels", rows)
    for _ in range(most_rounds):
        known = small(labels, rows)
        near = both.join(known, both["b"] == known["node"]).groupBy("a").agg(F.min("comp").alias("low")).select(F.col("a").alias("n"), "low")
        once = near.join(known, near["n"] == known["node"]).select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("c"))
        up = small(labels.select(F.col("node").alias("c"), F.col("comp").alias("cc")), rows)
        least = F.least("c", "cc")
        now = stored(once.join(up, "c").select("node", least.alias("comp"), (least != F.col("was")).alias("moved")), "labels", rows)
        moved = now.where("moved").limit(1).count()
        labels = now.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"labels still moved after {most_rounds} rounds")

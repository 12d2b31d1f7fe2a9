"""Captured pages."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schema import PAGE_SCHEMA

#: Tasks per core that list the folders of dumps, and that read the files at most.
LISTS, READS = 4, 32


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages kept as a parquet table (page_id, url, html), read where they lie.

    Extraction is bound by CPU and runs per split. Land pages that come in a few large row groups with ``land_pages``, so that all
    cores get some; markup is not shuffled for it.
    """
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def land_pages(pages: DataFrame, folder: str, rows_per_file: int = 256) -> DataFrame:
    """``pages`` written once in files small enough to spread their parsing, and read from there.

    Each task cuts its own rows into files as it writes them, in their order; there is no exchange. Spark packs small files
    into splits by bytes and cores, so on large tables a split still holds many of them.
    """
    pages.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return pages.sparkSession.read.schema(pages.schema).parquet(folder)


def store_snapshots(snapshots: DataFrame, table: str, folder: str, buckets: int, rows_per_group: int = 1000) -> DataFrame:
    """Snapshots kept as a table bucketed by ``requested_url``, its files sorted by (requested_url, scroll).

    The one shuffle of markup in its life. Afterwards a job's semi-join on the asked addresses and the join of cards with requests
    move the narrow side only, to the same buckets. Small row groups let a reader skip addresses that nobody asked for.
    """
    (
        snapshots.repartition(buckets, "requested_url")
        .write.option("path", folder)
        .option("parquet.block.row.count.limit", rows_per_group)
        .bucketBy(buckets, "requested_url")
        .sortBy("requested_url", "scroll")
        .saveAsTable(table)
    )
    return snapshots.sparkSession.table(table)


def write_page_dumps(pages: DataFrame, folder: str) -> None:
    """Pages (page_id, html) dumped as one HTML file each, ended by a line break, in a folder ``page_id=…`` of its own.

    On a mounted file system the tasks create the files themselves, each complete under a hidden name first, so repeated tasks do no
    harm: Hadoop's local file system starts two processes to set the rights of every file it creates. Elsewhere Spark's writer does it. Of
    a page that a task has several times all rows are one file.
    """
    local = _mounted(pages.sparkSession, folder)
    if local is None:
        pages.write.partitionBy("page_id").option("lineSep", "\n").text(folder)
        return
    os.makedirs(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, number = f"part-{task.partitionId():05d}.txt", 0
        rows = ((i.as_py(), h.as_py()) for batch in batches for i, h in zip(batch.column(0), batch.column(1)))
        for page_id, same in groupby(rows, key=lambda row: row[0]):
            place = os.path.join(local, f"page_id={'__HIVE_DEFAULT_PARTITION__' if page_id is None else page_id}")
            os.makedirs(place, exist_ok=True)
            begun = os.path.join(place, f".{name}-{task.taskAttemptId()}")
            with open(begun, "wb") as file:
                file.writelines(f"{html}\n".encode() for _, html in same)
            os.replace(begun, os.path.join(place, name))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["files"])

    ordered = pages.select("page_id", "html").sortWithinPartitions("page_id")
    ordered.mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The plain path of a folder that Spark too reaches as a mounted one; None for other stores."""
    at = urlsplit(folder if "://" in folder or folder.startswith("file:") else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS"))
    if at.scheme != "file":
        return None
    return unquote(at.path) if folder.startswith("file:") else os.path.abspath(folder)


@contextmanager
def _few_lists(spark: SparkSession):
    """Lists many folders in a few tasks; Spark's own choice is a task for each of up to ten thousand folders."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), LISTS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_page_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Raw page dumps, one HTML file each: (path, html).

    Spark counts every file as at least four megabytes, so that a split holds but a few; splits are put together to READS tasks a core.
    """
    with _few_lists(spark):
        files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("html")).coalesce(READS * spark.sparkContext.defaultParallelism)

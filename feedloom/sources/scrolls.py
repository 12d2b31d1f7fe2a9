"""Scroll captures as a stream: files arrive while targets are being scrolled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_scroll_stream(
    spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1
) -> DataFrame:
    """(target, scroll, pos, …) from a folder of parquet files, a bounded number of files per batch.

    The operators downstream go by the ``scroll`` column, not by arrival order, so on a cluster the
    number of files per batch is free to grow.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

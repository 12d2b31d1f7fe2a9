"""Row-wise reshaping and quarantine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remap_record(rows: DataFrame, renames: Mapping[str, str], flags: Mapping[str, str]) -> DataFrame:
    """Select and rename columns; those in ``flags`` become booleans."""
    return rows.select(
        *[F.col(old).alias(new) for old, new in renames.items()],
        *[F.col(old).cast("boolean").alias(new) for old, new in flags.items()],
    )


def tolerant(rows: DataFrame, value: Column, reason: Column, out: str) -> DataFrame:
    """All rows with ``value`` as ``out`` and, where that is NULL, the ``reason`` as ``error``, in one reading."""
    tried = rows.withColumn(out, value)
    return tried.withColumn("error", F.when(F.col(out).isNull(), reason))

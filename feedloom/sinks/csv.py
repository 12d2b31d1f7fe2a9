"""CSV export that is byte-equal to the usual data-frame CSV: minimal quoting, doubled quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom import presets
from feedloom.functions.text import _col, file_target
from feedloom.schema import POST_COLUMNS, POST_SCHEMA

# Spark's defaults would trim values, escape with a backslash, write "" for empty text and quote any
# value starting with the comment mark, which is where hashtags stand.
WRITE_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "comment": "\x01",
}
READ_OPTIONS = {
    "header": True,
    "escape": '"',
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write as CSV, one file per partition. NULL and ``""`` both become an empty field."""
    df.write.options(**WRITE_OPTIONS).mode(mode).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: StructType = POST_SCHEMA) -> DataFrame:
    """Read back what ``write_csv`` wrote; empty fields are NULL."""
    return spark.read.schema(schema).options(**READ_OPTIONS).csv(folder)


def empty_result(spark: SparkSession) -> DataFrame:
    """No posts: still the four typed columns, and as CSV still the header."""
    return spark.createDataFrame([], POST_SCHEMA)


def csv_file_name(target: Column | str, kind: str, engine: str) -> Column:
    """The download name. Built from the raw target without its sigils, not from the cleaned one."""
    return F.concat(file_target(target, presets.SIGIL[kind]), F.lit(presets.FILE_SUFFIX[engine]))


def csv_file_names(requests: DataFrame) -> DataFrame:
    """``csv_file_name`` by each request's kind and engine."""
    sigil = F.when(F.col("kind") == "hashtag", presets.SIGIL["hashtag"]).otherwise(presets.SIGIL["user"])
    suffix = F.when(F.col("engine") == "a", presets.FILE_SUFFIX["a"]).otherwise(presets.FILE_SUFFIX["b"])
    return requests.withColumn("file_name", F.concat(file_target("target", sigil), suffix))


def run_stamp_name(kind: Column | str, target: Column | str, ts: Column | str) -> Column:
    """``{kind}_{target}_{yyyyMMdd_HHmmss}.csv``. The time is an argument, never the clock per row."""
    stamp = F.date_format(_col(ts), "yyyyMMdd_HHmmss")
    return F.concat(_col(kind), F.lit("_"), _col(target), F.lit("_"), stamp, F.lit(".csv"))


def write_per_target(
    posts: DataFrame, folder: str, max_rows_per_file: int = 1_000_000, mode: str = "errorifexists"
) -> None:
    """One folder per ``file_name``, its files in ``numero`` order.

    Range partitioning on (file_name, numero) keeps small targets whole and cuts a large one into
    consecutive pieces, so no task writes a whole large target.
    """
    (
        posts.select("file_name", *POST_COLUMNS)
        .repartitionByRange("file_name", "numero")
        .sortWithinPartitions("file_name", "numero")
        .write.options(**WRITE_OPTIONS)
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("file_name")
        .mode(mode)
        .csv(folder)
    )

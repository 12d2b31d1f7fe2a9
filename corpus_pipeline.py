"""From raw documents to a packed training set, in stages that are each written and read again.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows it keeps with all columns of
documents. The next stage reads them from Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontaminate, jaccard_join, mix_sources, quality_knn, repair_files
from feedloom.llm.common import stored
from feedloom.llm.registry import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote for.

    Null and empty texts have the labelled sample's mean score; repeated rows are judged alike; an empty table gives no rows. Columns
    beside doc_id and text are carried along, whatever their names.
    """
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: 3-word shingles, a similarity of 0.9 or more.

    One changed word in 57 is as far as this goes, about 0.84 in shingles of five words; README tells what five words at 0.8 would cost. The
    smallest doc_id of a class stays, one row of it. Null, empty and blank texts are copies of nothing, rows without doc_id stay.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark n-grams.

    Null, empty and very short texts have no hit and stay; repeated rows are judged alike; an empty benchmark drops nothing.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it.

    A null source is one of its own; texts without words take nothing from a budget; reruns draw the same.
    """
    return mix_sources.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The compressed files of the mixture, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; repeated rows are written each; very long texts are a shard of their own.
    """
    return repair_files.encode_and_read(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: The classifier and the compressed files have no SQL counterpart; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

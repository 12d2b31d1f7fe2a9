"""Extraction requests: one row is one call."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import presets
from feedloom.functions.text import clean_target
from feedloom.functions.urls import urls_by_kind
from feedloom.schema import REQUEST_SCHEMA


def read_requests(spark: SparkSession, rows: Iterable[Mapping] | str) -> DataFrame:
    """Requests from dicts (numbered as given) or from a parquet path."""
    if isinstance(rows, str):
        return spark.read.schema(REQUEST_SCHEMA).parquet(rows)
    names = REQUEST_SCHEMA.names
    data = [
        tuple({"req_id": i, "engine": "a", **r}.get(n) for n in names) for i, r in enumerate(rows, 1)
    ]
    return spark.createDataFrame(data, REQUEST_SCHEMA)


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill in unset limits and add ``clean``, the target without blanks around it and its sigil."""
    scrolls = F.when(F.col("engine") == "a", presets.MAX_SCROLLS_A).otherwise(presets.MAX_SCROLLS_B)
    sigil = F.when(F.col("kind") == "hashtag", presets.SIGIL["hashtag"]).otherwise(presets.SIGIL["user"])
    return requests.withColumns(
        {
            "clean": clean_target("target", sigil),
            "max_tweets": F.coalesce("max_tweets", F.lit(presets.MAX_TWEETS)),
            "min_tweets": F.coalesce("min_tweets", F.lit(presets.MIN_TWEETS)),
            "max_scrolls": F.coalesce("max_scrolls", scrolls),
        }
    )


def candidate_urls(requests: DataFrame) -> DataFrame:
    """Each request (with defaults filled in) once per address to try, in order from 1."""
    kept = requests.columns
    urls = urls_by_kind("clean", "kind", "engine")
    return requests.select(*kept, F.posexplode(urls).alias("_i", "requested_url")).select(
        *kept, (F.col("_i") + 1).alias("priority"), "requested_url"
    )

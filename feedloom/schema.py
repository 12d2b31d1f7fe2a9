"""Column layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The one relation every job ends in. Always these four typed columns, also when there are no rows.
POST_COLUMNS = ("texto", "usuario", "timestamp", "numero")

POST_SCHEMA = T.StructType(
    [
        T.StructField("texto", T.StringType()),
        T.StructField("usuario", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("numero", T.LongType()),
    ]
)

# A kept page.
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# One extraction request. `target` is raw: it may carry a sigil or blanks.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("req_id", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("engine", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("max_tweets", T.IntegerType()),
        T.StructField("min_tweets", T.IntegerType()),
        T.StructField("max_scrolls", T.IntegerType()),
    ]
)

# One captured page. `requested_url` is what was asked for, `url` where the browser ended up.
SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("requested_url", T.StringType(), False),
        T.StructField("scroll", T.IntegerType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

_TEXT_LISTS = T.ArrayType(T.ArrayType(T.StringType()))
_TIME_LISTS = T.ArrayType(
    T.ArrayType(
        T.StructType([T.StructField("attr", T.StringType()), T.StructField("text", T.StringType())])
    )
)

# What markup extraction returns for one card: for each selector, in order, every match in document order.
CARD_TYPE = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("texts", _TEXT_LISTS),
        T.StructField("users", _TEXT_LISTS),
        T.StructField("times", _TIME_LISTS),
        T.StructField("whole", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

# What it returns for one page: `found` counts every card, `cards` holds those up to the requested cap.
PAGE_CARDS_TYPE = T.StructType(
    [
        T.StructField("found", T.IntegerType()),
        T.StructField("cards", T.ArrayType(CARD_TYPE)),
        T.StructField("error", T.StringType()),
    ]
)

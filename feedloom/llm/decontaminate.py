"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned by all windows of training words.

A window's key is a hash of its first and last word. Windows are exploded from arrays of keys straight into a broadcast
hash join, so that only windows with a known key ever become text; those are then joined with the n-grams by their whole
words, which is the exact check. The n-grams are broadcast in blocks of at most BLOCK_ROWS keys, one reading of the texts
each, so that a benchmark of any size has a bounded broadcast. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small, stored, text_of

#: Benchmark keys that are broadcast at once (12 bytes each).
BLOCK_ROWS = 1_000_000
WINDOW = 13

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Runs of digits, letters and all code points above 0x7F; A-Z lower-cased, other letters as they are."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _key(words: str, at: str, length: str) -> str:
    return f"xxhash64({length}, {words}[{at}], {words}[{at} + {length} - 1])"


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, length, key, item_id): every window of every item; a shorter item that has words is one window."""
    items = benchmark.select("item_id", normal_words(F.coalesce("text", F.lit(""))).alias("words"), F.lit(window).alias("window"))
    items = items.where("size(words) > 0").selectExpr("item_id", "words", "least(window, size(words)) AS length")
    at = items.selectExpr("item_id", "words", "length", "explode(sequence(0, size(words) - length)) AS at")
    return at.selectExpr("array_join(slice(words, at + 1, length), ' ') AS gram", "length", f"{_key('words', 'at', 'length')} AS key", "item_id").distinct()


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, at, length, item_id): each window of a document's words that is an n-gram of an item.

    ``mark`` is a hash of the text; (doc_id, mark) names the row. Repeated rows give the same windows once.
    """
    grams = stored(benchmark_grams(benchmark, window), "grams")
    keys = stored(grams.select("length", "key").distinct(), "gram-keys")
    lengths = sorted(r["length"] for r in keys.select("length").distinct().collect())  # at most ``window`` numbers
    blocks = max(1, -(-keys.count() // BLOCK_ROWS))
    words = text_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), normal_words(F.col("text")).alias("words"))
    # One array of (length, position, key) for all lengths; a text with fewer words than a length has none of it.
    spans = ", ".join(
        f"transform(sequence(0, greatest(size(words) - {n}, 0)), i -> named_struct('length', {n}, 'at', i, 'key', CASE WHEN i + {n} <= size(words) THEN {_key('words', 'i', str(n))} END))"
        for n in lengths
    )
    spans = f"concat({spans})" if lengths else "array(named_struct('length', 0, 'at', 0, 'key', CAST(NULL AS BIGINT)))"
    # The outer explode: for the inner one the optimiser filters on size(spans) and works the words out anew for each window.
    windows = words.selectExpr("doc_id", "mark", "words", f"{spans} AS spans").selectExpr("doc_id", "mark", "words", "explode_outer(spans) AS s")
    windows = windows.selectExpr("doc_id", "mark", "words", "s.length AS length", "s.at AS at", "s.key AS key")
    near = [
        windows.join(F.broadcast(keys.where(F.pmod("key", F.lit(blocks)) == b)), ["length", "key"], "left_semi").selectExpr(
            "doc_id", "mark", "at", "length", "array_join(slice(words, at + 1, length), ' ') AS gram"
        )
        for b in range(blocks)
    ]
    return reduce(DataFrame.union, near).distinct().join(small(grams.select("gram", "length", "item_id")), ["gram", "length"]).select("doc_id", "mark", "at", "length", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    n_hit counts the words inside any occurrence of an n-gram, n_items the items with occurring n-grams; contaminated means
    n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words; repeated rows have equal results; items
    without item_id hit words but are not listed. An empty benchmark hits nothing, an empty table gives no rows.
    """
    found = stored(found_windows(docs, benchmark, window), "windows")
    hit = (
        found.select("doc_id", "mark", "at", "length")
        .distinct()
        .select("doc_id", "mark", F.explode(F.expr("sequence(at, at + length - 1)")).alias("word"))
        .distinct()
        .groupBy("doc_id", "mark")
        .agg(F.count("*").alias("n_hit"))
    )
    items = (
        found.where("item_id IS NOT NULL")
        .select("doc_id", "mark", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = hit.join(items, (hit["mark"] == items["mark"]) & hit["doc_id"].eqNullSafe(items["doc_id"]), "left")
    found = found.select(hit["doc_id"].alias("d"), hit["mark"].alias("m"), "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    base = text_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(small(stored(found, "found")), (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns."""
    bad = contamination(docs, benchmark, window, share).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    bad = small(stored(bad, "contaminated"))
    return docs.join(bad, (mark == bad["_bad_mark"]) & docs["doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of ``docs``; words inside found n-grams are cut from ``text``, each with the gap before it."""
    found = found_windows(docs, benchmark, window).select("doc_id", "mark", F.explode(F.expr("sequence(at, at + length - 1)")).alias("word")).distinct()
    cuts = found.groupBy("doc_id", "mark").agg(F.collect_set("word").alias("_cuts")).select(F.col("doc_id").alias("_cut_id"), F.col("mark").alias("_cut_mark"), "_cuts")
    cuts = small(stored(cuts, "cuts"))
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(cuts, (mark == cuts["_cut_mark"]) & docs["doc_id"].eqNullSafe(cuts["_cut_id"]), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    parts = F.regexp_extract_all(docs["text"], F.lit(f"((?:{_GAP})?{word}|{_GAP}$)"), 1)
    kept = F.array_join(F.transform(parts, lambda w, i: F.when(F.array_contains(cuts["_cuts"], i), "").otherwise(w)), "")
    return joined.select(*[F.when(cuts["_cuts"].isNull(), docs["text"]).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
wins AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM grams) AS l, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT rid, i, n, item_id FROM wins JOIN grams USING (gram, n)),
words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

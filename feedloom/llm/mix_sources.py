"""Mixing sources to target weights: Efraimidis-Spirakis sampling to a budget of words for each source.

A document's key is an exponential number divided by its quality weight; the smallest keys are taken first, so better
documents are likelier to be taken. A source whose target is above its size is taken whole as often as that fits
(complete epochs); the rest is the front of its key order, cut where the running sum of sizes comes nearest to the rest.

No source is sorted in one task: the keys of a source are cut into bins, sizes are summed per bin, and the bin in which the
budget ends is cut again, ROUNDS times; only what is left between two keys is ordered. Texts are read once; everything after works on
a narrow written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import small, stored, text_of

#: Bins that a range of a source's keys is cut into, and how often: the last range is ordered by one task.
BINS, ROUNDS = 4096, 3
#: No document is taken more often, and no target is above this many times the source.
MOST_TIMES = 3
_WORD = r"[^\x20\x09-\x0D]+"


def weighted_sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, mark, size, key): words, and the exponential key scaled by quality, the share of characters that are no symbols."""
    text = F.col("text")
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    quality = F.greatest(F.lit(0.05), 1.0 - symbols / F.greatest(F.lit(1), F.char_length(text)))
    rows = text_of(docs, "source").select("doc_id", "source", F.md5(text.cast("binary")).alias("mark"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), quality.alias("quality"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), "mark").cast("binary")), 1, 12), 16, 10).cast("double")
    key = -F.log((drawn + 0.5) / float(1 << 48)) / F.col("quality")
    return rows.select("doc_id", "source", "mark", "size", key.alias("key"))


def source_targets(sizes: DataFrame, weights: int = 3) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh 1, 2, ... ``weights`` and again.

    All words are shared by weight; targets stop at MOST_TIMES the source's size and the excess is shared anew. The fixed
    point has a closed form: with sources in order of cap / weight, the level is what the uncapped have left by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", 1 + F.pmod(F.row_number().over(by_name) - 1, F.lit(weights))).withColumn("cap", MOST_TIMES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.withColumn("level", level)
    # Counting a source as capped raises the others' level while its cap is below the level, and lowers it from there on.
    sources = sources.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    return sources.select("source", "source_size", target.alias("target"))


def _narrowed(sizes: DataFrame, ends: DataFrame, bins: int) -> DataFrame:
    """``ends`` with low and high narrowed to the keys of the bin in which the source's rest ends, and base, the words before it.

    Bins are as wide as each other between low and high of the source. A source whose rest is beyond all its words has no such bin and
    gets nulls: all of it is taken.
    """
    held = sizes.join(small(ends.select("s", "low", "high")), F.col("source").eqNullSafe(F.col("s"))).where("key >= low AND key <= high")
    share = (F.col("key") - F.col("low")) / (F.col("high") - F.col("low"))
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor(share * bins))).otherwise(0)
    filled = held.groupBy("source", bin_.cast("int").alias("bin")).agg(F.sum("size").alias("filled"), F.min("key").alias("least"), F.max("key").alias("most"))
    upto = F.sum("filled").over(Window.partitionBy("source").orderBy("bin"))
    run = filled.select(F.col("source").alias("f"), "bin", "least", "most", (upto - F.col("filled")).alias("run"), upto.alias("upto"))
    first = run.join(small(ends.select("s", "rest", "base")), F.col("f").eqNullSafe(F.col("s"))).where("base + upto >= rest")
    first = first.groupBy("f").agg(F.min(F.struct("bin", "least", "most", (F.col("base") + F.col("run")).alias("base"))).alias("e"))
    kept = ends.drop("low", "high", "base").join(first, F.col("s").eqNullSafe(F.col("f")), "left")
    return kept.select("s", "source_size", "target", "epochs", "rest", F.col("e.least").alias("low"), F.col("e.most").alias("high"), F.col("e.base").alias("base"))


def mix(docs: DataFrame, seed: str = "mix", bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, times, taken) for every row of ``docs``; taken = times * size.

    Null texts have size 0; a null source is a source of its own; texts without words are never cut off by a budget that
    is not yet used up. Equal keys, that is repeated rows, are ordered by doc_id and text, and repeated rows among
    themselves in any order. The draw depends on seed, doc_id and text alone, so reruns agree. An empty table gives no rows.
    """
    sizes = stored(weighted_sizes(docs, seed), "sizes")
    targets = stored(source_targets(sizes), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", epochs.cast("int").alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    keys = sizes.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high")).select(F.col("source").alias("k"), "low", "high")
    ends = targets.join(keys, F.col("s").eqNullSafe(F.col("k"))).drop("k").withColumn("base", F.lit(0).cast("bigint"))
    ends = stored(ends, "ends")
    for _ in range(rounds):
        ends = stored(_narrowed(sizes, ends, bins), "ends")

    rows = sizes.join(small(ends), F.col("source").eqNullSafe(F.col("s")))
    inner = rows.where("key >= low AND key <= high")
    before = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    inner = inner.withColumn("extra", (before + F.col("size") / 2 <= F.col("rest")).cast("int"))
    outer = rows.where("low IS NULL OR key < low OR key > high").withColumn("extra", F.coalesce(F.col("key") < F.col("low"), F.lit(True)).cast("int"))
    times = F.least(F.lit(MOST_TIMES), F.col("epochs") + F.col("extra"))
    both = outer.unionByName(inner).withColumn("times", times)
    return both.select("doc_id", "source", "mark", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns.

    Rows that share doc_id, source and text are one row here, taken as often as all of them together.
    """
    chosen = mix(docs, seed).groupBy("doc_id", "mark", "source").agg(F.sum("times").alias("_times"), F.count("*").alias("_rows")).where("_times > 0")
    chosen = stored(chosen.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("source").alias("_source"), "_times", "_rows"), "chosen")

    def joined(part: DataFrame) -> DataFrame:
        mark = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
        same = (mark == part["_mark"]) & docs["doc_id"].eqNullSafe(part["_id"]) & docs["source"].eqNullSafe(part["_source"])
        return docs.join(part, same).select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[part[c] for c in ("_times", "_id", "_mark", "_source")])

    once = joined(small(chosen.where("_rows = 1"))).select("_row", "_times")
    again = joined(small(chosen.where("_rows > 1"))).groupBy("_id", "_mark", "_source").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"), F.first("_times").alias("_times"))
    both = once.union(again.select("_row", "_times"))
    return both.select("_row", F.explode(F.expr("sequence(1, cast(_times AS int))"))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix|' || doc_id || '|' || mark), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / greatest(0.05, 1.0 - len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::DOUBLE / greatest(1, len(t))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM l),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS e,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.mark ROWS UNBOUNDED PRECEDING) - k.size AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(3, e + CASE WHEN before + size / 2.0 <= target - e * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""

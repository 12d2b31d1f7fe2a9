"""Quality rules: counts per text, and the Jensen-Shannon distance of its histograms to references of its language.

Two histograms are compared: classes of characters, and common words of the language (lists below) with a bin for every other
word, so that a text without common words is far from its language and not left unjudged. References are the
summed histograms of all documents of the language that pass the count rules, so they grow with the corpus and need no
given model. Texts with too few characters or words are not judged by that histogram. Texts are read once, by
DataFrame functions only; all that follows works on a narrow written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small, stored, text_of

#: Common words of each language, most frequent first.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour dans par au".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
_NAMES = 16
#: Greatest distances kept, and least characters and words for a judgement.
MOST_CHARS, MOST_WORDS, LEAST_CHARS, LEAST_WORDS = 0.30, 0.26, 300, 100
CLASSES = ["lower", "blank", "high", "upper", "digit", "symbol", "loud", "other"]


def counted(docs: DataFrame) -> DataFrame:
    """The count columns, the class histogram ``chars`` and the common-word histogram ``common`` of every row."""
    blank = r"\x20\x09-\x0D"
    rows = text_of(docs, "lang").select("doc_id", "lang", "text", F.filter(F.split("text", f"[{blank}]+"), lambda w: w != "").alias("words"))
    lists = F.coalesce(*[F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], F.array().cast("array<string>"))
    rows = rows.withColumns(
        {
            "runs": F.expr("IF(size(words) < 3, CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>), array_sort(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))))"),
            "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{blank}]")),
            "list": lists,
            "r1": F.regexp_replace("text", "[a-z]+", ""),
        }
    )
    rows = rows.withColumns(
        {
            "starts": F.expr("array_sort(transform(filter(runs, (x, k) -> coalesce(x.h = get(runs, k - 1).h, false) OR coalesce(x.h = get(runs, k + 1).h, false)), x -> x.i))"),
            "hits": F.expr("filter(transform(words, w -> array_position(list, rtrim('.,;:!?', lower(w)))), k -> k > 0)"),
            "r2": F.regexp_replace("r1", f"[{blank}]+", ""),
        }
    )
    rows = rows.withColumn("r3", F.regexp_replace("r2", r"[^\x00-\x7F]+", ""))
    rows = rows.withColumn("r4", F.regexp_replace("r3", "[A-Z]+", ""))
    rows = rows.withColumn("r5", F.regexp_replace("r4", "[0-9]+", ""))
    rows = rows.withColumn("r6", F.regexp_replace("r5", r"[#*$%&|<>]+", ""))
    rows = rows.withColumn("r7", F.regexp_replace("r6", "[!?]+", ""))
    length = [F.char_length(c).cast("long") for c in ("text", "r1", "r2", "r3", "r4", "r5", "r6", "r7")]
    chars = [a - b for a, b in zip(length, length[1:])] + [length[-1]]
    covered = "aggregate(starts, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"
    return rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (length[0] - (length[1] - length[2])).alias("word_chars"),
        (length[5] - length[6]).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.array(*chars).alias("chars"),
        F.expr(f"concat(transform(sequence(1, {_NAMES}), k -> CAST(size(filter(hits, h -> h = k)) AS BIGINT)), array(CAST(size(words) - size(hits) AS BIGINT)))").alias("common"),
    )


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if one has no counts."""
    share = f"zip_with(transform({p}, x -> x / aggregate({p}, 0D, (a, x) -> a + x)), transform({q}, x -> x / aggregate({q}, 0D, (a, x) -> a + x)), (x, y) -> struct(x, y, (x + y) / 2 AS m))"
    term = "(IF(s.x > 0, s.x * log2(s.x / s.m), 0D) + IF(s.y > 0, s.y * log2(s.y / s.m), 0D)) / 2"
    return F.expr(f"sqrt(greatest(0D, aggregate(transform({share}, s -> {term}), 0D, (a, x) -> a + x)))")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, js_chars, js_words, kept) for every row of ``docs``.

    Words are runs outside blanks. base_failed: fewer than 50 words, or more than half of the words in repeated 3-word
    windows. kept: not base_failed, and each histogram long enough for a judgement is near its language's reference. A
    language (null is one) without passing documents has no reference and judges nothing; in languages without a list all
    words are other words. Null texts are empty; repeated rows are judged each; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(counted(docs).withColumn("base_failed", failed), "rule-counts")
    sums = [F.sum(F.col("chars")[k]) for k in range(len(CLASSES))], [F.sum(F.col("common")[k]) for k in range(_NAMES + 1)]
    references = rows.where("NOT base_failed").groupBy("lang").agg(F.array(*sums[0]).alias("ref_chars"), F.array(*sums[1]).alias("ref_common"))
    references = stored(references.withColumnRenamed("lang", "ref_lang"), "rule-references")
    out = rows.join(small(references), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    js_chars = F.when(F.col("word_chars") >= LEAST_CHARS, _distance("chars", "ref_chars"))
    js_words = F.when(F.col("n_words") >= LEAST_WORDS, _distance("common", "ref_common"))
    out = out.withColumns({"js_chars": js_chars, "js_words": js_words})
    near = (F.coalesce("js_chars", F.lit(0.0)) <= MOST_CHARS) & (F.coalesce("js_words", F.lit(0.0)) <= MOST_WORDS)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", (~F.col("base_failed") & near).alias("kept"))


_LISTS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines,
         CASE lang {_LISTS} ELSE [] END AS common_list FROM documents),
runs AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS r FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, r) AS c FROM runs) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
hits AS (SELECT rid, list_position(common_list, rtrim(lower(x), '.,;:!?')) AS k FROM (SELECT rid, common_list, unnest(w) AS x FROM d) WHERE list_contains(common_list, rtrim(lower(x), '.,;:!?'))),
hist AS (SELECT rid, {", ".join(f"count(*) FILTER (k = {k}) AS c{k}" for k in range(1, _NAMES + 1))}, count(*) AS n_hits FROM hits GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         [length(regexp_replace(t, p, '', 'g')) FOR p IN ['[^a-z]+', '[^\x20\x09-\x0D]+', '[\x00-\x7F]+', '[^A-Z]+', '[^0-9]+', '[^#*$%&|<>]+', '[^!?]+', '[a-z\x20\x09-\x0DA-Z0-9#*$%&|<>!?]+|[^\x00-\x7F]+']] AS chars,
         [{", ".join(f"coalesce(c{k}, 0)" for k in range(1, _NAMES + 1))}, len(w) - coalesce(n_hits, 0)] AS common
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN hist USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
ref AS (SELECT lang, [{", ".join(f"sum(chars[{k}])" for k in range(1, len(CLASSES) + 1))}] AS rc, [{", ".join(f"sum(common[{k}])" for k in range(1, _NAMES + 2))}] AS rw FROM g WHERE NOT base_failed GROUP BY lang),
sh AS (SELECT g.*, [x / list_sum(chars) FOR x IN chars] AS p1, [x / list_sum(rc) FOR x IN rc] AS q1, [x / list_sum(common) FOR x IN common] AS p2, [x / list_sum(rw) FOR x IN rw] AS q2
       FROM g LEFT JOIN ref ON g.lang IS NOT DISTINCT FROM ref.lang),
js AS (SELECT *, sqrt(greatest(0, list_sum([CASE WHEN p1[k] > 0 THEN p1[k] * log2(p1[k] * 2 / (p1[k] + q1[k])) ELSE 0 END + CASE WHEN q1[k] > 0 THEN q1[k] * log2(q1[k] * 2 / (p1[k] + q1[k])) ELSE 0 END FOR k IN range(1, {len(CLASSES) + 1})]) / 2)) AS a,
              sqrt(greatest(0, list_sum([CASE WHEN p2[k] > 0 THEN p2[k] * log2(p2[k] * 2 / (p2[k] + q2[k])) ELSE 0 END + CASE WHEN q2[k] > 0 THEN q2[k] * log2(q2[k] * 2 / (p2[k] + q2[k])) ELSE 0 END FOR k IN range(1, {_NAMES + 2})]) / 2)) AS b FROM sh)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars < {LEAST_CHARS} OR coalesce(a, 0) <= {MOST_CHARS}) AND (n_words < {LEAST_WORDS} OR coalesce(b, 0) <= {MOST_WORDS}) AS kept FROM js
"""

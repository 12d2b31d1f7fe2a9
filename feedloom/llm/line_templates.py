"""Line dedup by a log-template tree: lines of the same template that recur across documents are dropped.

A line's tokens with a digit become the variable field ``<*>``. The tree has a fixed depth: its levels are the token count
and the first DEPTH tokens; a leaf holds the lines that agree in them. A leaf's seed is its line in most documents (ties:
the least text). Lines that equal the seed in at least LIKE of their tokens have the seed's template, the tokens that differ
being variable fields; every other line is a template of its own. Templates in LEAST_DOCS documents or more are dropped.

Leaves and templates are counted by hashes with partial sums, once per document, so a line that stands everywhere costs
each task one row. Only lines of leaves that several documents share are sent as text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small, stored, text_of

DEPTH, LIKE, LEAST_DOCS = 3, 0.6, 3
FIELD = "<*>"


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, at, line, leaf): each line with a token, its fields masked and blanks made single."""
    rows = text_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode_outer(F.split("text", "\n")).alias("at", "raw"))
    raw = F.col("raw")
    # The dear replacements only where they have something to do.
    single = F.when(raw.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(raw, r"[\x20\x09-\x0D]+", " ")).otherwise(raw)
    rows = rows.select("doc_id", "mark", "at", F.trim(single).alias("raw")).where("raw <> ''")
    line = F.when(raw.rlike("[0-9]"), F.regexp_replace(raw, r"[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(raw)
    rows = rows.select("doc_id", "mark", "at", line.alias("line"))
    gaps = F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.withColumn("leaf", F.xxhash64(gaps, F.substring_index("line", " ", DEPTH)))


def line_templates(docs: DataFrame, least: int = LEAST_DOCS, like: float = LIKE) -> DataFrame:
    """(line, template, n_docs, dropped) for every masked line of a leaf that several documents share.

    n_docs: documents (rows with a doc_id and text of their own) with the template; dropped: n_docs >= ``least``.
    """
    once = parsed_lines(docs).select("leaf", F.xxhash64("mark", "doc_id").alias("document"))
    several = once.groupBy("leaf").agg(F.min("document").alias("a"), F.max("document").alias("b"))
    several = stored(several.where("a < b").select("leaf"), "leaves")
    shared = stored(parsed_lines(docs).join(small(several), "leaf", "left_semi").select("leaf", "line", "doc_id", "mark").distinct(), "shared-lines")
    lines = shared.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    seeds = lines.groupBy("leaf").agg(F.max("n").alias("most")).join(lines, "leaf").where("n = most").groupBy("leaf").agg(F.min("line").alias("seed"))
    tokens = F.zip_with(F.split("line", " "), F.split("seed", " "), lambda x, y: F.when(x == y, 1).otherwise(0))
    same = F.aggregate(tokens, F.lit(0), lambda a, x: a + x) / F.size(F.split("line", " "))
    template = F.when(same >= like, F.col("seed")).otherwise(F.col("line"))
    parsed = stored(lines.select("leaf", "line").join(seeds, "leaf").select("leaf", "line", template.alias("template")), "templates")
    number = shared.join(parsed, ["leaf", "line"]).select("leaf", "template", "doc_id", "mark").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n_docs"))
    return parsed.join(number, ["leaf", "template"]).select("line", "template", "n_docs", (F.col("n_docs") >= least).alias("dropped"))


def dropped_lines(docs: DataFrame, least: int = LEAST_DOCS, like: float = LIKE) -> DataFrame:
    """(doc_id, mark, at) of every line of a recurring template, each once; ``mark`` is a hash of the text."""
    gone = stored(line_templates(docs, least, like).where("dropped").select(F.xxhash64("line").alias("h")).distinct(), "dropped-lines")
    return parsed_lines(docs).withColumn("h", F.xxhash64("line")).join(small(gone), "h", "left_semi").select("doc_id", "mark", "at").distinct()


def line_counts(docs: DataFrame, least: int = LEAST_DOCS, like: float = LIKE) -> DataFrame:
    """(doc_id, n_lines, n_dropped) for every row of ``docs``; n_lines counts lines with a token.

    Null and empty texts have no lines; rows that repeat doc_id and text are one document; a null doc_id is a document with
    its text. An empty table gives no rows.
    """
    n = dropped_lines(docs, least, like).groupBy("doc_id", "mark").agg(F.count("*").alias("n_dropped"))
    n = stored(n.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "n_dropped"), "line-counts")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    base = text_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), lines.alias("n_lines"))
    out = base.join(small(n), (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))


def without_lines(docs: DataFrame, least: int = LEAST_DOCS, like: float = LIKE) -> DataFrame:
    """``docs`` with the recurring lines cut from ``text``; all rows and columns stay."""
    cuts = dropped_lines(docs, least, like).groupBy("doc_id", "mark").agg(F.collect_list("at").alias("cuts"))
    cuts = small(stored(cuts, "line-cuts"))
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(cuts, (mark == cuts["mark"]) & docs["doc_id"].eqNullSafe(cuts["doc_id"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(cuts["cuts"], i)), "\n")
    return joined.select(*[F.when(cuts["cuts"].isNull(), docs["text"]).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, md5(coalesce(text, '')) AS mark, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT rid, doc_id, mark, i, trim(regexp_replace(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g'), '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g'), ' ') AS line
        FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
l AS (SELECT *, (len(string_split(line, ' ')) || '|' || array_to_string(string_split(line, ' ')[1:{DEPTH}], ' ')) AS leaf FROM raw WHERE line <> ''),
o AS (SELECT DISTINCT doc_id, mark, leaf, line FROM l),
several AS (SELECT leaf FROM o GROUP BY leaf HAVING count(DISTINCT (doc_id, mark)) > 1),
n AS (SELECT leaf, line, count(*) AS n FROM o SEMI JOIN several USING (leaf) GROUP BY ALL),
seeds AS (SELECT leaf, min(line) AS seed FROM (SELECT *, max(n) OVER (PARTITION BY leaf) AS most FROM n) WHERE n = most GROUP BY leaf),
t AS (SELECT leaf, line, CASE WHEN list_sum([CASE WHEN string_split(line, ' ')[k] = string_split(seed, ' ')[k] THEN 1 ELSE 0 END FOR k IN range(1, len(string_split(line, ' ')) + 1)]) / len(string_split(line, ' ')) >= {LIKE} THEN seed ELSE line END AS template
      FROM n JOIN seeds USING (leaf)),
c AS (SELECT leaf, template, count(DISTINCT (doc_id, mark)) AS k FROM o JOIN t USING (leaf, line) GROUP BY ALL),
gone AS (SELECT DISTINCT line FROM t JOIN c USING (leaf, template) WHERE k >= {LEAST_DOCS})
SELECT d.doc_id, count(l.line)::BIGINT AS n_lines, count(gone.line)::BIGINT AS n_dropped
FROM d LEFT JOIN l ON d.rid = l.rid LEFT JOIN gone ON l.line = gone.line GROUP BY d.rid, d.doc_id
"""

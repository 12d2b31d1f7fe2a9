"""License scans: MinHash bands over overlapping windows of text retrieve license templates, exact containment verifies.

Words are runs of letters and digits, A-Z lower-cased; shingles are 3 of them. Shingles of no template can add nothing to a
containment, so windows keep template shingles only: all others fall to a broadcast hash join right after they are made.
Templates are put in classes by length, L words at most; a class's windows are 2 L words long and start every L words, so
each occurrence of a template lies whole in a window. A window is signed for each template apart, by the shingles it shares
with it, so other notices nearby take nothing away: its Jaccard similarity s with the template is the containment, and they
meet with probability 1 - (1 - s^ROWS)^BANDS, over 1 - 1e-14 from CONTAINED on. A window matches if it holds at least
CONTAINED of a template's distinct shingles, counted exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import small, stored, text_of
from feedloom.llm.decontaminate import normal_words

ROWS, BANDS, CONTAINED = 2, 32, 0.8
CLASSES = [8, 16, 32, 64, 128, 256, 512]

#: Notices as their licenses word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text) of the built-in notices, or of ``templates``."""
    return spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license_id string, text string")


def _shingles(words: str) -> str:
    return f"IF(size({words}) < 3, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, greatest(size({words}) - 3, 0)), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])))"


def _bands(keys: list[str], rows: DataFrame) -> DataFrame:
    """One row per group of ``keys`` and band: the hashes of ROWS minima over the group's shingles, and ``held``, their number."""
    minima = [F.min(F.xxhash64("shingle", F.lit(j))).alias(f"m{j}") for j in range(ROWS * BANDS)]
    signed = rows.groupBy(*keys).agg(*minima, F.count("*").alias("held"))
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return signed.select(*keys, "held", F.explode(bands).alias("band"))


def license_matches(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, mark, license_id, containment): templates found in a document, with the best window's containment.

    ``mark`` is a hash of the text; repeated rows give the same matches once. Templates of fewer than 3 or more than 512 words
    are refused, so that the broadcast is bounded by the number of templates.
    """
    words = templates.select("license_id", normal_words(F.coalesce("text", F.lit(""))).alias("words"))
    longest = words.agg(F.max(F.size("words")), F.min(F.size("words"))).first()
    if longest[0] is not None and (longest[0] > CLASSES[-1] or longest[1] < 3):
        raise ValueError("templates need 3 to 512 words")
    size = F.coalesce(*[F.when(F.size("words") <= n, n) for n in CLASSES])
    marks = stored(words.withColumn("size", size).selectExpr("license_id", "size", f"explode(array_distinct({_shingles('words')})) AS shingle"), "license-shingles")

    spread = text_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), normal_words(F.col("text")).alias("words"))
    # The outer explode: for the inner one the optimiser filters on the array's size and makes it twice.
    found = spread.selectExpr("doc_id", "mark", f"posexplode_outer({_shingles('words')}) AS (at, shingle)").join(small(marks.select("shingle").distinct()), "shingle", "left_semi")
    found = stored(found.distinct(), "license-hits")
    placed = found.join(small(marks.select("size", "shingle").distinct()), "shingle").selectExpr("doc_id", "mark", "size", "shingle", "explode(array(at div size, at div size - 1)) AS window")
    windows = stored(placed.where("window >= 0 OR window = -1").distinct(), "license-windows")
    keys = ["doc_id", "mark", "size", "window"]
    # Per window and template, the minima over their common shingles and how many those are.
    common = windows.join(small(marks), ["size", "shingle"])
    near = _bands([*keys, "license_id"], common).join(small(_bands(["license_id", "size"], marks).drop("held")), ["license_id", "size", "band"], "left_semi")
    held = near.select(*keys, "license_id", "held").distinct()
    total = marks.groupBy("license_id").agg(F.count("*").alias("total"))
    best = held.join(small(total), "license_id").groupBy("doc_id", "mark", "license_id").agg(F.max(F.col("held") / F.col("total")).alias("containment"))
    return best.where(F.col("containment") >= CONTAINED)


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_licenses, licenses) for every row of ``docs``; licenses: the ids found, sorted and comma-joined.

    Null and empty texts have none; repeated rows have equal results; a null doc_id stays null. An empty table gives no rows.
    """
    found = license_matches(docs, templates or template_table(docs.sparkSession))
    found = found.groupBy("doc_id", "mark").agg(F.array_join(F.array_sort(F.collect_list("license_id")), ",").alias("ids"), F.count("*").alias("n"))
    found = stored(found.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "ids", "n"), "licenses")
    base = text_of(docs).select("doc_id", F.xxhash64("text").alias("mark"))
    out = base.join(small(found), (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_licenses"), F.coalesce("ids", F.lit("")).alias("licenses"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH t(license_id, text) AS (VALUES {", ".join(f"('{k}', {_sql_text(v)})" for k, v in sorted(TEMPLATES.items()))}),
tw AS (SELECT license_id, {_WORDS.format("text")} AS w FROM t),
ts AS (SELECT DISTINCT license_id, [c FOR c IN {CLASSES} IF c >= len(w)][1] AS size, array_to_string(w[i : i + 2], ' ') AS s FROM tw, unnest(range(1, len(w) - 1)) AS u(i)),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format("text")} AS w FROM documents),
ds AS (SELECT rid, i - 1 AS pos, array_to_string(w[i : i + 2], ' ') AS s FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
h AS (SELECT DISTINCT rid, license_id, size, s, pos // size - o AS win FROM ds JOIN ts USING (s), unnest([0, 1]) AS v(o)),
c AS (SELECT rid, license_id, win, count(*) AS k FROM h GROUP BY ALL),
m AS (SELECT DISTINCT rid, license_id FROM c JOIN (SELECT license_id, count(*) AS n FROM ts GROUP BY ALL) USING (license_id) WHERE k / n >= {CONTAINED})
SELECT doc_id, count(license_id)::BIGINT AS n_licenses, coalesce(string_agg(license_id, ',' ORDER BY license_id), '') AS licenses FROM d LEFT JOIN m USING (rid) GROUP BY d.rid, doc_id
"""

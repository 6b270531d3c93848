"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment decides.

Windows are as long as the template they look for and start every quarter of that length, so one of them always lies
within an eighth of the template's length of any copy. Windows without any shingle of a
template are not built: they could agree with none of its MinHash values. Identifier lines, which are shorter than a shingle, are read as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.llm.common import query, table, whole

WORDS = 5
CONTAINED = 0.8
#: One MinHash value to a band. A window in which a template is at the threshold, at the worst start, has a Jaccard similarity of about 0.45 with it: all bands miss it with probability 0.55**24 < 1e-6.
BANDS = 24
#: A catalogue of more shingles than this is refused; its shingles are literals of the plan.
MOST_SHINGLES = 50_000

# Public licence notices.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
     "for the specific language governing permissions and limitations under the License."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
     "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("GPL-2.0", "version", "either version 2 of the License, or (at your option) any later version"),
    ("LGPL", "terms", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "terms", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("CC0-1.0", "notice", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
     "public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software"),
    ("MIT", "disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("BSD", "disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
     "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
]
# An identifier line, and the identifiers in it.
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?: (?:AND|OR|WITH) \(*[A-Za-z0-9.+-]+\)*)*)"
IDENTIFIER = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
JOINED = ("AND", "OR", "WITH")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once: the optimizer does not copy a generated value into what uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def words_of(text: str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(whole(text)), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles_of(words: str) -> Column:
    """Hashes of the runs of five words, by place."""
    last = F.size(words) - WORDS
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def bands_of(part: Column | str, length: Column | str) -> Column:
    """A key for each band of a window's shingles; windows of different lengths share none."""
    return F.array(*[F.xxhash64(F.lit(j), length, F.array_min(F.transform(part, lambda h: F.xxhash64(F.lit(j), h)))) for j in range(BANDS)])


def catalogue(spark: SparkSession, templates: list[tuple[str, str, str]]) -> DataFrame:
    """(license, kind, length, known): the templates of at least five words with their distinct shingles."""
    rows = spark.createDataFrame(templates, "license string, kind string, text string")
    rows = held(held(rows, "words", words_of("text")), "known", F.array_distinct(shingles_of("words")))
    return rows.where(F.size("known") > 0).select("license", "kind", F.size("words").alias("length"), "known")


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, body, license, kind, containment): what part of a template's shingles the best place of a text holds, at least 0.8.

    Identifiers of identifier lines are of kind ``spdx`` and containment 1.

    ``doc`` is the id, ``body`` a hash of the text. A place is a window and a quarter of its length on either side.
    Repeated rows give one answer; null, empty and wordless texts, and templates under five words, give none.
    """
    spark = docs.sparkSession
    known = catalogue(spark, templates)
    rows = known.collect()  # the catalogue is given, not gathered
    wanted = sorted({h for r in rows for h in r["known"]})
    if len(wanted) > MOST_SHINGLES:
        raise ValueError(f"{len(wanted)} shingles in the catalogue; at most {MOST_SHINGLES}")
    lengths = sorted({r["length"] for r in rows})
    texts = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(whole(text)).alias("body"), F.col(text).alias("text"))
    texts = held(texts, "words", words_of("text")).select("doc", "body", "words")
    texts = held(texts, "all", shingles_of("words")).select("doc", "body", "all")
    places = F.filter(F.transform("all", lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull())
    texts = held(texts, "hits", places).where(F.size("hits") > 0)

    def starts(length: int) -> Column:
        """Starts of the windows of this length that hold a hit, and how many shingles they have."""
        step = max(1, length // 4)

        def from_to(p: Column) -> Column:
            low = F.ceil(F.greatest(p - (length - WORDS), F.lit(0)) / step).cast("int")
            return F.sequence(low, F.greatest(low, F.floor(p / step).cast("int")))

        return F.transform(F.array_distinct(F.flatten(F.transform("hits", from_to))),
                           lambda s: F.struct(F.lit(length).alias("length"), (s * step).alias("start"), F.lit(step).alias("step")))

    if not lengths:
        raise ValueError("no template has five words")
    windows = texts.withColumn("w", F.explode(F.concat(*[starts(n) for n in lengths])))
    first = F.greatest(F.col("w.start") - F.col("w.step"), F.lit(0))
    windows = windows.select(
        "doc", "body", F.col("w.length").alias("length"), F.slice("all", F.col("w.start") + 1, F.col("w.length") - WORDS + 1).alias("part"),
        F.slice("all", first + 1, F.col("w.start") + F.col("w.length") + F.col("w.step") - WORDS + 1 - first).alias("place")).where(F.size("part") > 0)
    keyed = windows.withColumn("band", F.explode(bands_of("part", "length"))).select("doc", "body", "band", "place")
    index = known.withColumn("band", F.explode(bands_of("known", "length"))).select("license", "kind", "known", "band")
    found = keyed.join(F.broadcast(index), "band")
    share = F.size(F.array_intersect("known", "place")) / F.size("known")
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda e: F.regexp_extract_all(e, F.lit(IDENTIFIER), 0)))
    lines = docs.where(F.contains(F.col(text), F.lit("SPDX-License-Identifier:"))).select(
        F.col(doc_id).alias("doc"), F.xxhash64(whole(text)).alias("body"), F.explode(listed).alias("license"), F.lit("spdx").alias("kind"), F.lit(1.0).alias("containment"))
    found = found.withColumn("containment", share).where(F.col("containment") >= CONTAINED).select(lines.columns)
    return found.unionByName(lines.where(~F.col("license").isin(*JOINED))) \
        .groupBy("doc", "body", "license", "kind").agg(F.max("containment").alias("containment"))


OP3_SQL = f"""
WITH template(license, kind, text) AS (VALUES {", ".join("('" + "', '".join(x.replace("'", "''") for x in t) + "')" for t in TEMPLATES)}
), worded AS (
  SELECT license, kind, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM template
), known AS (
  SELECT license, kind, len(w) AS length, greatest(1, len(w) // 4) AS step, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM worded)
), counted AS (
  SELECT license, kind, count(DISTINCT shingle) AS n FROM known GROUP BY ALL
), docs AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents
), shingled AS (
  SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS shingle, len(w) - 4 AS total FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM docs)
), hits AS (
  SELECT DISTINCT doc_id, p, shingle, license, kind, length, step, total FROM shingled JOIN known USING (shingle)
), placed AS (
  SELECT *, unnest(range(greatest(0, (p - length + 5 - step) // step), p // step + 2)) * step AS start FROM hits
), counts AS (
  SELECT doc_id, license, kind, start, count(DISTINCT shingle) AS c FROM placed
  WHERE start < total AND p >= start - step AND p <= start + length + step - 5 GROUP BY ALL
)
SELECT doc_id, license, kind, max(c / n) AS containment FROM counts JOIN counted USING (license, kind) WHERE c / n >= 0.8 GROUP BY ALL
UNION ALL SELECT DISTINCT doc_id, license, 'spdx', 1::DOUBLE FROM (
  SELECT doc_id, unnest(regexp_extract_all(line, '{IDENTIFIER}')) AS license FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{SPDX}', 1)) AS line FROM documents)
) WHERE license NOT IN {JOINED}
"""


@query("op3_license_scan", OP3_SQL)
def op3_license_scan(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scan(docs).select(F.col("doc").alias("doc_id"), "license", "kind", "containment")

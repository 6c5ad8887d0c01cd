"""Licence scan: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Compared with the templates are a file's lines with a licence cue, its paragraphs of two lines or more with one (comment
marks are taken off first, so wrapped notices in source files count) and, if its name says that it is a licence file,
its whole text. The template nearest to any of them, at a cosine of `threshold` or more, is the file's own licence. A
directory's licence comes from the licence files in it: those named so, and those of which a licence statement is at
least `share` of the words. A file without a licence of its own takes that of its nearest ancestor directory that has one.

Templates are whole public licence texts, standard notices, short statements and a machine-readable line for each name.
The whole AGPL is taken as the GPL with its name changed, as they differ in one section only.

Terms are lower-case runs of letters, digits and inner dots; a term's weight is its count times ln((N + 1) /
(n + 0.5)), n of N templates having it. Ties go to the first name. Null and empty texts have no licence of their
own but inherit; a null path is outside any directory; a null row_id is a row like any other; repeated rows and rows that
share a row_id are judged each on its own; an empty table gives an empty result; other columns are not read. DataFrame
functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import read, stored

THRESHOLD = 0.6
SHARE = 0.2
#: A line with one of these, in lower case, may state a licence.
CUES = ("license", "licence", "copyright", "permission", "public domain", "redistribution", "cc by", "cc-by", "gpl")
NAMED = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)[^/]*$"
TERM = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
#: What opens a comment line.
MARK = r"^[ \t]*(?:/[*]+|[*]+/|[*]+|//+|#+|--+|;+|%+|<!--|>+)?[ \t]*"
TWO_LINES = r"[^\n \t][ \t]*\n[ \t]*[^\n \t]"
BREAK = "\x1e"  # stands between paragraphs

#: Short public licence statements and standard notices by SPDX name.
STATEMENTS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates_of(folder: Path = Path(__file__).with_name("licence_texts")) -> tuple[tuple[str, str], ...]:
    """(SPDX name, text) of all templates; the folder has a file of the whole text for each name."""
    whole = {p.stem: p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}
    whole["AGPL-3.0"] = re.sub(r"GNU GENERAL(?i:\s+public license)", lambda m: m[0].replace("GENERAL", "AFFERO GENERAL"), whole["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License"))
    names = sorted({*whole, *(name for name, _ in STATEMENTS)})
    return (*STATEMENTS, *((name, f"SPDX-License-Identifier: {name}") for name in names), *sorted(whole.items()))


TEMPLATES = templates_of()


def template_vectors(templates=TEMPLATES) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(template, term, unit weight), idf by term, idf of a term that no template has."""
    docs = [(f"{name}#{k}", Counter(re.findall(TERM, text.lower()))) for k, (name, text) in enumerate(templates)]
    n, having = len(docs), Counter(t for _, d in docs for t in d)
    idf = {t: math.log((n + 1) / (c + 0.5)) for t, c in sorted(having.items())}
    rows = []
    for key, terms in docs:
        w = {t: c * idf[t] for t, c in terms.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(key, t, x / norm) for t, x in sorted(w.items())]
    return rows, idf, math.log((n + 1) / 0.5)


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    found = low.contains(CUES[0])
    for cue in CUES[1:]:
        found = found | low.contains(cue)
    return found


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def directories(path: Column) -> Column:
    """All ancestor directories of a path, the top one first; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def units_of(path: Column, text: Column) -> Column:
    """The parts of a file that are compared with the templates."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, MARK, ""))
    joined = F.array_join(F.transform(bare, lambda x: F.when(F.lower(x).rlike("[a-z0-9]"), x).otherwise(F.lit(BREAK))), "\n")
    paragraphs = F.filter(F.split(joined, BREAK), lambda x: has_cue(x) & x.rlike(TWO_LINES))
    whole = F.when(path.rlike(NAMED), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(whole, F.filter(F.split(text, "\n"), has_cue), paragraphs)


def own_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """row_id, digest, total (terms of the text), licence, cosine, statement_terms for the files that state a licence.
    files: row_id, digest, path, text. Rows that repeat one are one here: they scale its counts, not its cosine."""
    vectors, idf, unknown = template_vectors(templates)
    spark, key = files.sparkSession, ("row_id", "digest", "line")
    # explode as a fence: what the units need is worked out for these files only, not in a filter over all
    some = files.where(has_cue(F.col("text")) | F.col("path").rlike(NAMED)).select("row_id", "digest", "path", F.explode(F.array("text")).alias("text"))
    units = some.select("row_id", "digest", F.size(terms_of(F.col("text"))).alias("total"), F.posexplode(units_of(F.col("path"), F.col("text"))).alias("line", "unit"))
    listed = units.select(*key, "total", terms_of(F.col("unit")).alias("all")).select(*key, "total", F.size("all").alias("terms"), "all")
    counts = listed.select(*key, "total", "terms", F.explode("all").alias("term")).groupBy(*key, "total", "terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = spark.createDataFrame(list(idf.items()), "term string, idf double")  # bounded by the templates
    weighed = counts.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    by_template = spark.createDataFrame(vectors, "template string, term string, tw double")
    packed = by_template.groupBy("term").agg(F.collect_list(F.struct("template", "tw")).alias("hits"))
    unit = weighed.join(F.broadcast(packed), "term", "left").select(*key, "total", "terms", "w", F.explode_outer("hits").alias("h"), F.get("hits", 0)["template"].alias("first"))
    once = F.col("h").isNull() | (F.col("h.template") == F.col("first"))
    norms = unit.groupBy(*key, "total", "terms").agg(F.sqrt(F.sum(F.when(once, F.col("w") * F.col("w")))).alias("norm"))
    dots = unit.where(F.col("h").isNotNull()).groupBy(*key, F.col("h.template").alias("template")).agg(F.sum(F.col("w") * F.col("h.tw")).alias("dot"))
    near = dots.join(norms, list(key)).select(*key, "total", "terms", F.element_at(F.split("template", "#"), 1).alias("licence"), F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("far"), "licence", (-F.col("terms")).alias("less")))
    return near.groupBy("row_id", "digest", "total").agg(best.alias("b")).select("row_id", "digest", "total", "b.licence", (-F.col("b.far")).alias("cosine"), (-F.col("b.less")).alias("statement_terms"))


def scan_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """One row per file: row_id, path, own_licence, cosine, licence, origin ('own', 'inherited' or null).
    files: row_id, path, text."""
    files = files.select(F.col("row_id").cast("long").alias("row_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    files = files.withColumn("digest", F.xxhash64("row_id", "path", "text"))
    numbered = files.withColumn("row_id", F.coalesce("row_id", F.lit(-1)))  # for the key only, with the digest
    own = stored(own_licences(numbered, templates, threshold)).withColumnRenamed("digest", "d")
    at = F.regexp_extract("path", r"^(.*)/", 1)
    judged = stored(files.select("row_id", "path", at.alias("dir"), "digest").join(own.withColumnRenamed("row_id", "r"), (F.col("digest") == F.col("d")) & (F.coalesce("row_id", F.lit(-1)) == F.col("r")), "left").drop("digest", "d", "r"))
    states = F.col("path").rlike(NAMED) | (F.col("statement_terms") >= share * F.col("total"))
    says = judged.where(F.col("licence").isNotNull() & F.col("path").isNotNull() & states).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("b")).select(F.col("dir").alias("above"), F.col("b.licence").alias("given"))
    places = judged.where(F.col("path").isNotNull()).select("dir").distinct().select("dir", F.explode(directories(F.concat("dir", F.lit("/x")))).alias("above"))
    heirs = stored(places.join(says, "above").groupBy("dir").agg(F.max_by("given", F.length("above")).alias("inherited")).withColumnRenamed("dir", "heir"))
    licence = F.coalesce("licence", "inherited")
    return judged.join(heirs, F.col("path").isNotNull() & (F.col("dir") == F.col("heir")), "left").select(
        "row_id", "path", F.col("licence").alias("own_licence"), "cosine", licence.alias("licence"), F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin")
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is the top directory, the language one in it, then one for 16 ids each, but the
    first of 16 stands in the language's own."""
    name, inner = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.when(F.col("doc_id") % 16 != 0, F.floor(F.col("doc_id") / 16).cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), inner, name)
    return docs.select(F.col("doc_id").alias("row_id"), path.alias("path"), "text")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(as_files(read(spark, sf_dir, "documents")))
    return found.withColumnRenamed("row_id", "doc_id")


def sql8(threshold: float = THRESHOLD, share: float = SHARE) -> str:
    vectors, idf, unknown = template_vectors()
    named = NAMED.replace("'", "''")
    cue = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{c}')" for c in CUES) + ")"
    return rf"""
WITH tv(template, term, tw) AS (VALUES {", ".join(f"('{a}', '{b}', {w!r}::DOUBLE)" for a, b, w in vectors)}),
iw(term, idf) AS (VALUES {", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items())}),
f AS (SELECT row_number() OVER () AS rid, doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CASE WHEN doc_id % 16 <> 0 THEN (doc_id // 16)::VARCHAR END, doc_id::VARCHAR || '.txt') AS path FROM documents),
b0 AS (SELECT rid, path, text, string_split(text, chr(10)) AS ls FROM f WHERE {cue('text')} OR regexp_matches(path, '{named}')),
b1 AS (SELECT *, array_to_string(list_transform(list_transform(ls, lambda x: regexp_replace(x, '{MARK}', '')), lambda x: CASE WHEN regexp_matches(lower(x), '[a-z0-9]') THEN x ELSE chr(30) END), chr(10)) AS joined FROM b0),
u0 AS (SELECT rid, unnest(list_concat(CASE WHEN regexp_matches(path, '{named}') THEN [text] ELSE []::VARCHAR[] END, list_filter(ls, lambda x: {cue('x')}), list_filter(string_split(joined, chr(30)), lambda x: {cue('x')} AND regexp_matches(x, '{TWO_LINES}')))) AS unit FROM b1),
u AS (SELECT row_number() OVER () AS line, * FROM u0),
c AS (SELECT rid, line, term, count(*) AS tf FROM (SELECT rid, line, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM u) GROUP BY ALL),
w AS (SELECT c.*, tf * coalesce(idf, {unknown!r}::DOUBLE) AS w FROM c LEFT JOIN iw USING (term)),
nm AS (SELECT line, sqrt(sum(w * w)) AS norm, sum(tf) AS terms FROM w GROUP BY line),
dt AS (SELECT rid, line, template, sum(w * tw) AS dot FROM w JOIN tv USING (term) GROUP BY ALL),
nr AS (SELECT rid, terms, string_split(template, '#')[1] AS licence, round(dot / norm, 6) AS cosine FROM dt JOIN nm USING (line) WHERE round(dot / norm, 6) >= {threshold}),
own AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, licence, terms DESC) = 1),
j AS (SELECT f.doc_id, path, regexp_extract(path, '^(.*)/', 1) AS dir, len(regexp_extract_all(lower(text), '{TERM}')) AS n, licence, cosine, terms FROM f LEFT JOIN own USING (rid)),
sy AS (SELECT dir, licence FROM j WHERE licence IS NOT NULL AND (regexp_matches(path, '{named}') OR terms >= {share} * n) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
h AS (SELECT d.dir, sy.licence AS inherited FROM (SELECT DISTINCT dir FROM j) d JOIN sy ON d.dir = sy.dir OR starts_with(d.dir, sy.dir || '/') OR sy.dir = '' QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(sy.dir) DESC) = 1)
SELECT doc_id, path, licence AS own_licence, cosine, coalesce(licence, inherited) AS licence, CASE WHEN licence IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' END AS origin FROM j LEFT JOIN h USING (dir)
"""

"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from directories.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.registry import query, table

#: Public notices by SPDX id, the usual wording of each: one-line notices, first lines of file headers
#: and of licence texts (as they are usually wrapped).  Fixed values.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD-style 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: The notices, and the tag line of each id.
TEMPLATES = (*NOTICES, *((i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in NOTICES} - {"LicenseRef-All-Rights-Reserved"})))
#: Base names of licence files, without their endings.
FILE_NAMES = ("license", "licence", "copying", "notice", "unlicense")
THRESHOLD = 0.85
#: Copies of each directory's row, to which the files of a directory are dealt.
SALTS = 32
_SPLIT = r"[^\\p{L}\\p{N}]+"
#: Stands for a unit itself among its words.
_UNIT = "\x01"


def _words(text: str) -> str:
    return f"filter(split(lower({text}), '{_SPLIT}'), w -> w <> '')"


def _units(files: DataFrame) -> DataFrame:
    """Lines of every file, and the whole text of a licence file as unit -1; ``row`` tells rows of one path apart."""
    name = F.regexp_extract(F.lower("path"), r"([^/.]+)(\.[^/]*)?$", 1)
    whole = F.coalesce(name.isin(*FILE_NAMES), F.lit(False))
    lines = F.transform(F.split("text", "\n"), lambda line, k: F.struct(k.alias("unit"), line.alias("line")))
    units = F.when(whole, F.concat(F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("line"))), lines)).otherwise(lines)
    return files.where("text IS NOT NULL").select("path", F.xxhash64("text").alias("row"), F.explode(units).alias("u")).select("path", "row", "u.*")


def find_notices(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Best template of each unit of ``files (path, text)``: ``path, unit, license, similarity``.

    A unit is a line, or the whole text of a licence file (unit -1).  Weights
    are counts times ``ln((1 + N) / (1 + df)) + 1``, with N the units that have
    words and df those that hold the word, over all files; words of no template
    weigh as if in no unit.  Only units whose other words leave the threshold in
    reach are compared, which loses none; those of the same words once.  Ties go
    to the first id.

    Texts are read twice and never shuffled: one pass counts the units of each
    known word, the other picks the few units whose known words weigh enough.
    """
    with scratch.temporary(files.sparkSession):
        return scratch.keep(_find_notices(files, templates, threshold), "notices")


def _find_notices(files: DataFrame, templates, threshold: float) -> DataFrame:
    spark = files.sparkSession
    given = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, notice string").select("template", "license", F.expr(_words("notice")).alias("words"))
    terms = given.select("template", "license", F.explode("words").alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("c"))
    known = sorted(r["term"] for r in terms.select("term").distinct().collect())  # bounded by the templates
    in_known = "IN (" + ", ".join("'" + t.replace("'", "''") + "'" for t in known or [_UNIT]) + ")"

    units = _units(files).withColumn("words", F.expr(_words("line"))).where("size(words) > 0")
    units = units.withColumn("hits", F.expr(f"array_sort(filter(words, w -> w {in_known}))"))
    marks = F.concat(F.array(F.lit(_UNIT)), F.array_distinct("hits"))
    # One row for each known word, from every task and in the end.
    df = {r["term"]: r["n"] for r in units.select(F.explode(marks).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = df.pop(_UNIT, 0)

    weight = spark.createDataFrame([(t, math.log((1 + number) / (1 + df.get(t, 0))) + 1) for t in known] or [("", 0.0)], "term string, idf double")
    unknown = math.log(1 + number) + 1
    weighed = terms.join(F.broadcast(weight), "term")
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("c") * F.col("idf"), 2))).alias("norm"))
    vectors = weighed.join(F.broadcast(norms), "template").select("template", "license", "term", (F.col("c") * F.col("idf") / F.col("norm")).alias("part"))

    # The weight of the known words bounds the cosine: a run of c equal words adds c squared times theirs.  Frequent words come first.
    squares = " ".join(f"WHEN '{t}' THEN {repr((math.log((1 + number) / (1 + df.get(t, 0))) + 1) ** 2)}D" for t in sorted(known, key=lambda t: (-df.get(t, 0), t))) or "WHEN '' THEN 0D"
    held = F.expr(f"aggregate(hits, struct('' AS w, 0L AS c, 0D AS s, 0D AS i), (a, w) -> CASE WHEN w = a.w THEN struct(w AS w, a.c + 1 AS c, a.s + (2 * a.c + 1) * a.i AS s, a.i AS i) ELSE struct(w AS w, 1L AS c, a.s + (CASE w {squares} ELSE 0D END) AS s, (CASE w {squares} ELSE 0D END) AS i) END, a -> a.s)")
    near = held * (1 + 1e-9) >= threshold * threshold / (1 - threshold * threshold) * unknown * unknown * (F.size("words") - F.size("hits"))
    # Units of the same words are compared once, however many there are; a digest stands for the words of whole files.
    same = F.sha2(F.concat_ws(" ", "words"), 256).alias("same")
    seen, _ = scratch.write(units.where((F.size("hits") > 0) & near).select("path", "row", "unit", same, "words"), "near")
    words = seen.groupBy("same").agg(F.first("words").alias("words")).select("same", F.explode("words").alias("term"))
    counts, _ = scratch.write(words.groupBy("same", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(weight), "term", "left"), "counts")
    lengths = counts.groupBy("same").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("idf", F.lit(unknown)), 2))).alias("length"))
    dots = counts.join(F.broadcast(vectors), "term").groupBy("same", "template", "license").agg(F.sum(F.col("n") * F.col("idf") * F.col("part")).alias("dot"))
    scored = dots.join(lengths, "same").withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("same").agg(F.min(F.struct(-F.col("similarity"), "license")).alias("b"))
    found = seen.select("path", "row", "unit", "same").dropDuplicates(["path", "row", "unit"]).join(best, "same")
    return found.select("path", "unit", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("similarity"))


def _parent(path: str) -> str:
    return f"CASE WHEN instr({path}, '/') > 0 THEN regexp_extract({path}, '^(.*)/[^/]*$', 1) ELSE '' END"


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """Give files without a licence that of the nearest directory above them.

    ``own (path, license)``: licences found; a licence file gives its directory
    its licence (the first path's, if it holds several).  Returns the columns of
    ``files (path, ...)`` with ``license`` and ``inherited_from`` (null if its
    own or none).  Directories are joined once each, and then salted, so the
    files of a large directory are dealt to many tasks.  Columns of ``files``
    that have the names of new ones are replaced.
    """
    added = ("license", "inherited_from")
    rest = [c for c in files.columns if c not in ("path", *added)]
    out = _inherit(files.select("path", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("rest")), own)
    return out.select("path", *(F.col("rest")[c].alias(c) for c in rest), *added)


def _inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.lower("path"), r"([^/.]+)(\.[^/]*)?$", 1)
    given = own.where(name.isin(*FILE_NAMES)).withColumn("directory", F.expr(_parent("path"))).groupBy("directory").agg(F.min(F.struct("path", "license"))["license"].alias("given"))
    placed = files.join(own, "path", "left").withColumn("_dir", F.expr(_parent("path")))
    directories = placed.where("license IS NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.expr("transform(sequence(0, size(_parts)), k -> CASE WHEN k = 0 THEN '' ELSE array_join(slice(_parts, 1, k), '/') END)")
    lines = directories.withColumn("_parts", parts).select("_dir", F.posexplode(above).alias("depth", "directory"))
    nearest = lines.join(given, "directory").groupBy("_dir").agg(F.max(F.struct("depth", "directory", "given")).alias("n")).select("_dir", "n.directory", "n.given")
    nearest, _ = scratch.write(nearest, "nearest")
    salted = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = placed.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["_dir", "_salt"], "left")
    out = dealt.withColumn("inherited_from", F.when(F.col("license").isNull() & F.col("given").isNotNull(), F.col("directory")))
    return out.withColumn("license", F.coalesce("license", "given")).drop("_dir", "_salt", "directory", "given")


def scan_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every row of ``files (path, text, ...)``, all columns but ``text`` kept.

    Adds ``own_license``, ``similarity`` (the file's best notice; the first line
    and id among equals), ``license`` and ``inherited_from``.  Rows that share a
    path are one file.  A null or empty text has no notice but inherits; a null
    path has neither; an empty table gives no rows; columns with the names of
    new ones are replaced.
    """
    notices = find_notices(files.where("path IS NOT NULL").select("path", F.col("text").cast("string").alias("text")), templates, threshold)
    best = notices.groupBy("path").agg(F.min(F.struct(-F.col("similarity"), "unit", "license")).alias("b"))
    own, _ = scratch.write(best.select("path", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("similarity")), "own")
    placed = inherit(files.drop("text", "own_license", "similarity"), own.select("path", "license"))
    mine = own.select("path", F.col("license").alias("own_license"), "similarity")
    return placed.join(mine, "path", "left")


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as the files ``source/lang/doc_id``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.col("doc_id").cast("string")).alias("path"), "text")


ORACLE = r"""
WITH templates AS (SELECT unnest([TEMPLATES], recursive := true)),
     tw AS (SELECT license, notice, unnest(regexp_extract_all(lower(notice), '[\p{L}\p{N}]+')) AS term FROM templates),
     tc AS (SELECT license, notice, term, count(*) AS c FROM tw GROUP BY ALL),
     files AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM documents),
     lines AS (SELECT doc_id, unit, words FROM (SELECT doc_id, unit, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS words FROM files) WHERE len(words) > 0),
     n AS (SELECT count(*) AS n FROM lines),
     wc AS (SELECT doc_id, unit, w, count(*) AS c FROM (SELECT doc_id, unit, unnest(words) AS w FROM lines) GROUP BY ALL),
     known AS (SELECT DISTINCT term FROM tc),
     df AS (SELECT w AS term, count(*) AS df FROM wc WHERE w IN (SELECT term FROM known) GROUP BY w),
     idf AS (SELECT term, ln((1 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM known LEFT JOIN df USING (term), n),
     lens AS (SELECT doc_id, unit, sqrt(sum(pow(c * coalesce(idf, ln(1.0 + n) + 1), 2))) AS length FROM wc LEFT JOIN idf ON w = term, n GROUP BY ALL),
     tn AS (SELECT license, notice, sqrt(sum(pow(c * idf, 2))) AS norm FROM tc JOIN idf USING (term) GROUP BY license, notice),
     dots AS (SELECT doc_id, unit, license, notice, sum(wc.c * idf * tc.c * idf) AS dot FROM wc JOIN idf ON w = term JOIN tc USING (term) GROUP BY ALL),
     scored AS (SELECT doc_id, unit, license, round(dot / length / norm, 6) AS similarity FROM dots JOIN lens USING (doc_id, unit) JOIN tn USING (license, notice)),
     own AS (SELECT doc_id, license, similarity FROM scored WHERE similarity >= 0.85 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, unit, license) = 1),
     placed AS (SELECT d.doc_id, coalesce(source, '-') AS s, coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, license, similarity FROM documents d LEFT JOIN own USING (doc_id)),
     by_dir AS (SELECT dir, arg_min(license, doc_id) AS given FROM placed WHERE license IS NOT NULL GROUP BY dir),
     by_source AS (SELECT s, arg_min(license, doc_id) AS given FROM placed WHERE license IS NOT NULL GROUP BY s)
SELECT doc_id, dir || '/' || doc_id AS path, coalesce(license, '') AS own_license, coalesce(similarity, 0) AS similarity,
       coalesce(license, d.given, p.given, '') AS license, CASE WHEN license IS NULL THEN CASE WHEN d.given IS NOT NULL THEN dir WHEN p.given IS NOT NULL THEN p.s END END AS inherited_from
FROM placed LEFT JOIN by_dir d USING (dir) LEFT JOIN by_source p USING (s)
""".replace("TEMPLATES", ", ".join("{'license': '%s', 'notice': '%s'}" % t for t in TEMPLATES))  # fmt: skip


@query("op1_license_scan", ORACLE.replace("END AS inherited_from", "END AS inherited").replace("SELECT doc_id, dir ||", "SELECT * EXCLUDE (inherited), coalesce(inherited, '') AS inherited_from FROM (SELECT doc_id, dir ||") + ")")
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document.

    The documents hold notices but no licence files, so each directory (and each
    source) is given one: the notice of its lowest-numbered document that has any.
    """
    files = document_files(table(spark, folder, "documents"))
    notices = find_notices(files.where("path IS NOT NULL").select("path", "text"))
    best = notices.groupBy("path").agg(F.min(F.struct(-F.col("similarity"), "unit", "license")).alias("b"))
    own, _ = scratch.write(best.select("path", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("similarity")), "own")
    numbered = own.withColumn("number", F.regexp_extract("path", r"([^/]*)$", 1).cast("long")).withColumn("directory", F.expr(_parent("path")))
    places = F.explode(F.array("directory", F.expr(_parent("directory"))))
    given = numbered.select(places.alias("at"), "number", "license").groupBy("at").agg(F.min(F.struct("number", "license"))["license"].alias("license"))
    added = given.select(F.concat("at", F.lit("/LICENSE")).alias("path"), "license")
    placed = inherit(files.drop("text"), own.select("path", "license").unionByName(added))
    mine = own.select("path", F.col("license").alias("own_license"), "similarity")
    out = placed.join(mine, "path", "left")
    return out.select("doc_id", "path", *(F.coalesce(c, F.lit("")).alias(c) for c in ("own_license", "license", "inherited_from")), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

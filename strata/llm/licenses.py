"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Every line of a file is compared with the templates as a vector of word counts
weighted by inverse document frequency, which is counted over all files for the
words of the templates and of all lines that are compared.  A
line can reach the threshold for a template only if it has one of the template's
heaviest words: without those the rest is too short a vector (Cauchy-Schwarz).
So lines without any such word are passed over, and no match is lost.

A file that declares nothing inherits the licence of its nearest ancestor
directory in which a licence file stands.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Least cosine of a declaration.
THRESHOLD = 0.6
#: Least cosine of a line that is a licence statement and little else.
STATEMENT = 0.9
#: Directories up to which their licences are sent to all tasks; beyond, the join shuffles.
BROADCAST_ROWS = 400_000

# Licence statements as they stand in headers and licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("Proprietary", "All rights reserved"),
]


def _plain_words(text: str) -> list[str]:
    return re.sub(r"\.+( |$)", " ", re.sub(r"[^a-z0-9.]+", " ", text.lower())).split()


def words(text: Column) -> Column:
    """Lower-case words of a-z and digits; points stay inside versions."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9.]+|\.+(?![a-z0-9.])"), "")


def _frequencies(files: DataFrame) -> DataFrame:
    """(word, files): in how many files each word stands."""
    # explode_outer: below explode Spark infers a filter that would take every text apart again
    held = files.select(F.explode_outer(F.array_distinct(words(F.coalesce("text", F.lit(""))))).alias("word"))
    return held.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("files"))


def _weights(counts: DataFrame, n: int, templates) -> dict[str, float]:
    """The inverse document frequency of each word of the templates among ``n`` files."""
    vocabulary = sorted({w for _, t in templates for w in _plain_words(t)})
    count = {r["word"]: r["files"] for r in counts.where(F.col("word").isin(vocabulary)).collect()}  # a row for each word of the templates at most
    return {w: math.log((n + 1) / (count.get(w, 0) + 1)) + 1 for w in vocabulary}


def vectors(templates, weight: dict[str, float]) -> list[dict[str, float]]:
    """The templates' unit vectors."""
    out = []
    for _, text in templates:
        own = _plain_words(text)
        v = {w: own.count(w) * weight[w] for w in own}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / size for w, x in v.items()})
    return out


def heavy(vs: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a line must have one to reach the threshold for any template."""
    out = set()
    for v in vs:
        rest = sum(x * x for x in v.values())
        for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if math.sqrt(max(rest, 0.0)) < threshold * 0.999:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def declared(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For each path and text (by its hash) that declares a licence: the best match, its line (from 0) and cosine.

    Ties go to the earlier line, then to the licence that sorts first.
    """
    spark = files.sparkSession
    scratch = Scratch(spark)
    counts, n = scratch.keep(_frequencies(files)), files.count()
    weight = _weights(counts, n, templates)
    vs = vectors(templates, weight)
    # lets through at least what has such a word: first whole texts, then lines
    needed = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in heavy(vs, threshold))})(?![a-z0-9])"
    lines = files.where(F.lower("text").rlike(needed))
    lines = lines.select("path", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split("text", "\n")).alias("line", "content"))
    lines = lines.where(F.lower("content").rlike(needed)).distinct()
    of = ["path", "text_hash", "line"]
    found = lines.select(*of, F.explode_outer(words(F.col("content"))).alias("word")).where(F.col("word").isNotNull()).groupBy(*of, "word").agg(F.count("*").alias("tf"))
    found = scratch.keep(found)
    met = scratch.keep(found.select("word").distinct())
    small = met.count() <= BROADCAST_ROWS
    sent = lambda df: F.broadcast(df) if small else df
    counts = counts.join(sent(met), "word", "left_semi")
    idf = sent(counts.select("word", (F.log((F.lit(n) + 1) / (F.col("files") + 1)) + 1).alias("idf")))
    dims = F.broadcast(spark.createDataFrame([(w, k, x) for k, v in enumerate(vs) for w, x in v.items()], "word string, template int, part double"))
    names = F.broadcast(spark.createDataFrame([(k, name) for k, (name, _) in enumerate(templates)], "template int, license string"))
    found = found.join(idf, "word").withColumn("x", F.col("tf") * F.col("idf"))
    size = found.groupBy(*of).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dot = found.join(dims, "word").groupBy(*of, "template").agg(F.sum(F.col("x") * F.col("part")).alias("dot"))
    a, b = dot.alias("a"), size.alias("b")
    same = F.col("a.path").eqNullSafe(F.col("b.path")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.line") == F.col("b.line"))
    close = a.join(b, same).select("a.path", "a.text_hash", "a.line", "template", F.round(F.col("dot") / F.col("size"), 6).alias("similarity")).where(F.col("similarity") >= threshold).join(names, "template")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "line", "license"))
    return close.groupBy("path", "text_hash").agg(best.alias("best")).select("path", "text_hash", F.col("best.license").alias("license"), F.col("best.line").alias("line"), (-F.col("best.s")).alias("similarity"))


def parent(path: Column) -> Column:
    """The directory of a path; the empty text for none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, licence_file: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of every row of ``files`` (path, text), its own or inherited.

    ``licence_file`` tells from path, line and similarity of a declaration
    whether the file speaks for its directory; by default files named LICENSE,
    LICENCE, COPYING, UNLICENSE or NOTICE do.  Of several in a directory the most
    similar counts, then the path that sorts first.  Null texts and texts without
    a declaration inherit; null paths have no directory and inherit nothing.
    Repeated rows are kept; other columns are not read.

    Returns path, text_hash, license, origin (own, inherited, none), directory
    (that the licence is inherited from) and similarity (of the own declaration).
    """
    scratch = Scratch(files.sparkSession)
    if licence_file is None:
        licence_file = F.col("path").rlike(r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$")
    own = scratch.keep(declared(files, templates, threshold))
    lead = F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license"))
    licensed = own.where(licence_file & F.col("path").isNotNull()).groupBy(parent(F.col("path")).alias("directory")).agg(lead.alias("lead")).select("directory", F.col("lead.license").alias("given"))
    # every directory of the files, with its ancestors from the root down; the empty text is the root
    parts = F.split("home", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    homes = files.where(F.col("path").isNotNull()).select(parent(F.col("path")).alias("home")).distinct()
    above = homes.select("home", F.posexplode(F.array_distinct(up)).alias("depth", "directory")).join(licensed, "directory")
    nearest = scratch.keep(above.groupBy("home").agg(F.max(F.struct("depth", "directory", "given")).alias("n")).select("home", F.col("n.directory").alias("directory"), F.col("n.given").alias("given")))
    small = nearest.count() <= BROADCAST_ROWS
    rows = files.select("path", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), parent(F.col("path")).alias("home"))
    rows = rows.join(F.broadcast(nearest) if small else nearest, "home", "left").alias("r")
    o = own.alias("o")
    out = rows.join(o, F.col("r.path").eqNullSafe(F.col("o.path")) & (F.col("r.text_hash") == F.col("o.text_hash")), "left")
    has = F.col("o.license").isNotNull()
    return out.select(
        "r.path", "r.text_hash", F.coalesce("o.license", "r.given").alias("license"),
        F.when(has, "own").when(F.col("r.given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("r.directory")).alias("directory"), F.col("o.similarity").alias("similarity"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files source/lang/doc_id; one with a line that is a licence statement and little else speaks for its directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    found = scan(docs.select(path.alias("path"), "text"), F.col("similarity") >= STATEMENT)
    return found.select(F.expr("try_cast(element_at(split(path, '/'), -1) AS bigint)").alias("doc_id"), "path", "license", "origin", "directory", "similarity")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_WORDS = "list_filter(string_split(regexp_replace(regexp_replace(lower({}), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' '), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH files AS (SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(doc_id::VARCHAR, '_') AS path,
               coalesce(source, '_') || '/' || coalesce(lang, '_') AS home, coalesce(source, '_') AS top, text FROM documents),
templates(k, license, text) AS (VALUES {", ".join(f"({k}, {_sql(n)}, {_sql(t)})" for k, (n, t) in enumerate(TEMPLATES))}),
tw AS (SELECT k, license, unnest({_SQL_WORDS.format("text")}) AS word FROM templates),
tf AS (SELECT k, license, word, count(*) AS n FROM tw GROUP BY ALL),
held AS (SELECT DISTINCT rowid_ AS r, word FROM (SELECT row_number() OVER () AS rowid_, unnest({_SQL_WORDS.format("text")}) AS word FROM files)),
df AS (SELECT word, count(*) AS n FROM held GROUP BY word),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT w.word, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS idf FROM (SELECT word FROM tf UNION SELECT word FROM df) w LEFT JOIN df USING (word), total),
tv AS (SELECT k, license, word, tf.n * idf AS x FROM tf JOIN idf USING (word)),
dims AS (SELECT k, license, word, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS part FROM tv),
lines AS (SELECT DISTINCT path, text, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM files),
lw AS (SELECT path, text, line, unnest({_SQL_WORDS.format("content")}) AS word FROM lines),
lx AS (SELECT path, text, line, word, count(*) * any_value(idf) AS x FROM lw JOIN idf USING (word) GROUP BY path, text, line, word),
size AS (SELECT path, text, line, sqrt(sum(x * x)) AS size FROM lx GROUP BY ALL),
dot AS (SELECT path, text, line, k, license, sum(x * part) AS dot FROM lx JOIN dims USING (word) GROUP BY ALL),
near AS (SELECT path, text, line, license, round(dot / size, 6) AS similarity FROM dot JOIN size USING (path, text, line) WHERE round(dot / size, 6) >= {THRESHOLD}),
own AS (SELECT path, text, license, line, similarity FROM near QUALIFY row_number() OVER (PARTITION BY path, text ORDER BY similarity DESC, line, license) = 1),
licensed AS (SELECT home AS directory, license AS given FROM own JOIN (SELECT DISTINCT path, home FROM files) USING (path) WHERE similarity >= {STATEMENT}
             QUALIFY row_number() OVER (PARTITION BY home ORDER BY similarity DESC, path, license) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, a.given, b.given) AS license,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN coalesce(a.given, b.given) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.license IS NULL THEN coalesce(a.directory, b.directory) END AS directory, o.similarity
FROM files f LEFT JOIN own o ON o.path = f.path AND o.text = f.text LEFT JOIN licensed a ON a.directory = f.home LEFT JOIN licensed b ON b.directory = f.top
"""

"""Licences of files: similarity of notices to templates, and inheritance by directory.

A notice is a line, paragraph or comment that names a licence, and for licence files
the whole text as well, whatever it says.  Notices and templates are sparse vectors
of word counts times inverse document frequency over the templates, a fixed list, so
that a notice has the same score in any number of files; words that no template has
count as the rarest.  The template with the largest cosine gives the licence if it
reaches ``MIN_COSINE``.  A file without a
notice of its own takes the licence of the nearest directory above it that has a
licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import licence_templates
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import HOT_ROWS, hottest, lookup_join

MIN_COSINE = 0.6

#: Lines with one of these are notices.
NOTICE = r"(?i)\b(licen[cs]e[ds]?|copyright|permission is hereby|public domain|creative commons|all rights reserved)\b"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)([.-][^/]*)?$"
WORD = r"[a-z]+|[0-9]+(?:[.][0-9]+)*"

#: Licence names and the words of their customary notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the person has waived all copyright: CC0 1.0 public domain dedication"),
    ("Proprietary", "Copyright, all rights reserved"),
]
RESERVED = "Proprietary"  # says no more than that rights are reserved, as other licences do as well

#: All that notices are compared with, and all that weights are taken from.
FIXED = [*TEMPLATES, (RESERVED, "All rights reserved"), *licence_templates.names(), *licence_templates.texts()]

COMMENT = r"^[ \t]*(#|//|/?[*]|--|;|%|<!--)"
#: Between blocks of lines: after the last or before the first line of comment, and at lines without letters and digits.
BLOCK_END = r"\x01\n(?!\x01)|(?<!\x01)\n(?=\x01)"
PARAGRAPH_END = BLOCK_END + r"|\n(?:[^\p{L}\p{N}\n]*\n)+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _fixed_weights(templates) -> tuple[list, list, float]:
    """``(word, idf)``, ``(word, [(template, license, weight)])`` of length 1, and the idf of all other words."""
    counts = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log(1 + len(counts) / n) for w, n in df.items()}
    of = {}
    for i, ((licence, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        for w, n in c.items():
            of.setdefault(w, []).append((i, licence, n * idf[w] / norm))
    return list(idf.items()), list(of.items()), math.log(1 + len(counts))


def _fixed_scores(units: DataFrame, templates, min_cosine: float) -> DataFrame:
    """``(unit, score, license)`` of the units that reach ``min_cosine`` by the templates' own weights."""
    spark = units.sparkSession
    idf, of, other = _fixed_weights(templates)
    idf = spark.createDataFrame(idf, "word string, idf double")
    of = spark.createDataFrame(of, "word string, of array<struct<template: int, license: string, w: double>>")
    words = units.select("unit", F.explode(_words(F.col("text"))).alias("word")).groupBy("unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    words = words.join(F.broadcast(idf.join(of, "word")), "word", "left")  # a fixed list
    weight = F.col("tf") * F.coalesce("idf", F.lit(other))
    # The entry without a template adds up to the square of the unit's own length.
    own = F.array(F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), (weight * weight).alias("x")))
    theirs = F.transform("of", lambda t: F.struct(t["template"].alias("template"), t["license"].alias("license"), (weight * t["w"]).alias("x")))
    dots = words.select("unit", F.explode(F.concat(own, F.coalesce(theirs, F.array().cast("array<struct<template: int, license: string, x: double>>")))).alias("e"))
    dots = dots.groupBy("unit", "e.template", "e.license").agg(F.sum("e.x").alias("x"))
    square = F.max(F.when(F.col("license").isNull(), F.col("x")))
    scored = dots.groupBy("unit").agg(F.sqrt(square).alias("norm"), F.collect_list(F.when(F.col("license").isNotNull(), F.struct("license", "x"))).alias("all"))
    scored = scored.select("unit", F.array_min(F.transform("all", lambda t: F.struct((-F.round(t["x"] / F.col("norm"), 6)).alias("less"), t["license"].alias("license")))).alias("b"))
    return scored.select("unit", (-F.col("b.less")).alias("score"), F.col("b.license").alias("license")).where(F.col("score") >= min_cosine)


def find_licenses(files: DataFrame, scratch: Scratch, min_cosine: float = MIN_COSINE, templates=FIXED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``files`` with ``license``, ``score``, ``origin`` and ``license_path``.

    ``files`` needs ``path`` and ``text``; columns of these four names are replaced, all others
    kept.  ``origin`` is ``own``, ``inherited`` or ``none``; the score is that of the notice
    relied on, 0 without one.  Null and empty texts have no notice; a file without a
    path has no directory and inherits nothing.  Equal scores go to the licence that
    is first by name, and among licence files of a directory to the first path.  A
    reservation of rights yields to any other licence.

    A notice is known by the MD5 of its text, so that the text of a long licence file is not
    repeated with each of its words.  Notices and directories of more than
    ``hot_rows`` files are joined in slices.
    """
    names = ["license", "score", "origin", "license_path"]
    files = files.drop(*names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = files.withColumn("__path", F.coalesce("path", F.lit(""))).withColumn("__text", F.xxhash64(text))
    none = F.array().cast("array<string>")
    split = F.split(text, "\n", -1)
    marked = F.array_join(F.transform(split, lambda x: F.when(x.rlike(COMMENT), F.concat(F.lit("\x01"), x, F.lit("\x01"))).otherwise(x)), "\n")
    parts = F.concat(split, F.split(marked, PARAGRAPH_END, -1), F.split(marked, BLOCK_END, -1))
    notices = F.when(text.rlike(NOTICE), F.filter(parts, lambda x: x.rlike(NOTICE))).otherwise(none)
    whole = F.when(F.col("__path").rlike(LICENCE_FILE), F.array(text)).otherwise(none)
    plain = F.transform(F.concat(notices, whole), lambda x: F.lower(F.trim(F.regexp_replace(x, "\x01", ""))))
    units = keyed.select("__path", "__text", F.explode(F.array_distinct(plain)).alias("text"))
    units = scratch.save(units.withColumn("unit", F.md5("text")), "notices")

    # Repeated rows show the same notice once.
    marks = scratch.save(units.select("__path", "__text", "unit").distinct(), "marks")
    best = _fixed_scores(units.select("unit", "text").dropDuplicates(["unit"]), templates, min_cosine)
    best = scratch.save(best, "best")
    hot = hottest(marks.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit", hot_rows)
    own = lookup_join(marks, "unit", best, "unit", hot, "__path").groupBy("__path", "__text")
    first = F.struct((F.col("license") == RESERVED).alias("yields"), (-F.col("score")).alias("less"), "license")
    own = own.agg(F.min(first).alias("b"))
    own = scratch.save(own.select("__path", "__text", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score")), "own")

    of_files = own.where(F.col("__path").rlike(LICENCE_FILE)).withColumn("above", _directory(F.col("__path")))
    of_files = of_files.groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("license"), F.col("__path"))).alias("b"))
    of_files = of_files.select("above", (-F.col("b.less")).alias("up_score"), F.col("b.license").alias("up_license"), F.col("b.__path").alias("up_path"))
    directories = keyed.where("path IS NOT NULL").groupBy(_directory(F.col("__path")).alias("__directory")).agg(F.count(F.lit(1)).alias("n"))
    directories = scratch.save(directories, "directories")
    parts = F.split("__directory", "/", -1)
    chain = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))
    up = directories.select("__directory", F.explode(F.array_distinct(chain)).alias("above")).join(of_files, "above")
    up = up.groupBy("__directory").agg(F.max_by(F.struct("up_score", "up_license", "up_path"), F.length("above")).alias("u"))

    out = keyed.withColumn("__directory", F.when(F.col("path").isNotNull(), _directory(F.col("__path"))))
    out = out.join(own, ["__path", "__text"], "left")
    out = lookup_join(out, "__directory", up.withColumnRenamed("__directory", "__up"), "__up", hottest(directories, "__directory", hot_rows), "__path", "left")
    has_own = F.col("license").isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in files.columns],
        F.coalesce("license", "u.up_license").alias("license"),
        F.coalesce("score", "u.up_score", F.lit(0.0)).alias("score"),
        F.when(has_own, "own").when(F.col("u.up_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has_own, F.col("path")).otherwise(F.col("u.up_path")).alias("license_path"),
    )

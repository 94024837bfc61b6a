"""License scans by TF-IDF similarity and directory inheritance, by DataFrame functions.

Every line of a text that carries a cue (a word that each template has one of) is a possible header, and a whole text is
a possible licence file. Both are sparse TF-IDF vectors of lower-cased words, the inverse frequencies being those of the
templates, with a word unknown to all templates weighing as the rarest; their cosines with the templates come from one
join on words. Templates are of three kinds with frequencies of their own: notices, which lines and texts are held
against, complete licence texts (texts only) and identifiers (lines only). A document's own licence is that of its best
line (``header``) or, if better, of the whole text (``file``), from ``least_header``, ``least_file`` or, for complete
texts, ``least_text`` on. A licence file speaks for its directory: a document without a licence of its
own takes that of the nearest directory above it that has one (``inherited``), found by joining its ancestors' paths.

Templates are a fixed table and broadcast. Only lines with cues are spread into words. Directories with several licence
files take the one of highest similarity, then of least name. Null and empty texts have no own licence; null paths have
no directory. Repeated rows are scanned alike, each of them. Very long texts are scanned in full: their lines one by one,
and as a whole by their distinct words. Of templates of equal similarity the first in order counts.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, row_key

# Short notices of common licences, as they stand in headers and licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "This work is licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License version 3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
)
#: Names that SPDX lines and licence fields give, by licence.
IDENTIFIERS = (
    *((x, x) for x in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "MIT", "MPL-2.0")),
    *((x, x + end) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for end in ("", "-only", "-or-later")),
)
NOTICE, WHOLE, NAME = 0, 1, 2


@cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """Complete licence texts: the files of the folder ``licenses``, named by licence."""
    return tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


def names() -> tuple[tuple[str, str], ...]:
    return tuple((x, before + name) for x, name in IDENTIFIERS for before in ("SPDX-License-Identifier: ", "License: "))


CUES = r"(?i)licen[cs]e|copyright|public domain|permission|redistribution|all rights reserved|\bcc0\b|spdx"


def terms(text: Column) -> Column:
    """Lower-cased words; dots and signs inside a word stay (4.0, by-nc)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def template_vectors(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, float]:
    """(t, license, term, weight: unit vectors), and the weight of a word that no template has."""
    from math import log

    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, text string")
    counts = rows.select("t", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("t", "license", "term").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("term").agg((F.log(F.lit(len(templates) + 1.0) / F.countDistinct("t")) + 1).alias("idf"))
    weighed = counts.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("t").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighed.join(norms, "t").select("t", "license", "term", "idf", (F.col("x") / F.col("norm")).alias("weight")), log(len(templates) + 1.0) + 1


def directory(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All directories above a path as structs (depth, dir), the top included."""
    parts = F.split(directory(path), "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), i)).alias("dir")))


def scan_licenses(documents: DataFrame, path: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, least_header: float = 0.75, least_file: float = 0.75, least_text: float = 0.9) -> DataFrame:
    """doc_id, path, license, how (header, file, inherited; null without licence), similarity, licensed_dir for every row of (doc_id, text).

    path: a column of slash-parted paths. similarity: of the licence's text, which for inherited ones is the licence file's.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), *row_key(), path.alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = [template_vectors(spark, x) for x in (templates, whole_texts(), names())]
    vectors = kinds[NOTICE][0].withColumn("of", F.lit(NOTICE))
    for of in (WHOLE, NAME):
        vectors = vectors.union(kinds[of][0].withColumn("t", F.col("t") + 10_000 * of).withColumn("of", F.lit(of)))
    vectors = F.broadcast(materialise(vectors, "templates"))  # of fixed size
    known = F.broadcast(vectors.select("of", "term", "idf").distinct())
    unknown = F.element_at(F.array(*(F.lit(x) for _, x in kinds)), F.col("of") + 1)

    cued = docs.where(F.col("text").rlike(CUES))
    lines = cued.select("k", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "passage")).where(F.col("passage").rlike(CUES)).distinct()
    whole = cued.select("k", "th", F.lit(-1).alias("line"), F.col("text").alias("passage")).distinct()
    # Lines and texts become word counts inside their row; a word occurs once in each unit from here on.
    counted = lines.union(whole).select("k", "th", "line", F.explode(terms(F.col("passage"))).alias("term")).groupBy("k", "th", "line", "term").agg(F.count("*").alias("tf"))
    against = F.when(F.col("line") < 0, F.array(F.lit(NOTICE), F.lit(WHOLE))).otherwise(F.array(F.lit(NOTICE), F.lit(NAME)))
    counted = counted.withColumn("of", F.explode(against))
    weighed = counted.join(known, ["of", "term"], "left").withColumn("x", F.col("tf") * F.coalesce("idf", unknown)).select("k", "th", "line", "of", "term", "x")
    weighed = materialise(weighed, "terms")
    norms = weighed.groupBy("k", "th", "line", "of").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(vectors, ["of", "term"]).groupBy("k", "th", "line", "of", "t", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, ["k", "th", "line", "of"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6))
    least = F.when(F.col("of") == WHOLE, F.lit(least_text)).when(F.col("line") < 0, F.lit(least_file)).otherwise(F.lit(least_header))
    near = near.where(F.col("similarity") >= least)
    order = F.struct("similarity", (F.col("line") < 0).alias("is_file"), (-F.col("line")).alias("early"), (-F.col("t")).alias("first"), "license")
    own = near.groupBy("k", "th").agg(F.max(order).alias("best"), F.max(F.col("line") < 0).alias("is_file"), F.max(F.when(F.col("line") < 0, F.struct("similarity", (-F.col("t")).alias("first"), "license"))).alias("as_file"))
    own = own.select("k", "th", F.col("best.license").alias("license"), F.col("best.similarity").alias("similarity"), F.when(F.col("best.is_file"), "file").otherwise("header").alias("how"), "is_file", "as_file")

    scanned = docs.drop("text").join(own, ["k", "th"], "left")
    scanned = materialise(scanned, "own")
    speaks = scanned.where("is_file and path is not null").groupBy(directory(F.col("path")).alias("dir"))
    speaks = speaks.agg(F.max(F.struct(F.col("as_file.similarity").alias("similarity"), F.col("as_file.first").alias("first"), F.col("as_file.license").alias("license"))).alias("of"))
    above = scanned.where("license is null and path is not null").select(directory(F.col("path")).alias("own_dir"), F.explode(ancestors(F.col("path"))).alias("a")).distinct()
    nearest = above.select("own_dir", "a.*").join(speaks, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "of")).alias("near"))
    out = scanned.withColumn("own_dir", directory(F.col("path"))).join(nearest, "own_dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path",
        F.coalesce("license", "near.of.license").alias("license"),
        F.when(has, F.col("how")).when(F.col("near").isNotNull(), "inherited").alias("how"),
        F.when(has, F.col("similarity")).otherwise(F.col("near.of.similarity")).alias("similarity"),
        F.when(~has, F.col("near.dir")).when(F.col("is_file"), F.col("own_dir")).alias("licensed_dir"),
    )

"""Licence scan: TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

A template of m words is compared with every window of m words of a text, across line ends, so that neither wrapping nor
neighbouring words change the verdict, and with each whole line, paragraph (lines between empty ones) and text of fewer
than m words. The cosine of their term vectors is weighted by inverse document frequency over all texts. Windows are
left out before the frequency of their other words is counted only where a bound says that they can't reach THRESHOLD:
such a word weighs 1 at least. SPDX tags are read as they are. A file's own licence is that of its best
window. Files named LICENSE, LICENCE, COPYING or NOTICE speak for their directory, the best of several by cosine; a file
without a licence of its own takes that of the nearest directory above it, by a join on the ancestors of its path.

Defined results: null and empty texts have no own licence and inherit. A null path has no ancestors. Ties go to the
licence that comes first by name. Rows are told apart by id, path and text together, so rows that share an id, or have
none, each keep their own licence; rows equal in all three get equal results. Texts are scanned whole, however long.
Empty tables give no rows. Columns beside id, path and text have no part in the scan, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, if_small, small_batches, table

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"

# Short notices of well-known licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0)."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Short names and titles of whole licence texts, which count only where all their words could stand.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
SPDX = re.compile(r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)", re.I)
# Words of the lines by which document_files names licence files.
ANCHORS = "license licensed licence licenced copyright redistribution permission cc0 gnu mozilla apache mit".split()


def terms(text: Column) -> Column:
    """Words of letters, digits and inner points."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\.(?![a-z0-9])", " "), r"[^a-z0-9.]+"), lambda w: w != "")


POINT, WORD = re.compile(r"\.(?![a-z0-9])"), re.compile(r"[a-z0-9.]+")


def words_of(text: str) -> list[str]:
    """`terms` in Python."""
    return WORD.findall(POINT.sub(" ", text.lower()))


class Matcher:
    """The windows of texts whose cosine to a template may reach THRESHOLD, whatever their other words weigh (1 at least)."""

    def __init__(self, idf: dict[str, float]):
        self.ids = {w: k for k, w in enumerate(sorted(idf))}
        self.square = np.array([idf[w] ** 2 for w in sorted(idf)] + [1.0])  # the last one is for other words
        self.templates = []
        for k, (name, notice) in enumerate(TEMPLATES + TITLES):
            found = words_of(notice)
            gain = np.zeros(len(self.square))
            for w, tf in Counter(found).items():
                gain[self.ids[w]] = tf * idf[w] ** 2
            norm = sum((tf * idf[w]) ** 2 for w, tf in Counter(found).items()) ** 0.5
            self.templates.append((name, len(found), gain / norm, k < len(TEMPLATES)))
        self.names = {name.lower(): name for name, _ in TEMPLATES}

    def needed(self, idf: dict[str, float]) -> list[str]:
        """Words of which each window at THRESHOLD holds one: what a template has besides them is below THRESHOLD of it."""
        out = set()
        for _, notice in TEMPLATES + TITLES:
            parts = sorted(((tf * idf[w]) ** 2, w) for w, tf in Counter(words_of(notice)).items())
            left, whole = 0.0, sum(x for x, _ in parts)
            for x, w in parts:
                left += x
                if left >= 0.99 * THRESHOLD**2 * whole:
                    out.add(w)
        return sorted(out)

    def find(self, texts: list[str | None]) -> Iterator[tuple]:
        """(text's place, line, licence, dot, square of the known words, other words, their counts) of each window."""
        words, line, owner, units = [], [], [], []
        for d, text in enumerate(texts):
            whole = paragraph = len(words)
            for k, one in enumerate((text or "").split("\n")):
                start, found = len(words), words_of(one)
                words += found
                line += [k] * len(found)
                if found:
                    units.append((start, len(words)))
                elif not one.strip():
                    units.append((paragraph, len(words)))
                    paragraph = len(words)
            owner += [d] * (len(words) - whole)
            units += [(paragraph, len(words)), (whole, len(words))]
            for m in SPDX.finditer(text or ""):
                tag = re.sub(r"(-only|-or-later|\+)$", "", m[1].rstrip("."), flags=re.I)
                yield d, text.count("\n", 0, m.start()), self.names.get(tag.lower(), tag), 1.0, 1.0, [], []
        if not words:
            return
        ids, owner = np.array([self.ids.get(w, -1) for w in words]), np.array(owner)
        spans = np.array(sorted({u for u in units if u[0] < u[1]}))
        weight = np.concatenate([[0.0], np.cumsum(self.square[ids])])
        for name, m, gain, short in self.templates:
            dots = np.concatenate([[0.0], np.cumsum(gain[ids])])
            at = np.arange(len(ids) - m + 1) if len(ids) >= m else np.zeros(0, int)
            at = at[owner[at] == owner[at + m - 1]]
            starts, ends = at, at + m
            if short:
                less = spans[spans[:, 1] - spans[:, 0] < m]
                starts, ends = np.concatenate([starts, less[:, 0]]), np.concatenate([ends, less[:, 1]])
            dot = dots[ends] - dots[starts]
            near = dot >= 0.999 * THRESHOLD * np.sqrt(weight[ends] - weight[starts])
            for i, j, x in zip(starts[near], ends[near], dot[near]):
                counts = Counter(words[i:j])
                known = sum(tf * tf * self.square[self.ids[w]] for w, tf in counts.items() if w in self.ids)
                other = {w: tf for w, tf in counts.items() if w not in self.ids}
                if x >= 0.999 * THRESHOLD * (known + sum(tf * tf for tf in other.values())) ** 0.5:
                    yield int(owner[i]), line[i], name, float(x), float(known), list(other), list(other.values())


def document_frequency(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df): in how many texts each wanted term stands; terms of no text are left out."""
    held = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return held.join(if_small(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def scan_lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, line, licence, similarity): the best template of the windows that begin in each line, where one reaches THRESHOLD."""
    spark = docs.sparkSession
    small_batches(spark)
    known = sorted({w for _, notice in TEMPLATES + TITLES for w in words_of(notice)})
    held = F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array(*map(F.lit, known)))
    counted = docs.select(F.explode_outer(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # A row for each template word: a fixed number.
    df = {r["term"]: r["df"] for r in counted.where("term is not null").collect()}
    idf = {w: float(np.log((n + 1.0) / (df.get(w, 0) + 1.0)) + 1.0) for w in known}
    matcher = Matcher(idf)
    telling = r"(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, matcher.needed(idf))) + r")(?![a-z0-9])|spdx-license-identifier"
    shared = spark.sparkContext.broadcast(matcher)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = list(batch[key])
            rows = [(keys[d], *rest) for d, *rest in shared.value.find(list(batch["text"]))]
            yield pd.DataFrame(rows, columns=[key, "line", "licence", "dot", "known", "others", "counts"])

    fields = [T.StructField(key, kind), *[T.StructField(c, t) for c, t in (("line", T.IntegerType()), ("licence", T.StringType()), ("dot", T.DoubleType()), ("known", T.DoubleType()), ("others", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.IntegerType())))]]
    near = docs.where(F.col("text").rlike(telling)).select(key, "text").mapInPandas(run, T.StructType(fields))
    near = cut(near.withColumn("window", F.monotonically_increasing_id()))
    others = near.select("window", F.explode(F.arrays_zip("others", "counts")).alias("o")).select("window", F.col("o.others").alias("term"), F.col("o.counts").alias("tf"))
    frequency = cut(document_frequency(docs, cut(others.select("term").distinct())))
    x = F.col("tf") * (F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0)
    rest = others.join(if_small(frequency), "term", "left").groupBy("window").agg(F.sum(x * x).alias("rest"))
    scored = near.join(rest, "window", "left").select(key, "line", "licence", F.round(F.col("dot") / F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0))), 6).alias("similarity"))
    scored = scored.where(F.col("similarity") >= THRESHOLD)
    return scored.groupBy(key, "line").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "licence")).alias("best")).select(key, "line", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("similarity"))


def scan(files: DataFrame) -> DataFrame:
    """files: (file_id, path, text). One row for each: its licence, where it comes from, and the cosine."""
    ident = F.md5(F.to_json(F.struct("file_id", "path", F.xxhash64("text").alias("text"))).cast("binary")).alias("row")
    files = files.select("file_id", "path", "text", ident)
    found = scan_lines(files, "row")
    own = cut(found.groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "licence")).alias("best")).select("row", F.col("best.licence").alias("own"), (-F.col("best.less")).alias("similarity")))
    parts = F.split("path", "/")
    placed = files.select("row", "file_id", "path", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("above"), F.element_at(parts, -1).alias("name")).join(if_small(own), "row", "left")
    folders = placed.where(F.col("own").isNotNull() & F.col("name").rlike(LICENCE_FILE)).select(F.array_join("above", "/").alias("folder"), "own", "similarity")
    folders = cut(folders.groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "own")).alias("best")).select("folder", F.col("best.own").alias("folder_licence")))
    bare = placed.where(F.col("own").isNull() & F.col("path").isNotNull()).select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("above")), lambda n: F.array_join(F.slice("above", F.lit(1), n), "/"))).alias("depth", "folder"))
    nearest = bare.join(if_small(folders), "folder").groupBy("row").agg(F.max(F.struct("depth", "folder", "folder_licence")).alias("near"))
    joined = placed.join(nearest, "row", "left")
    licence = F.coalesce("own", "near.folder_licence")
    how = F.when(F.col("own").isNotNull() & F.col("name").rlike(LICENCE_FILE), "file").when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return joined.select("file_id", "path", licence.alias("licence"), how.alias("origin"), F.col("near.folder").alias("from_folder"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: their source, then folders of a thousand and of ten ids.

    A document that opens or ends with a line that holds a licence word stands as the LICENSE file of its folder of a thousand.
    A null id or source is left out of the path: without an id a document is a file named like its source.
    """
    ident = F.col("doc_id").cast("string")
    lines = F.split("text", "\n")
    telling = r"(?i)\b(" + "|".join(ANCHORS) + r")\b"
    opens = F.element_at(lines, 1).rlike(telling) | F.element_at(lines, -1).rlike(telling)
    folder = F.concat_ws("/", F.col("source"), F.expr("cast(doc_id div 1000 as string)"))
    name = F.when(F.coalesce(opens, F.lit(False)), F.concat_ws("/", folder, F.concat(F.lit("LICENSE-"), ident))).otherwise(F.concat_ws("/", folder, F.expr("cast(doc_id div 10 as string)"), F.concat(ident, F.lit(".txt"))))
    return docs.select(F.col("doc_id").alias("file_id"), name.alias("path"), "text")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(document_files(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("file_id", "doc_id")

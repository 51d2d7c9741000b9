"""Licence scan: TF-IDF cosine of texts to licence templates, inherited down directories.

1. Templates are notices of a sentence and whole licence files.  Notices are
   compared with the lines of a file and with its passages: runs of as many
   terms as the notice has, over the whole text, so that comment marks, line
   ends and a paragraph around a notice do not matter.  Whole licence files
   are compared with whole texts.  Terms weigh their count times the inverse
   document frequency, counted over all files; terms that no template has
   weigh what a term in no file would weigh, so other wording lowers a cosine.
2. By the Cauchy-Schwarz inequality a text whose cosine to a template is
   ``LEAST`` or more shares one of its telling terms, namely those without
   which the rest of the template is shorter than ``LEAST``.  Lines and texts
   without any are left out, and so are passages whose dot product falls under
   ``LEAST`` even with the norm they would have if no term were repeated;
   nothing is lost.
3. The licence of a line, passage or text is the template of the largest cosine
   of ``LEAST`` or more.  A file's own licence is that of its whole text, or
   else of its best line or passage.  A file that as a whole is a licence file,
   most of whose words (``FILE_SHARE``) stand in licence lines or in licence
   passages (of overlapping ones the best), or that is named like one, is a
   licence file and covers its directory.
4. A file without a licence of its own takes that of the nearest ancestor
   directory with a licence file (of several the commonest licence there).
   Directories are resolved first, each joined with its ancestors by path;
   files then look up their directory.

Everything is a built-in function, an aggregate or a join.

Ties between licences go to the smaller name.  A null or empty text has no
licence of its own but inherits; a null path lies in the root directory "".
Repeated rows count as files each.  An empty table gives an empty result.
Only path, text and the kept columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import license_files
from quire.llm.common import stored, words

LEAST = 0.75
#: Share of a file's words in licence lines that makes it a licence file.
FILE_SHARE = 0.4

#: Names and standard notice lines of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Whole licence files, as their terms.
FILES = [(name, " ".join(f"{t} " * int(n) for t, n in (x.rsplit(":", 1) for x in counts.split())))
         for name, counts in license_files.COUNTS.items()]

#: A term: letters and digits, with points and hyphens inside (BY-NC, 4.0).
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Names of licence files.
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)([.-][^/]*)?$"


def terms(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def _term_list(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def document_frequencies(texts: DataFrame, rows=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of files and, for each template term, of files that have it (a number a term)."""
    vocabulary = sorted({t for _, text in rows for t in _term_list(text)})
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    held = texts.select(F.explode(F.array_append(F.array_intersect(terms(F.coalesce("text", F.lit(""))), known),
                                                 F.lit(""))).alias("term"))
    counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), {t: counts.get(t, 0) for t in vocabulary}


def weights(n_files: int, frequencies: dict[str, int]) -> dict[str, float]:
    """Inverse document frequency of each template term, and under "" of all others."""
    idf = lambda df: math.log((1 + n_files) / (1 + df)) + 1
    return {t: idf(df) for t, df in frequencies.items()} | {"": idf(0)}


def template_vectors(idf: dict[str, float], rows=TEMPLATES) -> list[tuple[int, str, str, float]]:
    """(template, licence, term, unit weight)."""
    out = []
    for i, (name, text) in enumerate(rows):
        raw = {t: n * idf[t] for t, n in Counter(_term_list(text)).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out += [(i, name, t, w / norm) for t, w in sorted(raw.items())]
    return out


def telling_terms(vectors: list[tuple[int, str, str, float]], least: float = LEAST) -> list[str]:
    """Terms of which a line within reach of a template has one at least."""
    telling = set()
    for i in {v[0] for v in vectors}:
        rest = sorted((w, t) for j, _, t, w in vectors if j == i)
        square = 0.0
        for w, t in rest:
            square += w * w
            if math.sqrt(square) >= least - 1e-9:
                telling.add(t)
    return sorted(telling)


def rare_terms(vectors: list[tuple[int, str, str, float]], idf: dict[str, float], least: float = LEAST) -> list[str]:
    """As telling_terms, but the commonest terms are the rest: for long templates full of common terms."""
    telling = set()
    for i in {v[0] for v in vectors}:
        square = 0.0
        for _, w, t in sorted((idf[t], w, t) for j, _, t, w in vectors if j == i):
            square += w * w
            if math.sqrt(square) >= least - 1e-9:
                telling.add(t)
    return sorted(telling)


def _literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    content = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(content), f"array<struct<{schema}>>")))


def license_lines(lines: DataFrame, idf: dict[str, float], vectors, least: float = LEAST,
                  key: tuple[str, ...] = ("line",)) -> DataFrame:
    """(key, license, cosine): those of the distinct ``lines(line)`` that are licence wording."""
    spark, key = lines.sparkSession, list(key)
    # both tables hold the templates' terms only
    by_term = F.broadcast(_literal_rows(spark, sorted((t, w) for t, w in idf.items() if t), "term string, idf double"))
    by_template = F.broadcast(_literal_rows(spark, vectors, "template int, license string, term string, weight double"))
    counts = lines.select(*key, F.explode(terms(F.col("line"))).alias("term")).groupBy(*key, "term").agg(
        F.count("*").alias("tf"))
    weighed = counts.join(by_term, "term", "left").select(
        *key, "term", (F.col("tf") * F.coalesce("idf", F.lit(idf[""]))).alias("w"))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(by_template, "term").groupBy(*key, "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    near = dots.join(norms, key).select(*key, "license", cosine.alias("cosine")).where(F.col("cosine") >= least)
    top = near.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("top"))
    return top.select(*key, "top.license", (-F.col("top.c")).alias("cosine"))


def near_passages(texts: DataFrame, idf: dict[str, float], vectors, rows=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(k1, k2, start, n, line): runs of ``n`` terms of ``texts(k1, k2, terms)`` that may be licence wording.

    Sums over a run are differences of running sums.  The sum of the squared
    weights is at most the squared norm, so no run within reach is left out.
    """
    sizes = [len(_term_list(text)) for _, text in rows]
    by_weight = {t: [0.0] * len(rows) for t in idf if t}
    for i, _, t, w in vectors:
        by_weight[t][i] = w * idf[t]
    by_term = F.broadcast(_literal_rows(texts.sparkSession, [(t, idf[t], w) for t, w in sorted(by_weight.items())],
                                        "term string, idf double, dots array<double>"))
    order = Window.partitionBy("k1", "k2").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.coalesce("idf", F.lit(idf[""]))
    summed = texts.select("k1", "k2", F.posexplode("terms").alias("pos", "term")).join(by_term, "term", "left").select(
        "k1", "k2", "pos", F.sum(weight * weight).over(upto).alias("squares"),
        *[F.sum(F.coalesce(F.get("dots", F.lit(i)), F.lit(0.0))).over(upto).alias(f"d{i}") for i in range(len(rows))])

    def over(name, n):
        return F.col(name) - F.lag(name, n, 0.0).over(order)

    # running sums are exact to far less than the room left here; the cosine is computed anew below
    near = [F.when(F.greatest(over(f"d{i}", n), F.lit(0.0)) + 1e-6 >= least * F.sqrt(F.greatest(over("squares", n), F.lit(0.0))),
                   F.lit(n)) for i, n in enumerate(sizes)]
    runs = summed.select("k1", "k2", "pos", F.array(*near).alias("near")) \
        .select("k1", "k2", "pos", F.explode(F.array_distinct(F.array_compact("near"))).alias("size")) \
        .select("k1", "k2", F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0)).alias("start"),
                F.least("size", F.col("pos") + 1).alias("n"))
    return runs.distinct().join(texts, ["k1", "k2"]).select(
        "k1", "k2", "start", "n", F.array_join(F.slice("terms", F.col("start") + 1, F.col("n")), " ").alias("line"))


def covered_terms(hits: DataFrame, longest: int) -> DataFrame:
    """(k1, k2, covered): terms in the runs of ``hits(k1, k2, start, n, cosine)`` that no better one overlaps."""
    by_text = Window.partitionBy("k1", "k2").orderBy("start")
    end = F.col("start") + F.col("n")
    beside = hits.withColumn("beside", F.collect_set(F.struct("start", "n", "cosine")).over(
        by_text.rangeBetween(-longest, longest)))
    best = beside.where(~F.exists("beside", lambda x: (x["cosine"] > F.col("cosine")) & (x["start"] < end)
                                  & (x["start"] + x["n"] > F.col("start"))))
    before = F.coalesce(F.max(end).over(
        by_text.orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.select("k1", "k2", F.greatest(F.lit(0), end - F.greatest("start", before)).alias("new")) \
        .groupBy("k1", "k2").agg(F.sum("new").alias("covered"))


def _has_term(telling: list[str]) -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in telling) + r")(?![a-z0-9])"


def candidate_lines(texts: DataFrame, telling: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and every ``line`` that has a telling term."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_has_term(telling)))
    return texts.select(*(keep or []), F.explode(lines).alias("line"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def inherit(files: DataFrame) -> DataFrame:
    """(directory, license, license_dir) for the directories of ``files(dir, own, is_license_file)``.

    The nearest ancestor (or the directory itself) with a licence file.
    """
    held = files.where("is_license_file").groupBy("dir", F.col("own").alias("license")).agg(F.count("*").alias("n"))
    licensed = held.groupBy(F.col("dir").alias("license_dir")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("x")).select("license_dir", "x.license")
    wanted = files.where("own is null").select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = wanted.select("dir", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))
        .otherwise(F.array().cast("array<string>")))).alias("license_dir"))
    return ancestors.join(licensed, "license_dir").groupBy("dir").agg(
        F.max_by(F.struct("license", "license_dir"), F.length("license_dir")).alias("x")).select("dir", "x.*")


def own_licenses(texts: DataFrame, rows=TEMPLATES, file_rows=FILES, least: float = LEAST,
                 file_share: float = FILE_SHARE) -> DataFrame:
    """(k1, k2, own, mostly) of the ``texts(k1, k2, text, n_words)`` that have a licence; rows that share a text count as one."""
    n_files, frequencies = document_frequencies(texts, [*rows, *file_rows])
    in_files = weights(n_files, frequencies)
    idf = {t: in_files[t] for _, text in rows for t in _term_list(text)} | {"": in_files[""]}
    vectors, file_vectors = template_vectors(idf, rows), template_vectors(in_files, file_rows)
    telling, rare = telling_terms(vectors, least), rare_terms(file_vectors, in_files, least)
    key = ["k1", "k2"]
    found = texts.select(*key, "text", "n_words", F.col("text").rlike(_has_term(telling)).alias("noticed"),
                         F.arrays_overlap(terms(F.col("text")), F.split(F.lit(" ".join(rare)), " ")).alias("long")) \
        .where("noticed or long").groupBy(*key).agg(*[F.first(c).alias(c) for c in ("text", "n_words", "noticed", "long")])
    found = stored(found, "candidates")
    noticed = found.where("noticed")

    lines = candidate_lines(noticed, telling, [*key, "n_words"]).distinct()
    named = license_lines(lines.select("line").distinct(), idf, vectors, least)
    by_line = lines.join(named, "line").groupBy(*key).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"),
        (F.sum(F.size(words(F.col("line")))) >= file_share * F.max("n_words")).alias("mostly"))

    runs = stored(near_passages(noticed.select(*key, terms(F.col("text")).alias("terms")), idf, vectors, rows, least), "runs")
    hits = stored(runs.join(license_lines(runs.select("line").distinct(), idf, vectors, least), "line").drop("line"), "hits")
    longest = max((len(_term_list(text)) for _, text in rows), default=1)
    by_run = hits.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")) \
        .join(covered_terms(hits, longest), key).join(noticed.select(*key, "n_words"), key) \
        .select(*key, "best", (F.col("covered") >= file_share * F.col("n_words")).alias("mostly"))

    whole = license_lines(found.where("long").select(*key, F.col("text").alias("line")), in_files, file_vectors, least,
                          tuple(key)).select(*key, F.struct((-F.col("cosine")).alias("c"), "license").alias("whole"))
    none = F.lit(None)
    parts = by_line.unionByName(by_run).withColumn("whole", none.cast(whole.schema["whole"].dataType)) \
        .unionByName(whole.withColumns({"best": none.cast(whole.schema["whole"].dataType), "mostly": F.lit(True)}))
    return parts.groupBy(*key).agg(F.min("best").alias("best"), F.min("whole").alias("whole"),
                                   F.max("mostly").alias("mostly")) \
        .select(*key, F.coalesce("whole.license", "best.license").alias("own"), "mostly")


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None,
         rows=TEMPLATES, file_rows=FILES, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """``keep`` columns (path by default), ``license``, ``origin`` (own, inherited or null) and ``license_dir``."""
    kept = [path_col] if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")]
    texts = files.select(*same, text.alias("text"), F.size(words(F.col(text_col))).alias("n_words"))
    own = own_licenses(texts, rows, file_rows, least, file_share)
    path = F.coalesce(F.col(path_col), F.lit(""))
    rows_of = files.select(*kept, *same, directory(path).alias("dir"),
                           F.regexp_replace(path, r"^.*/", "").rlike(FILE_NAME).alias("is_named"))
    mine = rows_of.join(own, ["k1", "k2"], "left").select(
        *kept, "dir", "own", (F.col("own").isNotNull() & (F.col("mostly") | F.col("is_named")))
        .alias("is_license_file"))
    mine = stored(mine, "own")
    # stored, so that the join shuffles both sides and a directory of many files can be split
    above = stored(inherit(mine.select("dir", "own", "is_license_file")), "inherited")
    joined = mine.join(above, "dir", "left")
    inherits = F.col("own").isNull() & F.col("license").isNotNull()
    return joined.select(
        *kept, F.coalesce("own", "license").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("license_dir")).alias("license_dir"))

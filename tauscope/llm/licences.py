"""License scans: normalised lines and texts against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauscope.llm.common import let

#: Notices by which public licences are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
)


def words(text: Column) -> Column:
    """Normalised words: lower case, runs of letters and digits, with version numbers in one piece."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*+"), F.lit(0))


def bigrams(w: Column) -> Column:
    """Distinct hashed bigrams of an array of words."""
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1))))


def templates(docs: DataFrame) -> DataFrame:
    rows = docs.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, licence string, notice string")
    return rows.select("template", "licence", let(words(F.col("notice")), bigrams).alias("_t")).withColumn("_tn", F.size("_t"))


def markers(notice: str, least: float) -> list[str]:
    """Longest words of a notice, so many that a part with none of them is not similar enough.

    A similar part has at least least / (2 - least) of the notice's bigrams; the words returned are in more than the rest of them.
    """
    w = re.findall(r"[^\W_]+(?:\.[0-9]+)*", notice.lower())
    left = set(zip(w, w[1:], strict=False))
    spare = len(left) - ceil(least / (2 - least) * len(left) - 1e-9)
    out = []
    while len(set(zip(w, w[1:], strict=False)) - left) <= spare:
        out.append(max((x for pair in left for x in pair), key=lambda x: (len(x), x)))
        left = {pair for pair in left if out[-1] not in pair}
    return out


def _any(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def windows(g: Column, least: float) -> Column:
    """Windows of the hashed bigrams ``g`` of a text that are similar to the template ``_t``: ``array<struct<start, end, dice>>``, end inclusive.

    The best windows start where a run of the template's bigrams starts and end where one ends, as a bigram more or less at either side lowers
    the coefficient; so these are all that are tried, up to twice the size bound in length.
    """
    low, high = least / (2 - least), (2 - least) / least
    longest = F.ceil(2 * high * F.col("_tn")).cast("int")

    def tried(hits: Column) -> Column:
        starts = F.filter(hits, lambda x, i: (i == 0) | (F.get(hits, i - 1) != x - 1))
        ends = F.filter(hits, lambda x, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1) != x + 1))

        def scored(start: Column, end: Column) -> Column:
            part = F.array_distinct(F.slice(g, start + 1, end - start + 1))
            return let(part, lambda p: F.struct(start.alias("start"), end.alias("end"), (2 * F.size(F.array_intersect(p, F.col("_t"))) / (F.size(p) + F.col("_tn"))).alias("dice")))

        def of(start: Column, k: Column, ends: Column) -> Column:
            near = F.filter(F.slice(ends, k + 1, longest), lambda e: (e - start < longest) & (e - start + 1 >= low * F.col("_tn")))
            return F.filter(F.transform(near, lambda e: scored(start, e)), lambda w: w["dice"] >= least)

        return let(ends, lambda e: F.flatten(F.transform(starts, lambda x, k: of(x, k, e))))

    hits = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(F.col("_t"), F.get(g, i)))
    return F.when(F.size(F.array_intersect(g, F.col("_t"))) >= low * F.col("_tn"), let(hits, tried))


def scan(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Licence notices of every document: ``doc_id, part, licence, template, dice``, one row per part of a text in which one is found.

    A part is a line, numbered from 0, the whole text, numbered -1, or a run of words within a line or over several,
    numbered as the line it starts in, so that a notice wrapped amid other text or within a longer line is found. A part is found if
    2 |A and B| / (|A| + |B|) of the distinct word bigrams is ``least`` or more; the best template counts, ties go to the first. Runs
    count where no line they touch and not the whole text is found; of runs that overlap the best counts. Two bounds follow and lose
    nothing: least / (2 - least) <= |A| / |B| <= (2 - least) / least, so a part meets only the templates
    of such sizes; and so much of a template must be there that one of a few of its words is, so
    texts and lines without any of these words are dropped before bigrams are made. The templates are a list of
    fixed length, so they are broadcast. Null and empty texts and documents
    without a notice give no rows, nor does an empty table; equal rows are reported once.
    """
    low, high = least / (2 - least), (2 - least) / least
    own = templates(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = sorted({m for _, notice in TEMPLATES for m in markers(notice, least)})
    rows = rows.where(_any(F.lower("text"), marks)).withColumn("_h", F.xxhash64("text"))
    lines = F.split("text", "\n")
    parts = F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("part"), x.alias("line"))), F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("part"), F.col("text").alias("line")))).otherwise(F.array().cast("array<struct<part:int,line:string>>")))
    met = rows.select("doc_id", "_h", F.inline(parts)).where(_any(F.lower("line"), marks))
    met = met.withColumn("_a", let(words(F.col("line")), bigrams)).withColumn("_an", F.size("_a"))
    met = met.where("_an > 0").join(F.broadcast(own), (F.col("_an") >= low * F.col("_tn")) & (F.col("_an") <= high * F.col("_tn")))
    met = met.withColumn("dice", 2 * F.size(F.array_intersect("_a", "_t")) / (F.col("_an") + F.col("_tn"))).where(F.col("dice") >= least)
    best = met.groupBy("doc_id", "_h", "part").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "licence")).alias("b"))
    whole, none = F.col("part") == -1, F.lit(-1)
    best = best.select("doc_id", "_h", _found(F.lit(0), F.col("b")["d"], F.col("b")["template"], F.col("b")["licence"], F.col("part"), F.when(whole, 0).otherwise(F.col("part")), F.when(whole, 2**31 - 1).otherwise(F.col("part")), none, none).alias("x"))

    placed = F.flatten(F.transform(lines, lambda x, i: F.transform(words(x), lambda y: F.struct(y.alias("w"), i.alias("line")))))
    runs = rows.withColumn("_w", placed).where("size(_w) > 1")
    runs = runs.select("doc_id", "_h", F.col("_w")["line"].alias("_line"), F.transform(F.slice("_w", F.lit(1), F.size("_w") - 1), lambda x, i: F.xxhash64(x["w"], F.get("_w", i + 1)["w"])).alias("_g"))
    runs = runs.crossJoin(F.broadcast(own)).withColumn("_x", windows(F.col("_g"), least)).where("size(_x) > 0").select("doc_id", "_h", "_line", "template", "licence", F.inline("_x"))
    first, last = F.get("_line", F.col("start")), F.get("_line", F.col("end") + 1)
    runs = runs.select("doc_id", "_h", _found(F.lit(1), -F.col("dice"), F.col("template"), F.col("licence"), first, first, last, F.col("start"), F.col("end") + 1).alias("x"))

    def meets(x: Column, y: Column) -> Column:
        of = lambda a, b: (x[a] <= y[b]) & (y[a] <= x[b])
        return F.when(y["kind"] == 0, of("l0", "l1")).otherwise(of("w0", "w1"))

    def step(kept: Column, x: Column) -> Column:
        return F.when((x["kind"] == 1) & F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.concat(kept, F.array(x)))

    every = best.unionByName(runs).groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set("x")).alias("x"))
    every = every.select("doc_id", F.explode(F.aggregate("x", F.slice("x", 1, 0), step)).alias("x"))
    return every.select("doc_id", F.col("x")["part"].alias("part"), F.col("x")["licence"].alias("licence"), F.col("x")["template"].alias("template"), (-F.col("x")["d"]).alias("dice")).distinct()


def _found(*values: Column) -> Column:
    kinds = {"kind": "int", "d": "double", "template": "int", "licence": "string", "part": "int", "l0": "int", "l1": "int", "w0": "int", "w1": "int"}
    return F.struct(*[F.coalesce(v.cast(k), F.lit("" if k == "string" else 0).cast(k)).alias(n) for v, (n, k) in zip(values, kinds.items(), strict=True)])

"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A template of T words is sought in windows of the smallest width W, a power of two, with
T <= W / 2 + 1, so templates may have any length from two words on; windows
start every W / 2 words, so each passage of that length lies wholly in one of them. A window's
bands are single minima under BANDS hash functions: with the Jaccard similarity J between window
and template at least SHARE * (T - 1) / (W - 1), some band agrees with a chance of at least
1 - (1 - J) ** BANDS (see collision()). Retrieved templates are verified on the shingles
themselves. Before that, documents and windows that hold none of a template's anchors are set
aside, without loss: a template has one more anchor than shingles that a match may lack. All of
it is DataFrame functions; nothing but the few matches is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import OUTER, let, lookup_join, materialise, one_line

BANDS = 24
#: With more anchors than this, documents are set aside by the hashes of their shingles instead of by plain text search.
MOST_SOUGHT = 200
#: Part of a template's shingles that a window must hold.
SHARE = 0.8

#: Fixed values: (license id, notice text) as these notices are usually written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("All-rights-reserved", "All rights reserved"),
]


def collision(words: int, share: float = SHARE, bands: int = BANDS) -> float:
    """The least chance that a window holding `share` of a template of so many words agrees in some band."""
    return 1 - (1 - share * (words - 1) / (width_of(words) - 1)) ** bands


def width_of(words: int) -> int:
    """The width of the windows in which a template of so many words (two at least) is sought."""
    w = 4
    while words > w // 2 + 1:
        w *= 2
    return w


def _tokens(text):
    """Lower-case words without outer punctuation; what is only punctuation is no word."""
    bare = F.regexp_replace(F.lower(text), OUTER, "")
    return F.split(one_line(bare), " ")


def _shingle_hashes(tokens):
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1)))


def _bands(hashes):
    low = lambda j: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(j))))
    return F.array(*[low(j) for j in range(BANDS)])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """tid, license, width, t_hashes, t_words, t_bands."""
    rows = [(i, lic, text) for i, (lic, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "tid int, license string, text string").withColumn("t_words", _tokens(F.col("text"))).where(F.size("t_words") >= 2)
    t = t.withColumn("t_hashes", _shingle_hashes(F.col("t_words"))).withColumn("t_bands", _bands(F.col("t_hashes")))
    n = F.size("t_words")
    width = F.coalesce(*[F.when(n <= w // 2 + 1, F.lit(w)) for w in (2**k for k in range(2, 31))])
    return t.select("tid", "license", width.alias("width"), "t_hashes", "t_words", "t_bands")


def anchors_of(hashes: list[int], words: list[str], share: float = SHARE) -> dict[int, tuple[str, str]]:
    """Shingles of which a window with `share` of the template must hold one: the longest, one more than may be missing."""
    named = {h: (words[i], words[i + 1]) for i, h in enumerate(hashes)}
    need = math.ceil(share * len(named) - 1e-9)
    order = sorted(named, key=lambda h: (-len(named[h][0]) - len(named[h][1]), h))
    return {h: named[h] for h in order[: len(named) - need + 1]}


def matches(docs: DataFrame, templates=TEMPLATES, share: float = SHARE) -> DataFrame:
    """doc_id, th (hash of the text), license, tid, width, first (word of the window) for each verified window."""
    spark = docs.sparkSession
    t = template_table(spark, templates)
    rows = t.select("t_hashes", "t_words", "width").collect()  # bounded by the template list
    least = {h: ab for r in rows for h, ab in anchors_of(r["t_hashes"], r["t_words"], share).items()}
    anchors = sorted(least)
    if not anchors:
        return spark.createDataFrame([], "doc_id long, th long, license string, tid int, width int, first int")
    widths = sorted({r["width"] for r in rows})
    def starts(width: int, n_words):
        step = width // 2
        n = F.greatest(F.ceil((n_words - F.lit(width)) / step).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.lit(width).alias("width"), (k * step).alias("first")))

    def windows(w, h):
        some = F.flatten(F.array(*[starts(width, F.size(w)) for width in widths]))
        full = F.transform(some, lambda c: F.struct(c["width"].alias("width"), c["first"].alias("first"), F.slice(w, c["first"] + 1, c["width"]).alias("w"), F.slice(h, c["first"] + 1, c["width"] - 1).alias("h")))
        return F.filter(full, lambda c: F.exists(c["h"], lambda x: x.isin(anchors)))  # no other can be verified

    def of(w):
        found = let(_shingle_hashes(w), lambda h: F.when(F.exists(h, lambda x: x.isin(anchors)), windows(w, h)))
        return F.when(F.size(w) >= 2, found)

    # the words of a shingle are parts of the text in lower case: most documents go no further
    sought = sorted(set(least.values()))
    near = let(F.lower("text"), lambda t: reduce(lambda x, y: x | y, [t.contains(a) & t.contains(b) for a, b in sought])) if len(sought) <= MOST_SOUGHT else F.lit(True)
    found = F.when(near, let(_tokens(F.col("text")), of))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.explode_outer(found).alias("c")).where("c is not null")
    d = d.select("doc_id", "th", "c.*").select("doc_id", "th", "width", "first", "w", F.posexplode(_bands(F.col("h"))).alias("band", "low"))
    bands = t.select("tid", "license", F.col("width").alias("w2"), "t_words", F.posexplode("t_bands").alias("band2", "low2"))
    # as many rows as templates times BANDS
    found = d.join(F.broadcast(bands), (F.col("width") == F.col("w2")) & (F.col("band") == F.col("band2")) & (F.col("low") == F.col("low2")))
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat_ws(" ", F.get(c, i), F.get(c, i + 1))))
    mine, its = pairs(F.col("w")), pairs(F.col("t_words"))
    found = found.where(F.size(F.array_intersect(mine, its)) >= share * F.size(its))
    return found.select("doc_id", "th", "license", "tid", "width", "first").distinct()


def scan(docs: DataFrame, templates=TEMPLATES, share: float = SHARE) -> DataFrame:
    """doc_id, licenses (sorted ids, maybe empty), n_windows (verified windows) for every row of docs (doc_id, text).

    Null, empty and texts under two words hold none; texts are read whole, however long; a text
    that holds several templates, or ties, has all their licenses; templates of less than two words
    are left out, and without any nothing is found; repeated rows get the same answer; an empty
    table gives an empty result; other columns are ignored.
    """
    m = matches(docs, templates, share).groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("h2"))
    m = m.agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.count_distinct("width", "first").alias("n_windows"), F.lit(1).alias("w"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    out = lookup_join(ids, materialise(m, "licenses"), [("doc_id", "d2"), ("th", "h2")], "w", F.col("doc_id"), ["licenses", "n_windows"])
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"))

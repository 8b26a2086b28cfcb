"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template of s shingles belongs to the class of the smallest power of two
c >= s; windows of that class hold 2c shingles and start every c, so any run of
s shingles lies whole in one window. A window that holds 0.8 of a template then
has a Jaccard similarity of at least 0.8s / (2c + 0.2s) > 0.19 with it, and
``bands_for`` picks the number of one-row bands at which a miss is rarer than
asked. A band can only collide where the window holds the very shingle that is
the template's minimum, so windows without such an anchor are never built.
A template under five words has one shingle, all its words, and windows of
shingles of that width.
Only DataFrame functions run on the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINED = 5, 0.8

#: Short notices by which public licenses ask to be named.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
}

#: Notices under ``SHINGLE`` words.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved."}


def bands_for(contained: float = CONTAINED, miss: float = 1e-4) -> int:
    """One-row bands at which a window that holds ``contained`` of a template goes unseen less often than ``miss``."""
    least = contained * 0.5 / (2 + 0.5 * (1 - contained))
    return math.ceil(math.log(miss) / math.log(1 - least))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, width: int = SHINGLE) -> Column:
    """A 64-bit hash for each ``width`` words in a row; none in shorter texts."""
    each = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - width), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(width)]))
    return _bound(w, lambda v: F.when(F.size(v) >= width, each(v)).otherwise(F.array().cast("array<bigint>")))


def _hashes_of(w: Column, width: Column, widths: list[int]) -> Column:
    """``shingle_hashes`` by the row's own width, one of ``widths``."""
    out = F.array().cast("array<bigint>")
    for k in widths:
        out = F.when(width == k, shingle_hashes(w, k)).otherwise(out)
    return out


def shingles(w: Column, width: Column) -> Column:
    """The distinct shingles themselves, for the exact check."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " ")))


def minima(hashes: Column, bands: int) -> Column:
    """MinHash of a window: for each band the least seeded hash, with the shingle that has it."""
    one = lambda j: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, j).alias("low"), h.alias("h"))))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), one(j).alias("m")))


def template_bands(spark: SparkSession, templates: dict[str, str], bands: int) -> DataFrame:
    """(license, shingles, width, span, band, low, anchor): a row per template and band."""
    t = spark.createDataFrame(sorted(templates.items()), "license string, body string").select("license", terms(F.col("body")).alias("w")).where(F.size("w") > 0)
    t = t.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    t = t.withColumns({"shingles": shingles(F.col("w"), F.col("width")), "hashes": _hashes_of(F.col("w"), F.col("width"), list(range(1, SHINGLE + 1)))})
    span = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int")
    t = t.select("license", "shingles", "width", span.alias("span"), F.explode(minima(F.col("hashes"), bands)).alias("b"))
    return t.select("license", "shingles", "width", "span", F.col("b.band").alias("band"), F.col("b.m.low").alias("low"), F.col("b.m.h").alias("anchor"))


def _starts(width: int, span: int, back: int) -> Column:
    own = F.filter("at", lambda a: a["width"] == width)
    return F.transform(own, lambda a: F.struct(F.lit(width).alias("width"), F.lit(span).alias("span"), ((F.floor(a["i"] / span).cast("int") - back) * span).alias("start")))


def license_scan(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", templates: dict[str, str] = TEMPLATES | SHORT_TEMPLATES, contained: float = CONTAINED, miss: float = 1e-4
) -> DataFrame:
    """One row per document and license found: ``id_col, license, containment, word_at``.

    ``containment`` is the largest share of the template's distinct shingles
    found in one window and ``word_at`` the first word (from 0) of the first
    such window. A template under five words is found where all its words stand
    in a row. Null and empty texts hold no license. Rows that share an id are
    one document; an empty table gives no rows; other columns are not read.
    Templates without words are ignored.
    """
    spark = df.sparkSession
    bands = bands_for(contained, miss)
    table = template_bands(spark, templates, bands)
    known = table.collect()  # templates times bands: fixed by the catalogue
    classes = sorted({(r["width"], r["span"]) for r in known})
    widths = sorted({w for w, _ in classes})
    anchors = {w: sorted({r["anchor"] for r in known if r["width"] == w}) for w in widths}
    table = spark.createDataFrame(known, table.schema)
    anchored = lambda v, w: F.filter(F.transform(shingle_hashes(v, w), lambda h, i: F.when(h.isin(anchors[w]), F.struct(F.lit(w).alias("width"), i.alias("i")))), lambda a: a.isNotNull())
    found = _bound(terms(F.col("body")), lambda v: F.concat(F.array().cast("array<struct<width:int,i:int>>"), *[anchored(v, w) for w in widths]))
    hit = df.select(F.col(id_col).alias("id"), F.col(text).alias("body")).withColumn("at", found).where(F.size("at") > 0)
    # The two windows of each class over every anchor; starts are multiples of the class's span.
    starts = [_starts(w, s, back) for w, s in classes for back in (0, 1)] or [F.array().cast("array<struct<width:int,span:int,start:int>>")]
    windows = F.array_distinct(F.filter(F.concat(*starts), lambda x: x["start"] >= 0))
    cut_out = lambda v: F.transform(F.col("wins"), lambda x: F.struct(x["width"].alias("width"), x["span"].alias("span"), x["start"].alias("start"), F.slice(v, x["start"] + 1, x["span"] * 2 + x["width"] - 1).alias("w")))
    wins = hit.select("id", "body", windows.alias("wins")).select("id", F.explode(_bound(terms(F.col("body")), cut_out)).alias("x")).select("id", "x.*")
    wins = wins.where(F.size("w") >= F.col("width"))
    hashes = _hashes_of(F.col("w"), F.col("width"), widths)
    banded = wins.select("id", "width", "span", "start", "w", F.explode(minima(hashes, bands)).alias("b")).select("id", "width", "span", "start", "w", "b.band", F.col("b.m.low").alias("low"))
    lookup = table.select(F.col("width").alias("t_width"), F.col("span").alias("t_span"), F.col("band").alias("t_band"), F.col("low").alias("t_low"), "license", "shingles")
    same = [F.col(c) == F.col(f"t_{c}") for c in ("width", "span", "band", "low")]
    pairs = banded.join(F.broadcast(lookup), same)
    share = F.size(F.array_intersect("shingles", shingles(F.col("w"), F.col("width")))) / F.size("shingles")
    exact = pairs.select("id", "license", "start", share.alias("containment")).where(F.col("containment") >= contained)
    best = exact.groupBy("id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("neg"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "license", F.col("b.containment").alias("containment"), (-F.col("b.neg")).alias("word_at"))

"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Only DataFrame functions.  A text becomes the hashes of its five-word shingles.
Templates are grouped by size into classes; the windows of a class are short
enough that every occurrence of a template of the class holds at least one whole
document window, whatever the offset.  Document windows overlap by half, templates
give a window at each place.  A window's signature is its least shingle hash under
each of ``seeds`` hash functions, each a band of its own: a window quoted exactly
collides always, one at a similarity of 0.6 with a probability of 0.97, and an
occurrence has several.  Retrieved templates are then compared shingle by shingle
at the place where they were met.

Everything up to the matches happens in the row: the few texts that share a band
with a template are filtered first, so nothing but matches is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import checked

#: Wordings of public licenses, by their usual identifiers.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
)


@dataclass(frozen=True)
class Scan:
    """``classes``: window sizes in shingles; a template takes the largest of which it holds one and a half."""

    width: int = 5
    classes: tuple[int, ...] = (1, 4, 16)
    seeds: int = 4
    containment: float = 0.8


def once(value: Column, function) -> Column:
    """``function`` of ``value``, which is then computed once a row, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def shingle_hashes(text: Column, s: Scan) -> Column:
    """Hashes of all shingles of ``width`` words; none for shorter texts and null."""

    def hashes(words: Column) -> Column:
        place = F.sequence(F.lit(0), F.greatest(F.size(words) - s.width, F.lit(0)))
        every = F.transform(place, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(s.width)]))
        return F.when(F.size(words) >= s.width, every).otherwise(F.array().cast("array<bigint>"))

    split = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return once(split, hashes)


def window_bands(hashes: Column, size: int, stride: int, s: Scan) -> Column:
    """(start, band) of all windows of ``size`` shingles; the last one ends with the text."""
    count = F.size(hashes)
    starts = F.sequence(F.lit(0), F.greatest(count - size, F.lit(0)), F.lit(stride))
    starts = F.array_distinct(F.concat(starts, F.array(F.greatest(count - size, F.lit(0)))))

    def signature(start: Column, window: Column) -> Column:
        least = lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(k))))
        return F.array(
            *[
                F.struct(start.cast("int").alias("start"), F.xxhash64(F.lit(size), F.lit(k), least(k)).alias("band"))
                for k in range(s.seeds if size > 1 else 1)
            ]
        )

    bands = lambda start: once(F.slice(hashes, start + 1, size), lambda window: signature(start, window))
    if size > 1 and 2 * stride == size:
        # a window is two neighbouring halves, and each half is in two windows: its minima are computed once
        final = F.greatest(count - size, F.lit(0))
        full = F.floor(final / stride).cast("int")

        def minima(part: Column) -> Column:
            own = lambda k: F.array_min(F.transform(part, lambda h: F.xxhash64(h, F.lit(k))))
            return F.array(*[own(k) for k in range(s.seeds)])

        halves = F.transform(
            F.sequence(F.lit(0), full + 1), lambda j: once(F.slice(hashes, j * stride + 1, stride), minima)
        )

        def joined(j: Column, every: Column) -> Column:
            # a half beyond a short text is empty and its minimum NULL, which ``least`` passes over
            least = lambda k: F.least(F.get(F.get(every, j), F.lit(k)), F.get(F.get(every, j + 1), F.lit(k)))
            return F.array(
                *[
                    F.struct((j * stride).cast("int").alias("start"), F.xxhash64(F.lit(size), F.lit(k), least(k)).alias("band"))
                    for k in range(s.seeds)
                ]
            )

        strided = once(halves, lambda every: F.flatten(F.transform(F.sequence(F.lit(0), full), lambda j: joined(j, every))))
        rest = F.when(final % stride != 0, bands(final)).otherwise(F.array().cast("array<struct<start:int,band:bigint>>"))
        every = F.concat(strided, rest)
    else:
        every = F.flatten(F.transform(starts, bands))
    return F.when(count > 0, every).otherwise(F.array().cast("array<struct<start:int,band:bigint>>"))


def templates_table(spark: SparkSession, templates, s: Scan) -> DataFrame:
    """(template, license, shingles, size class) of the templates that have a shingle."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string")
    table = table.select("template", "license", F.array_distinct(shingle_hashes(F.col("text"), s)).alias("shingles"))
    fit = F.lit(s.classes[0])
    for size in s.classes[1:]:
        fit = F.when(F.size("shingles") >= F.lit(size) + size // 2, size).otherwise(fit)
    return table.where(F.size("shingles") > 0).withColumn("class", fit)


def license_matches(docs: DataFrame, templates=TEMPLATES, s: Scan = Scan()) -> DataFrame:
    """(doc_id, license, template, start, containment): the best match of each template in each document.

    ``containment`` is the share of the template's different shingles among as many
    consecutive shingles of the text; ``start`` is the word where they begin, the
    first of equals.  Null, empty and short texts match nothing; rows of one doc_id
    count as one document; other columns are ignored.
    """
    spark = docs.sparkSession
    known = templates_table(spark, templates, s)
    sizes = sorted({r["class"] for r in known.select("class").distinct().collect()})
    places = []
    for size in sizes:
        every = known.where(F.col("class") == size)
        places.append(every.select("template", F.explode(window_bands(F.col("shingles"), size, 1, s)).alias("w")))
    marks = places[0] if places else known.select("template", F.lit(None).cast("struct<start:int,band:bigint>").alias("w"))
    for more in places[1:]:
        marks = marks.unionByName(more)
    marks = marks.select(F.col("w.band").alias("band"), "template").distinct()
    # a few bands for each word of the templates, which are an argument
    bands = sorted({r["band"] for r in marks.select("band").collect()})
    rows = checked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), shingle_hashes(F.col("text"), s).alias("hashes")
    )
    none = F.array().cast("array<struct<start:int,band:bigint>>")
    met = rows.withColumn(
        "windows",
        once(
            F.col("hashes"),
            lambda h: F.filter(
                F.concat(none, *[window_bands(h, k, max(1, k // 2), s) for k in sizes]), lambda w: w["band"].isin(bands)
            ),
        ),
    )
    # an inner explode would have the optimizer compute the windows again in filters of its own
    met = met.select("doc_id", "hashes", F.explode_outer("windows").alias("w")).where("w IS NOT NULL")
    met = met.select("doc_id", "hashes", "w.start", "w.band")
    # both are as large as the templates, an argument that the driver holds
    found = met.join(F.broadcast(marks), "band").join(F.broadcast(known), "template")
    size = F.size("shingles")
    # the template begins at most its own length before the window
    first = F.greatest(F.col("start") - size, F.lit(0))
    last = F.greatest(F.least(F.col("start"), F.size("hashes") - size), first)
    scores = F.transform(
        F.sequence(first, last),
        lambda i: F.struct(
            (F.size(F.array_intersect(F.slice("hashes", i + 1, size), "shingles")) / size).alias("containment"),
            (-i).alias("before"),
        ),
    )
    best = found.select("doc_id", "license", "template", F.array_max(scores).alias("best"))
    best = best.where(F.col("best.containment") >= s.containment)
    top = best.groupBy("doc_id", "license", "template").agg(F.max("best").alias("best"))
    return top.select(
        "doc_id", "license", "template", (-F.col("best.before")).cast("int").alias("start"),
        F.col("best.containment").alias("containment"),
    )

"""License notices found by MinHash bands over overlapping windows of text.

Templates are notices given as a parameter. A template of n shingles (five words
each) is looked for in windows of 2n shingles that start every n, so any place
where it stands lies whole inside one window. A window and a template meet when
one of 32 minima of hash functions agrees: bands of one row. A window with 0.8
of the template has a Jaccard similarity of at least 0.8 / 2.2, so it is missed
with a chance below (1 - 0.36)**32, one in a million. Windows so retrieved are
verified by their shingles: the share of the template's that they contain must
be 0.8 or more.

The windows are those of the SQL, so a notice interrupted by several words, which
is longer than what surely lies in one window, is found or missed depending on
where it starts.

Only windows with a pair of words that every 0.8 match must have go that far: for
each template, pairs of neighbouring words of which each of its shingles has
one. Texts are taken in blocks of 1024 shingles, so a very long one is many rows.
The template table, a row per template and band, is broadcast up to
``BROADCAST_TEMPLATES`` templates and joined by shuffle beyond.

Defined cases: null and empty texts match nothing; templates of fewer than five
words are one shingle of all their words and match only a text of just those
words; rows with equal ids count as one document; a null id is kept; empty tables
give no rows. Words are runs of a-z and 0-9 after lower-casing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmesh.llm.common import let, read_table, saved

# Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
    " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
    " version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
BLOCK = 1024
BROADCAST_TEMPLATES = 2000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def hashes_of(text: Column) -> Column:
    """Hashes of all shingles of a text, in order."""
    return let(words_of(text), shingle_hashes)


def shingle_hashes(words: Column) -> Column:
    at = lambda k: F.xxhash64(*[F.coalesce(F.get(words, k + j), F.lit("")) for j in range(SHINGLE)])
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), at)
    return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<bigint>"))


def anchored(words: Column, pairs: list[tuple[str, ...]]) -> Column:
    """For each word whether an anchor starts there."""
    known = [" ".join(p) for p in pairs]
    alone = [p[0] for p in pairs if len(p) == 1] or [""]
    return F.transform(words, lambda w, k: F.concat_ws(" ", w, F.get(words, k + 1)).isin(known) | w.isin(alone))


def anchors(templates: dict[str, str]) -> list[tuple[str, ...]]:
    """Word pairs such that every shingle of every template has one, of longer words if possible; words alone where there is no pair."""
    found: set[tuple[str, ...]] = set()
    for text in templates.values():
        words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
        left = [words[k : k + SHINGLE] for k in range(max(1, len(words) - SHINGLE + 1))] if words else []
        while left:
            held: dict[tuple[str, ...], int] = {}
            for s in left:
                for p in {tuple(s[k : k + 2]) for k in range(max(1, len(s) - 1))}:
                    held[p] = held.get(p, 0) + 1
            best = max(held, key=lambda p: (min(map(len, p)) > 3, max(map(len, p)) > 4, held[p], len("".join(p)), p))
            found.add(best)
            left = [s for s in left if best not in {tuple(s[k : k + 2]) for k in range(max(1, len(s) - 1))}]
    return sorted(found)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, size, shingles): the distinct shingle hashes of each template, and how many there are."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.select("license", F.array_distinct(hashes_of(F.col("text"))).alias("shingles"))
    return rows.where(F.size("shingles") > 0).withColumn("size", F.size("shingles"))


def band_hashes(shingles: Column) -> Column:
    """The array of shingles under each of the hash functions: an array of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.transform(shingles, lambda h: F.xxhash64(k, h)))


def blocks(docs: DataFrame, templates: dict[str, str], longest: int) -> DataFrame:
    """(doc_id, block, shingles, marks) of documents that may match; blocks overlap by what a window may need."""
    pairs = anchors(templates)
    pattern = "|".join("[^a-z0-9]+".join(p) for p in pairs)
    some = docs.select("doc_id", "text").where(F.lower("text").rlike(pattern) if pattern else F.lit(False))

    def cut(text: Column) -> Column:
        every, marks = text["shingles"], text["marks"]
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / BLOCK).cast("int")),
            lambda k: F.struct(
                k.alias("block"),
                F.slice(every, k * BLOCK + 1, BLOCK + 2 * longest).alias("shingles"),
                F.slice(marks, k * BLOCK + 1, BLOCK + 2 * longest + SHINGLE).alias("marks"),
            ),
        )

    both = let(words_of(F.col("text")), lambda w: F.struct(shingle_hashes(w).alias("shingles"), anchored(w, pairs).alias("marks")))
    return some.select("doc_id", F.inline(let(both, cut))).where(F.size("shingles") > 0)


def window_minima(cut: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, block, size, at, window, minima) of the windows with an anchor, for templates of the given sizes."""

    def windows(hashed: Column, size: int) -> Column:
        last = F.floor((F.least(F.size("shingles"), F.lit(BLOCK)) - 1) / size).cast("int")
        marked = lambda k: F.array_contains(F.slice("marks", k * size + 1, 2 * size + SHINGLE - 1), True)
        return F.transform(
            F.filter(F.sequence(F.lit(0), last), marked),
            lambda k: F.struct(
                F.lit(size).alias("size"),
                (k * size).alias("at"),
                F.slice("shingles", k * size + 1, 2 * size).alias("window"),
                F.transform(hashed, lambda h: F.array_min(F.slice(h, k * size + 1, 2 * size))).alias("minima"),
            ),
        )

    of_all_sizes = let(band_hashes(F.col("shingles")), lambda hashed: F.flatten(F.array(*[windows(hashed, n) for n in sizes])))
    return cut.select("doc_id", "block", F.inline(of_all_sizes))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_shingle, n_windows) of every document and template that match."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    sizes = [r["size"] for r in table.select("size").distinct().orderBy("size").collect()]
    bands = table.select(
        "license", "size", "shingles", F.posexplode(F.transform(band_hashes(F.col("shingles")), lambda h: F.array_min(h))).alias("band", "least")
    )
    if len(templates) <= BROADCAST_TEMPLATES:
        bands = F.broadcast(bands)
    if not sizes:
        return spark.createDataFrame([], "doc_id long, license string, containment double, first_shingle long, n_windows long")
    windows = window_minima(saved(blocks(docs, templates, max(sizes)), "blocks"), sizes)
    exploded = windows.select("doc_id", "block", "size", "at", "window", F.posexplode("minima").alias("band", "least"))
    met = exploded.join(bands, ["size", "band", "least"])
    share = F.size(F.array_intersect("window", "shingles")) / F.col("size")
    place = F.col("block").cast("long") * BLOCK + F.col("at")
    verified = met.select("doc_id", "license", place.alias("place"), share.alias("share")).where(F.col("share") >= CONTAINED)
    windows_met = verified.groupBy("doc_id", "license", "place").agg(F.max("share").alias("share"))
    return windows_met.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("place").alias("first_shingle"), F.count("*").alias("n_windows")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("containment", F.round("containment", 6))


_LITERALS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

SQL = f"""
WITH template AS (
  SELECT * FROM (VALUES {_LITERALS}) t(license, text)
), template_words AS (
  SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM template
), template_shingle AS (
  SELECT DISTINCT license, words[k:k + 4] AS s FROM (
    SELECT license, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM template_words)
), size AS (
  SELECT license, count(*) AS n FROM template_shingle GROUP BY license
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents
), doc_shingle AS (
  SELECT doc_id, words[k + 1:k + 5] AS s, k AS pos FROM (
    SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, 1))) AS k FROM doc_words WHERE len(words) > 0)
), hit AS (
  SELECT d.doc_id, t.license, z.n, d.s, d.pos // {BLOCK} AS block, d.pos % {BLOCK} AS pos
  FROM doc_shingle d JOIN template_shingle t USING (s) JOIN size z USING (license)
), placed AS (
  SELECT doc_id, license, n, s, block * {BLOCK} + (pos // n - j) * n AS place
  FROM hit, (SELECT unnest([0, 1]) AS j) WHERE pos // n - j >= 0
  UNION ALL
  SELECT doc_id, license, n, s, (block - 1) * {BLOCK} + (({BLOCK} - 1) // n - j) * n
  FROM hit, (SELECT unnest([0, 1]) AS j)
  WHERE block > 0 AND pos + {BLOCK} < (({BLOCK} - 1) // n - j) * n + 2 * n
), share AS (
  SELECT doc_id, license, place, count(DISTINCT s) / n AS share FROM placed GROUP BY doc_id, license, place, n
)
SELECT doc_id, license, round(max(share), 6) AS containment, CAST(min(place) AS BIGINT) AS first_shingle, count(*) AS n_windows
FROM share WHERE share >= {CONTAINED} GROUP BY doc_id, license
"""

"""License scans: MinHash bands over text windows retrieve license templates, exact shingle containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short public notices of well-known licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LGPL-text": "under the terms of the GNU Lesser General Public License",
    "AGPL-text": "under the terms of the GNU Affero General Public License",
    "CC0-1.0": "CC0 1.0 Universal",
    "CC0-text": "has waived all copyright and related or neighboring rights to",
    "All-rights-reserved": "All rights reserved.",
    "Proprietary": "Proprietary and confidential.",
    "Proprietary-text": "Unauthorized copying of this file, via any medium, is strictly prohibited",
}

SHINGLE = 5
#: A template is in a window if the window holds at least this share of its shingles, in percent.
CONTAINMENT = 75
#: Chance that the bands miss a window of the least similarity that can contain a template.
MISS = 1e-6


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, width: int) -> Column:
    return F.when(F.size(words) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda k: F.xxhash64(F.slice(words, k, F.lit(width)))))).otherwise(F.array().cast("array<bigint>"))


def n_bands(window_shingles: int, template_shingles: int, containment: int = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one row that a window of so many shingles needs, so that it meets a template that it contains but for `miss`.

    The least Jaccard similarity j then is that of the needed shingles against all of both, and each band meets with chance j.
    """
    needed = -(-containment * template_shingles // 100)
    j = needed / (window_shingles + template_shingles - needed)
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def _bands(shingles: Column, bands: int) -> Column:
    """The least hash of the set under each of `bands` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, seed))))


def key_words(templates: dict[str, list[str]], containment: int = CONTAINMENT) -> list[str]:
    """Words of which every window that contains a template has at least one.

    Words are taken until, in each template, those of its shingles that have none of them are fewer than containment
    asks for. Long words come first, as they are rarer in other texts.
    """
    taken: list[str] = []
    for words in templates.values():
        width = min(SHINGLE, len(words))
        shingles = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        needed = -(-containment * len(shingles) // 100)
        for word in sorted(set(words), key=lambda w: (w not in taken, -len(w), w)):
            if sum(not set(x) & set(taken) for x in shingles) < needed:
                break
            if word not in taken:
                taken.append(word)
    return sorted(taken)


def _template_words(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[str]]:
    rows = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", _words(F.col("text")).alias("w")).collect()
    return {r["license"]: r["w"] for r in rows if r["w"]}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: int = CONTAINMENT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, license, at, n_shared, n_template) for each template that a document contains.

    Words are letters and digits of any script, lower-cased. Windows are twice as long as the longest template of a
    length class and overlap by half, so a template lies in one whole. Shingles have SHINGLE words, for templates of fewer
    words as many as the template has, so that a short template is found inside a longer text. A window with too few of its shingles is no match
    even if the document has the rest elsewhere. A document names a template once, with its best window and, of equal
    ones, the first (`at` is the window's first word). Texts without any of key_words() cannot match and are not cut into
    windows. Null and empty texts match nothing; rows are judged one by one; repeated rows give repeated results only if
    their texts differ. The templates are a parameter of bounded size and meet each window in its own task.
    """
    spark = docs.sparkSession
    known = _template_words(spark, TEMPLATES if templates is None else templates)
    keys = key_words(known, containment)
    classes: dict[tuple[int, int], list[str]] = {}
    for name, words in known.items():
        classes.setdefault((1 << max(3, math.ceil(math.log2(len(words)))), min(SHINGLE, len(words))), []).append(name)
    docs = docs.select("doc_id", "text")
    likely = docs.where(F.rlike(F.lower(F.coalesce("text", F.lit(""))), F.lit("|".join(keys) or "(?!)"))).select("doc_id", F.xxhash64("text").alias("print"), _words(F.col("text")).alias("w"))
    found = None
    for (reach, width), names in sorted(classes.items()):
        own_keys = key_words({name: known[name] for name in names}, containment)
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(reach))
        windows = likely.where(F.size("w") > 0).select("doc_id", "print", F.explode(F.filter(_windows(starts, reach), lambda x: F.arrays_overlap(x["w"], F.array(*map(F.lit, own_keys))))).alias("x"))
        windows = windows.select("doc_id", "print", F.col("x.at").alias("at"), _shingles(F.col("x.w"), width).alias("own"))
        sizes = {name: len({tuple(known[name][k : k + width]) for k in range(len(known[name]) - width + 1)}) for name in names}
        bands = max(n_bands(2 * reach, size, containment) for size in sizes.values())
        rows = [(name, known[name]) for name in names]
        wanted = spark.createDataFrame(rows, "license string, w array<string>").select("license", _shingles(F.col("w"), width).alias("asked"))
        wanted_bands = wanted.select("license", "asked", F.posexplode(_bands(F.col("asked"), bands)).alias("band", "least"))
        met = windows.select("doc_id", "print", "at", "own", F.posexplode(_bands(F.col("own"), bands)).alias("band", "least")).join(F.broadcast(wanted_bands), ["band", "least"])
        verified = met.withColumn("n_shared", F.size(F.array_intersect("own", "asked"))).where(100 * F.col("n_shared") >= containment * F.size("asked"))
        verified = verified.select("doc_id", "print", "license", "at", "n_shared", F.size("asked").alias("n_template"))
        found = verified if found is None else found.union(verified)
    if found is None:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0).alias("at"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_template")).limit(0)
    best = found.groupBy("doc_id", "print", "license").agg(F.min(F.struct((-F.col("n_shared")).alias("k"), F.col("at"))).alias("b"), F.max("n_template").alias("n_template"))
    return best.select("doc_id", "license", F.col("b.at").cast("long").alias("at"), (-F.col("b.k")).cast("long").alias("n_shared"), F.col("n_template").cast("long").alias("n_template"))


def _windows(starts: Column, reach: int) -> Column:
    return F.transform(starts, lambda k: F.struct(k.alias("at"), F.slice("w", k + 1, 2 * reach).alias("w")))

"""Licence scans, in DataFrame functions only.

A text is cut into units: the whole text, its lines, and its sentences. A unit's normalised words
are its runs of letters and digits in lower case; its features are the distinct pairs of neighbouring
words. A unit names a licence when the Dice coefficient 2 |A and B| / (|A| + |B|) of its pairs and
a template's is at least ``dice``. That needs |A| between |B| dice / (2 - dice) and |B| (2 - dice) / dice,
so units of a size that fits no template are left before their pairs are made, and a unit meets
only templates of fitting size that share a pair with it.

A unit that names a template of b pairs has at least b dice / (2 - dice) of them, so it has one of any
b - b dice / (2 - dice) + 1. The longest pairs, seldom found in other text, are taken for that test, in
the row itself; only units that pass are spread into their pairs and grouped, and only texts with a telling pair are cut into units at all. The template table is
a fixed list of a few hundred pairs. No unit is cut short, whatever its length.

Notices also stand across line feeds, behind comment marks, or between other words of a line. For the
licences that none of a document's units names, its passages are compared: a passage of a template
of w words is a run of w words of the text, or of up to (2 - dice) / dice as many, that starts at a
pair of the template or holds the last w words. Of a template's passages that overlap, the best counts. Only
texts with enough pairs of a template, near enough to each other, are cut into passages, all in the row.
As a passage may stand anywhere, and half of a short template does so by chance ("licensed under the"),
a ``dice`` below 0.8 loosens the units only.

Rows: a null, empty or one-word text names nothing. Rows without doc_id are left out, rows that
repeat an id count as one document. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import settle

DICE = 0.8

# Notices as their licences word them
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def template_pairs(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, int, str]]:
    """(licence, template number, its size, pair)."""
    rows = []
    for licence, texts in templates.items():
        for text in texts:
            words = re.findall(r"[a-z0-9]+", text.lower())
            pairs = dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))
            number = len({r[1] for r in rows})
            rows += [(licence, number, len(pairs), p) for p in pairs]
    return rows


def _bounds(size, dice: float):
    """Sizes that can reach ``dice`` with a template of ``size`` pairs, a little wide against rounding."""
    return size * (dice / (2 - dice) - 1e-9), size * ((2 - dice) / dice + 1e-9)


def _telling(templates: list[tuple], dice: float) -> list[str]:
    """Pairs of which every unit that names a licence has at least one."""
    of: dict[int, list[str]] = {}
    for _, number, _, pair in templates:
        of.setdefault(number, []).append(pair)
    found = set()
    for pairs in of.values():
        least = math.ceil(len(pairs) * dice / (2 - dice) - 1e-9)
        found.update(sorted(pairs, key=lambda p: (-len(p), p))[: len(pairs) - least + 1])
    return sorted(found)


def _fits(size: Column, templates: list[tuple], dice: float) -> Column:
    """Whether some template's size lies within the bounds for ``size`` pairs."""
    sizes = sorted({r[2] for r in templates})
    ranges: list[list[float]] = []
    for s in sizes:
        low, high = _bounds(s, dice)
        if ranges and low <= ranges[-1][1] + 1:
            ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([low, high])
    fits = F.lit(False)
    for low, high in ranges:
        fits = fits | size.between(low, high)
    return fits


def _words(text: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _pairs(words: str) -> Column:
    """All pairs of neighbours in the array column ``words``, repeats too."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _once(value: Column) -> Column:
    """The value by way of a generator, so that later filters do not compute it again."""
    return F.explode(F.array(value))


def _template_structs(templates: dict[str, list[str]], dice: float) -> Column:
    """Per template: licence, pairs, the fewest common ones, and how many pairs (with repeats) a passage has at least and at most."""
    of: dict[int, tuple[str, list[str]]] = {}
    for licence, number, _, pair in template_pairs(templates):
        of.setdefault(number, (licence, []))[1].append(pair)
    shortest = [len(re.findall(r"[a-z0-9]+", text.lower())) - 1 for texts in templates.values() for text in texts]
    return F.array(*[
        F.struct(
            F.lit(licence).alias("licence"), F.array(*[F.lit(p) for p in pairs]).alias("pairs"),
            F.lit(math.ceil(len(pairs) * dice / (2 - dice) - 1e-9)).alias("least"),
            F.lit(p).alias("shortest"), F.lit(int(p * (2 - dice) / dice + 1e-9)).alias("longest"),
        ) for (licence, pairs), p in zip(of.values(), shortest)
    ])


def _best_run(start: Column) -> Column:
    """(start, stop, dice, unit): the passage at ``start`` with the greatest coefficient, the shortest of equal ones."""
    t = F.col("t")

    def scored(n: Column) -> Column:
        run = F.slice("pairs", start + 1, n)
        common = F.size(F.array_intersect(run, t["pairs"]))
        score = 2 * common / (F.size(F.array_distinct(run)) + F.size(t["pairs"]))
        return F.struct(score.alias("dice"), (-n).alias("less"))

    # a longer passage that ends with a pair the template has not is never better than a shorter one
    lengths = F.sequence(t["shortest"], F.least(t["longest"], F.size("pairs") - start))
    lengths = F.filter(lengths, lambda n: (n == t["shortest"]) | F.array_contains(t["pairs"], F.col("pairs")[start + n - 1]))
    # transform and filter bind the best as a variable
    return F.transform(F.array(F.array_max(F.transform(lengths, scored))), lambda best: F.struct(
        start.alias("start"), (start - best["less"]).alias("stop"), best["dice"].alias("dice"),
        F.array_join(F.slice("words", start + 1, 1 - best["less"]), " ").alias("unit"),
    ))[0]


def _best_of_overlapping(found: Column) -> Column:
    def add(kept: Column, run: Column) -> Column:
        last = F.element_at(kept, -1)
        better = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(run))
        apart = (F.size(kept) == 0) | (run["start"] >= F.try_element_at(kept, F.lit(-1))["stop"])
        return F.when(apart, F.concat(kept, F.array(run))).when(run["dice"] > last["dice"], better).otherwise(kept)

    return F.aggregate(found, F.slice(found, 1, 0), add)


def _possible(docs: DataFrame, dice: float, templates: dict[str, list[str]]) -> DataFrame:
    """doc_id and text of the rows that hold a telling pair: no other can name a licence.

    Every pair of a unit or a passage is a pair of the whole text. One search per text, before anything is split:
    the alternatives share their first word, and begin only where a word begins.
    """
    follow: dict[str, list[str]] = {}
    for pair in _telling(template_pairs(templates), dice):
        first, second = pair.split(" ")
        follow.setdefault(first, []).append(second)
    some = "|".join(f"{first}[^a-z0-9]+(?:{'|'.join(seconds)})" for first, seconds in follow.items())
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return texts.filter(F.lower("text").rlike(f"(?<![a-z0-9])(?:{some})(?![a-z0-9])"))


def licence_passages(docs: DataFrame, dice: float = DICE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, unit, licence, dice): the passages of ``docs(doc_id, text)`` that name a licence, as their words."""
    known = template_pairs(templates)
    every = F.array(*[F.lit(p) for p in dict.fromkeys(r[3] for r in known)])
    cut = _possible(docs, dice, templates).select("doc_id", _once(_words("text")).alias("words"))
    cut = cut.select("doc_id", "words", _once(_pairs("words")).alias("pairs"))
    cut = cut.filter(F.arrays_overlap("pairs", F.array(*[F.lit(p) for p in _telling(known, dice)])))
    cut = cut.select("doc_id", "words", "pairs", _once(F.array_intersect("pairs", every)).alias("met"))
    fits = F.filter(_template_structs(templates, dice), lambda t: (F.size("pairs") >= t["shortest"]) & (F.size(F.array_intersect("met", t["pairs"])) >= t["least"]))
    cut = cut.select("doc_id", "words", "pairs", F.explode(fits).alias("t"))
    t = F.col("t")
    hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains(t["pairs"], F.col("pairs")[i]))
    cut = cut.select("doc_id", "words", "pairs", "t", _once(hits).alias("hits"))
    at, last = F.col("hits"), F.size("pairs") - t["shortest"]
    near = F.filter(F.sequence(F.lit(0), F.size("hits") - t["least"]), lambda k: (at[k] <= last) & (at[k + t["least"] - 1] - at[k] < t["longest"]))
    starts = F.array_union(F.transform(near, lambda k: at[k]), F.array(last))
    cut = cut.select("doc_id", "words", "pairs", "t", _once(starts).alias("starts"))
    cut = cut.select("doc_id", "t.licence", _once(F.transform("starts", _best_run)).alias("runs"))
    cut = cut.select("doc_id", "licence", F.explode(_best_of_overlapping(F.filter("runs", lambda r: r["dice"] >= dice))).alias("r"))
    return cut.groupBy("doc_id", F.col("r.unit").alias("unit"), "licence").agg(F.max("r.dice").alias("dice"))


def licence_units(docs: DataFrame, dice: float = DICE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, unit, licence, dice): the units of ``docs(doc_id, text)`` that name a licence."""
    known = template_pairs(templates)
    table = docs.sparkSession.createDataFrame(known, "licence string, template int, size int, pair string")
    telling = _telling(known, dice)
    texts = _possible(docs, dice, templates)
    lines = F.split("text", "\n")
    sentences = F.split(F.regexp_replace("text", r"([.!?:])\s+", "$1\n"), "\n")
    units = texts.select("doc_id", F.explode(F.array_distinct(F.concat(F.array("text"), lines, sentences))).alias("unit"))
    # a unit of so many words has at most one pair less, and repeated pairs only make it smaller:
    # the upper bound is tested on the distinct pairs
    fewest = _bounds(min(r[2] for r in known), dice)[0]
    units = units.filter(F.length("unit") >= int(fewest) * 2 + 3)
    words = F.filter(F.split(F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    units = units.withColumn("words", words).filter(F.size("words") > fewest)
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words"), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    units = units.select("doc_id", "unit", pairs.alias("pairs")).withColumn("n", F.size("pairs")).filter(_fits(F.col("n"), known, dice))
    units = units.filter(F.arrays_overlap("pairs", F.array(*[F.lit(p) for p in telling])))
    met = units.select("doc_id", "unit", "n", F.explode("pairs").alias("pair")).join(table, "pair")
    met = met.filter(F.col("n").between(*_bounds(F.col("size"), dice))).distinct()
    counted = met.groupBy("doc_id", "unit", "licence", "template", "n", "size").agg(F.count("*").alias("common"))
    score = 2 * F.col("common") / (F.col("n") + F.col("size"))
    return counted.withColumn("score", score).filter(F.col("score") >= dice).groupBy("doc_id", "unit", "licence").agg(F.max("score").alias("dice"))


def scan(docs: DataFrame, dice: float = DICE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document and licence: doc_id, licence, dice (the best unit's), n_units (different ones).

    Passages stand for units where no unit names the licence.
    """
    # both ways read the few texts that are left, so the table itself is read once
    docs = settle(_possible(docs, dice, templates))
    found = licence_units(docs, dice, templates).withColumn("rank", F.lit(0))
    found = found.unionByName(licence_passages(docs, max(dice, DICE), templates).withColumn("rank", F.lit(1)))
    per = found.groupBy("doc_id", "licence", "rank").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))
    first = per.groupBy("doc_id", "licence").agg(F.min_by(F.struct("dice", "n_units"), "rank").alias("of"))
    return first.select("doc_id", "licence", "of.dice", "of.n_units")

"""Licence scans (operator 6); DataFrame functions only.

Method: each line, and each paragraph of more than one line, is normalised
(lower case, runs of other characters than letters and digits become one
space) and compared with licence templates by the Dice coefficient over sets of
word bigrams.  With threshold t a template of m bigrams can only match units of
between m * t / (2 - t) and m * (2 - t) / t bigrams, which bounds the units that
are looked at and the templates tried for each.

Licences inside longer lines, over several lines or as whole texts are found by
``windows``: word windows of each template's bounded size slide over the text.
Its templates are the notices and the texts in ``license_texts``; texts of more
than ``PIECE_WORDS`` * 3 words are cut into pieces, of which those count that
no other licence's text could match.  A window ends and begins with bigrams of
the template, as others only lower Dice; of overlapping windows of different
licences the one with the higher Dice counts.  A match has at least
m * t / (2 - t) of the template's bigrams, so texts with too few are left out
first: by words of which every match has one, then by bigrams.

Everything happens inside a row: no shuffle, and memory for one text at a time.

Defined cases: null and empty texts have no unit and no licence; units of one
word have no bigram and match nothing; among templates with the same best Dice
the first name wins; repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
from math import floor
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence notices and short licence texts.  Fixed values.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


#: More notices, for the windows only.
NOTICES = {
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "GPL-2.0": ["GNU General Public License version 2"],
    "GPL-3.0": ["GNU General Public License version 3"],
    "MIT": ["Licensed under the MIT License."],
}
TEXTS = Path(__file__).parent / "license_texts"
PIECE_WORDS = 100
#: Of this text only pieces with these words count, as sister licences, whose texts aren't here, share the rest.
MARKS = {"CC-BY-SA-4.0": ("sharealike", "adapter s license")}
#: Words that any prose has; the last choice for words that every match must have.
COMMON = frozenset("a an and any are as at be but by can for from has have if in is it its may not of on or other such that the their this these to under use used was were which will with work works you your".split())


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(m: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can match a template of ``m``."""
    return -floor(-(m * threshold / (2 - threshold) - 1e-9)), floor(m * (2 - threshold) / threshold + 1e-9)


def _best(unit: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """struct(dice, license) of the best template of a unit given as words; dice 0 if none matches."""
    grams = F.array_distinct(F.zip_with(F.slice(unit, 1, F.size(unit) - 1), F.slice(unit, 2, F.size(unit) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    def tried(g: Column, name: str, own: list[str]) -> Column:
        low, high = bounds(len(own), threshold)
        dice = F.lit(2.0) * F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / (F.size(g) + F.lit(float(len(own))))
        return F.struct(F.when(F.size(g).between(low, high), dice).otherwise(F.lit(0.0)).alias("dice"), F.lit(name).alias("license"))

    return F.element_at(
        F.transform(F.array(grams), lambda g: F.reduce(F.array(*[tried(g, *t) for t in templates]), F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))), 1
    )


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def window_templates(threshold: float = THRESHOLD) -> list[dict]:
    """The templates of ``windows`` in the order that decides ties: license, need (bigrams a match must have), high (most bigrams of a window), grams."""
    texts = {f.stem: words_of(f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))}
    wholes = {name: set(bigrams_of(" ".join(w))) for name, w in texts.items()}
    parts = [(name, words_of(t)) for source in (TEMPLATES, NOTICES) for name, all_of in source.items() for t in all_of]
    for name, w in texts.items():
        if len(w) <= 3 * PIECE_WORDS:
            parts.append((name, w))
            continue
        n = len(w) // PIECE_WORDS
        for piece in (w[len(w) * i // n : len(w) * (i + 1) // n] for i in range(n)):
            grams = set(bigrams_of(" ".join(piece)))
            alone = all(len(grams & whole) < bounds(len(grams), threshold)[0] for other, whole in wholes.items() if other != name)
            if alone and any(f" {m} " in f" {' '.join(piece)} " for m in MARKS.get(name, [piece[0]])):
                parts.append((name, piece))
    out = []
    for name, w in sorted(parts, key=lambda x: x[0]):
        grams = bigrams_of(" ".join(w))
        low, high = bounds(len(grams), threshold)
        out.append({"license": name, "need": low, "high": max(high, len(w) - 1), "grams": grams})
    return out


def key_words(grams: list[str], need: int) -> set[str]:
    """Words of which every text with ``need`` of ``grams`` has at least one: without them fewer are left."""
    left, keys = [g.split() for g in grams], set()
    for w in sorted({w for g in left for w in g}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) < need:
            break
        left = [g for g in left if w not in g]
        keys.add(w)
    return keys


def _windows(text: Column, templates: list[dict], threshold: float) -> Column:
    """array<struct<dice, license, unit>>: the best window of each licence, by licence."""
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    held = F.from_json(F.lit(json.dumps(templates)), "array<struct<license: string, need: int, high: int, grams: array<string>>>")
    keys = F.from_json(F.lit(json.dumps(sorted(set().union(*(key_words(t["grams"], t["need"]) for t in templates))))), "array<string>")
    every = F.from_json(F.lit(json.dumps(sorted({g for t in templates for g in t["grams"]}))), "array<string>")
    kind = "array<struct<dice: double, license: string, first: int, last: int>>"

    def of_template(t: Column, grams: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda p: F.array_contains(t["grams"], F.element_at(grams, p)))

        def of_start(ends: Column, p: Column) -> Column:
            def tried(q: Column) -> Column:
                own = F.slice(grams, p, q - p + 1)
                dice = F.lit(2.0) * F.size(F.array_intersect(own, t["grams"])) / (F.size(F.array_distinct(own)) + F.size(t["grams"])).cast("double")
                return F.struct(dice.alias("dice"), t["license"].alias("license"), p.alias("first"), q.alias("last"))

            near = F.filter(ends, lambda q: (q >= p + t["need"] - 1) & (q <= p + t["high"] - 1))
            return F.array_max(F.transform(near, tried))

        return F.filter(let(hits, lambda ends: F.transform(ends, lambda p: of_start(ends, p))), lambda x: x["dice"] >= threshold)

    def of_text(words: Column, grams: Column) -> Column:
        common = F.array_intersect(grams, every)
        near = let(common, lambda c: F.filter(held, lambda t: (F.size(c) >= t["need"]) & (F.size(F.array_intersect(t["grams"], c)) >= t["need"])))
        found = F.flatten(F.transform(near, lambda t: of_template(t, grams)))

        def best(all_of: Column) -> Column:
            over = lambda x, y: (y["license"] != x["license"]) & (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["license"] < x["license"])))
            kept = F.filter(all_of, lambda x: ~F.exists(all_of, lambda y: over(x, y)))
            names = F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["license"])))
            return F.transform(names, lambda n: F.array_max(F.filter(kept, lambda x: x["license"] == n)))

        shown = lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"), F.array_join(F.slice(words, x["first"], x["last"] - x["first"] + 2), " ").alias("unit"))
        return F.transform(let(F.coalesce(found, F.array().cast(kind)), best), shown)

    normal = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    none = F.array().cast("array<struct<dice: double, license: string, unit: string>>")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.coalesce(let(normal, lambda w: F.when((F.size(w) > 1) & F.arrays_overlap(w, keys), let(pairs(w), lambda g: of_text(w, g)))), none)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hits array<struct<dice, license, unit>>, windows likewise) for every row of ``docs``."""
    flat = [(name, grams) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts if (grams := bigrams_of(t))]
    fewest = min(bounds(len(g), threshold)[0] for _, g in flat) + 1
    # repeated bigrams count once, so a unit has no more bigrams than words - 1, but may have more words than its bigrams show
    normal = lambda u: F.trim(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " "))
    lines = F.split(F.col(text_col), "\n")
    paragraphs = F.filter(F.split(F.col(text_col), "\n[ \t\r]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    units = F.concat(F.coalesce(lines, F.array().cast("array<string>")), F.coalesce(paragraphs, F.array().cast("array<string>")))
    short = F.filter(F.transform(units, lambda u: F.struct(u.alias("unit"), F.split(normal(u), " ").alias("words"))), lambda s: F.size(s["words"]) >= fewest)
    # own templates are compared with windows too
    flat_windows = window_templates(threshold) if templates is None else [{"license": n, "need": bounds(len(g), threshold)[0], "high": bounds(len(g), threshold)[1], "grams": g} for n, g in flat]
    short = docs.select(F.col(id_col).alias("doc_id"), short.alias("units"), _windows(F.col(text_col), flat_windows, threshold).alias("windows"))
    most = max(bounds(len(g), threshold)[1] for _, g in flat)
    few = F.filter("units", lambda s: (F.size(s["words"]) <= most + 1) | (F.size(F.array_distinct(s["words"])) <= most + 1))
    best = F.transform(few, lambda s: F.struct(_best(s["words"], flat, threshold).alias("b"), s["unit"].alias("unit")))
    hits = F.filter(best, lambda x: x["b"]["dice"] >= threshold)
    return short.select("doc_id", F.transform(hits, lambda x: F.struct(x["b"]["dice"].alias("dice"), x["b"]["license"].alias("license"), x["unit"].alias("unit"))).alias("hits"), "windows")

"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Sentences, lines and the whole text are units; a unit is lower-cased and cut into runs of letters and digits, and its
pairs of neighbouring words, counted as often as they occur, are compared with each template's. With a and b pairs the coefficient is at most
2 min(a, b) / (a + b), so only units whose size lies within [t / (2 - t), (2 - t) / t] of a template's can reach the
threshold t; units out of bounds of all templates, or without any of the words that a match needs (``cues``), are dropped
before the comparison, and a text without such a word is done at once.

A notice may also lie inside other text: wrapped over lines, of several sentences, or in the middle of one. So passages of the
whole text's words, whatever their line feeds, are compared too: for each template all passages within its size bounds that begin and end
with one of its pairs (cutting other pairs off an end only raises the coefficient), where enough of its pairs stand
close together. Of passages of a template that overlap the best counts, of different templates the one with most common
pairs. A passage that lies in a unit that was found, or holds one that was found for the same template, is no new finding.
All work stays in the row: no shuffle, no Python.

Null and empty texts and units of fewer than two words match nothing; rows are scanned one by one, repeated ones each. Among
templates with an equal coefficient the first by name wins.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Usual wordings of licence notices.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                          "provided that the following conditions are met:",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation; either version 2 of the "
                      "License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the "
                      "License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                      "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                      "all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                      "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                      "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                      "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                      "furnished to do so, subject to the following conditions:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: Words of the templates that ordinary prose is full of; they make poor cues.
COMMON_WORDS = frozenset("a above all an and any as at be by can either fee file following for form free general in is "
                         "later may met must not of option or other permitted person public purpose rights so source "
                         "that the this to under use version with without work you".split())


def bigrams(text: str) -> list[str]:
    """A template's pairs of neighbouring words; the second of two equal pairs is numbered 2, and so on."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [f"{p} {pairs[:i + 1].count(p)}" for i, p in enumerate(pairs)]


def cues(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template has at least one.

    Such a unit has t / (2 - t) of the template's pairs or more, so it lacks none of a set that is larger than the rest
    allows. Words are added, long and uncommon ones that cover many pairs first, until each template has that many pairs with a word.
    """
    bags = [[tuple(p.split(" ")[:2]) for p in bigrams(wording)] for wording in templates.values()]
    missing = [int(len(bag) * (1 - threshold / (2 - threshold)) + 1e-9) + 1 for bag in bags]
    chosen: list[str] = []
    words = sorted({word for bag in bags for pair in bag for word in pair})

    def gain(word: str) -> tuple[float, str]:
        new = (sum(word in pair and not set(pair) & set(chosen) for pair in bag) for bag in bags)
        worth = 0.01 if word in COMMON_WORDS else 1.0
        return worth * len(word) ** 2 * sum(min(n, most) for n, most in zip(new, missing) if most > 0), word

    while any(n > 0 for n in missing):
        best = max(words, key=gain)
        for k, bag in enumerate(bags):
            missing[k] -= sum(best in pair and not set(pair) & set(chosen) for pair in bag)
        chosen.append(best)
    return sorted(chosen)


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _pairs(unit: Column) -> Column:
    """Pairs of neighbouring words of a normalised unit of two words or more."""
    return _let(F.split(unit, " "), lambda words: F.transform(
        F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))


def _numbered(pairs: Column) -> Column:
    """Equal pairs made different, as in ``bigrams``; only for the few units that have a needed word."""
    return F.transform(pairs, lambda p, i: F.concat(
        p, F.lit(" "), F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == p)).cast("string")))


def units(text: Column) -> Column:
    """Distinct normalised sentences, lines and whole text; words are separated by one space."""
    def normalised(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.trim(p))

    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([.!?])[ \t\r]+", "$1\f")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n\f]+", " ")
    lines = F.split(F.regexp_replace(plain, "\f ?", " "), "\n")
    sentences = F.split(plain, "[\n\f]")
    whole = F.array(F.regexp_replace(plain, "[ \n\f]+", " "))
    squeezed = F.transform(lines, lambda p: F.regexp_replace(p, "  +", " "))
    return F.array_distinct(normalised(F.concat(sentences, squeezed, whole)))


def _apart(found: Column) -> Column:
    """Passages in their order, without those that overlap an earlier one."""
    def overlaps(x: Column, y: Column) -> Column:
        return (x["first"] <= y["last"]) & (y["first"] <= x["last"])

    return F.aggregate(found, F.slice(found, 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def _passages(words: Column, bags: dict[str, list[str]], threshold: float) -> Column:
    """Array of (minus_common, minus, name, first, last) of passages of a text's words; first and last number its pairs."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    plain = {name: sorted({p.rpartition(" ")[0] for p in bag}) for name, bag in bags.items()}
    every = sorted({p for pairs in plain.values() for p in pairs})

    def of_template(name: str, marked: Column) -> Column:
        n = len(bags[name])
        least, most = math.ceil(n * low - 1e-9), math.floor(n * high + 1e-9)
        enough = max(1, math.ceil(threshold * (least + n) / 2 - 1e-9))

        def from_start(near: Column) -> Column:
            """The best passage that begins with the first of these pairs."""
            def scored(numbered: Column) -> Column:
                def score(x: Column, k: Column) -> Column:
                    common = F.size(F.filter(F.slice(numbered, F.lit(1), k + 1), lambda y: y.isin(bags[name])))
                    size = x["at"] - near[0]["at"] + 1
                    return F.struct((F.lit(-2.0) * common / (size + F.lit(n))).alias("minus"), (-common).alias("minus_common"),
                                    near[0]["at"].alias("first"), x["at"].alias("last"))

                return F.filter(F.transform(near, score), lambda x: (x["minus"] <= F.lit(-threshold))
                                & (x["last"] - x["first"] + 1 >= F.lit(least)))

            return F.array_min(_let(_numbered(F.transform(near, lambda x: x["pair"])), scored))

        def search(own: Column) -> Column:
            starts = F.filter(F.transform(own, lambda x, k: F.struct(x["at"].alias("at"), k.alias("k"))), lambda x:
                              F.get(own, x["k"] + F.lit(enough - 1))["at"] - x["at"] < F.lit(most))
            best = F.transform(starts, lambda s: _let(F.filter(
                F.slice(own, s["k"] + 1, F.lit(most)), lambda x: x["at"] - s["at"] < F.lit(most)), from_start))
            return F.transform(_let(F.array_sort(F.filter(best, lambda x: x.isNotNull())), _apart), lambda x: F.struct(
                x["minus_common"], x["minus"], F.lit(name).alias("name"), x["first"], x["last"]))

        return _let(F.filter(marked, lambda x: x["pair"].isin(plain[name])), search)

    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.struct(
        i.alias("at"), F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)).alias("pair")))
    return _let(F.filter(pairs, lambda x: x["pair"].isin(every)), lambda marked: _let(
        F.array_sort(F.concat(*(of_template(name, marked) for name in bags if bags[name]))), _apart))


def findings(text: Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (dice, name, unit) of the units and passages that reach the threshold, with the best template of each."""
    bags = {name: bigrams(wording) for name, wording in sorted(templates.items())}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    needed = cues(templates, threshold)

    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(needed) + r")(?![\p{L}\p{N}])"

    def has_cue(value: Column) -> Column:
        return value.rlike(pattern)

    def within(size: Column, n: int) -> Column:
        return (size >= F.lit(n * low - 1e-9)) & (size <= F.lit(n * high + 1e-9))

    def fits_any(unit: Column) -> Column:
        size = F.char_length(unit) - F.char_length(F.translate(unit, " ", ""))  # one pair for each space
        return reduce(or_, (within(size, n) for n in sorted({len(bag) for bag in bags.values()})))

    def minus_dice(pairs: Column, name: str) -> Column:
        own, n = F.array(*(F.lit(p) for p in bags[name])), len(bags[name])
        size = F.size(pairs)
        return F.when(within(size, n), F.lit(-2.0) * F.size(F.array_intersect(pairs, own)) / (size + F.lit(n)))

    def best(pairs: Column) -> Column:
        every = F.array(*(F.struct(minus_dice(pairs, name).alias("minus"), F.lit(name).alias("name")) for name in bags))
        return F.array_min(F.filter(every, lambda x: x["minus"] <= F.lit(-threshold)))

    def judged(unit: Column) -> Column:
        return F.struct(_let(_numbered(_pairs(unit)), best).alias("of"), unit.alias("unit"))

    candidates = F.filter(units(text), lambda unit: has_cue(unit) & fits_any(unit))
    found = F.filter(F.transform(candidates, judged), lambda x: x["of"].isNotNull())
    named = F.transform(found, lambda x: F.struct((-x["of"]["minus"]).alias("dice"), x["of"]["name"].alias("name"),
                                                  x["unit"].alias("unit")))
    nothing = F.array().cast("array<struct<dice:double,name:string,unit:string>>")

    def with_passages(known: Column, words: Column) -> Column:
        texts = F.transform(_passages(words, bags, threshold), lambda x: F.struct(
            (-x["minus"]).alias("dice"), x["name"].alias("name"),
            F.array_join(F.slice(words, x["first"] + 1, x["last"] - x["first"] + 2), " ").alias("unit")))

        def holds(long: Column, short: Column) -> Column:
            return F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))

        new = F.filter(texts, lambda x: ~F.exists(known, lambda u: holds(u["unit"], x["unit"])
                                                  | ((u["name"] == x["name"]) & holds(x["unit"], u["unit"]))))
        return F.array_distinct(F.concat(known, new))

    whole = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    every = _let(named, lambda known: _let(F.split(whole, " "), lambda words: with_passages(known, words)))
    return F.when(has_cue(F.lower(F.coalesce(text, F.lit("")))), every).otherwise(nothing)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, findings) of every row."""
    return docs.select(F.col(id_column).alias("doc_id"), findings(F.col(text_column), templates, threshold).alias("findings"))

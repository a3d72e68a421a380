"""Licence scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions only.

A unit is a line of a text, or (line -1) the text as a whole, or else, for notices that
are wrapped or stand within a line, a window of consecutive words outside those hits
(under the line of its first word). It is normalised to
lower-case ASCII words, and its distinct bigrams A are compared with the bigrams B of
a template: 2|A n B| / (|A| + |B|) of at least DICE is a hit. Two exact bounds prune:
|A| must lie between |B| * DICE / (2 - DICE) and |B| * (2 - DICE) / DICE, and as a hit
misses at most |B| * (2 - 2 * DICE) / (2 - DICE) of a template's bigrams, it holds at
least one of a few words or bigrams that touch more of them (`gate_terms`). All happens within a
row: no shuffle, no join.

Defined results: a null or empty text has no hits; of equal coefficients the longer
template, then the earlier one, then the earlier line stands; repeated rows give
repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Licence notices and short licence texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    return re.sub("[^A-Za-z0-9]+", " ", text).lower().split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:]))))


def gate_terms(threshold: float = DICE, templates=TEMPLATES) -> tuple[list[str], list[tuple[str, str]]]:
    """Words, and bigrams, of which every hit has at least one: for each template they touch more bigrams than a hit can miss.

    Words of five letters or more serve first, those that are in use already, then long
    ones; where they are too few, bigrams serve as a whole, as short words are common.
    """
    words: set[str] = set()
    pairs: set[tuple[str, str]] = set()
    for _, text in templates:
        bigrams = [tuple(b.split()) for b in bigrams_of(text)]
        may_miss, touched = len(bigrams) * (2 - 2 * threshold) / (2 - threshold), set()
        for word in sorted({w for w in words_of(text) if len(w) > 4}, key=lambda w: (not any(v in w for v in words), w == "under", -len(w), w)):
            if len(touched) > may_miss + 1e-9:
                break
            touched |= {b for b in bigrams if word in b}
            words.add(word)
        for b in bigrams:
            if len(touched) > may_miss + 1e-9:
                break
            if b not in touched:
                touched.add(b)
                pairs.add(b)
    return sorted(w for w in words if not any(v != w and v in w for v in words)), sorted(pairs)  # a contained word finds both


def _gate(text: Column, threshold: float, templates) -> Column:
    low = F.lower(text)
    words, pairs = gate_terms(threshold, templates)
    test = F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    if pairs:
        test = test | low.rlike("|".join(f"{a}[^a-z0-9]+{b}" for a, b in pairs))
    return test


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def _bigrams(text: Column) -> Column:
    words = _words(text)
    # Each word with the next one.
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _windows(text: Column, found: Column, threshold: float, templates) -> Column:
    """Hits of windows of consecutive words outside the lines that are hits, without overlap, the best first.

    A window starts and ends with bigrams of the template, as others only lower its
    coefficient, and a hit has at least |B| * DICE / (2 - DICE) of them in it.
    """
    known = F.array(*(F.struct(F.lit(-k).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n")) for k, (name, t) in enumerate(templates) if (b := bigrams_of(t))))
    every = F.array(*map(F.lit, dict.fromkeys(b for _, t in templates for b in bigrams_of(t))))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    taken, whole = F.transform(found, lambda h: h["line"]), F.transform(F.filter(found, lambda h: h["line"] < 0), lambda h: h["license"])

    def lines(taken: Column) -> Column:
        worded = F.transform(F.split(text, "\n", -1), lambda u, i: F.transform(F.when(F.array_contains(taken, i), F.array(F.lit(""))).otherwise(_words(u)), lambda w: F.struct(w.alias("w"), i.alias("line"))))
        return F.flatten(worded)

    def paired(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("p"), a["line"].alias("line")))
        return F.filter(pairs, lambda x: x["p"].isNotNull())

    def of_template(t: Column, pairs: Column, marks: Column) -> Column:
        def from_start(own: Column, m: Column, k: Column) -> Column:
            near = F.filter(F.slice(own, k + 1, F.floor(t["n"] * high + 1e-9).cast("int")), lambda e: e["at"] - m["at"] + 1 <= t["n"] * high + 1e-9)

            def best(near: Column) -> Column:
                def scored(e: Column, i: Column) -> Column:
                    held = F.size(F.array_distinct(F.transform(F.slice(near, 1, i + 1), lambda x: x["p"])))
                    size = F.size(F.array_distinct(F.transform(F.slice(pairs, m["at"] + 1, e["at"] - m["at"] + 1), lambda x: x["p"])))
                    return F.struct((2.0 * held / (size + t["n"])).alias("dice"), t["n"].alias("size"), t["template"].alias("template"), (-m["at"]).alias("start"), e["at"].alias("end"), m["line"].alias("line"), t["license"].alias("license"))

                ends = F.filter(F.transform(near, lambda e, i: F.when(i + 1 >= t["n"] * low - 1e-9, scored(e, i))), lambda x: x["dice"] >= threshold - 1e-9)
                return F.when(F.size(near) >= t["n"] * low - 1e-9, F.array_max(ends))

            return _bound(near, best)

        def starts(own: Column) -> Column:
            return F.when(F.size(own) >= t["n"] * low - 1e-9, F.filter(F.transform(own, lambda m, k: from_start(own, m, k)), lambda x: x.isNotNull()))

        return _bound(F.filter(marks, lambda m: F.array_contains(t["bigrams"], m["p"])), starts)

    def marked(pairs: Column) -> Column:
        marks = F.filter(F.transform(pairs, lambda x, i: F.struct(i.alias("at"), x["p"].alias("p"), x["line"].alias("line"))), lambda x: F.array_contains(every, x["p"]))
        return _bound(marks, lambda marks: F.flatten(F.filter(F.transform(known, lambda t: of_template(t, pairs, marks)), lambda x: x.isNotNull())))

    candidates = F.filter(_bound(_bound(_bound(taken, lines), paired), marked), lambda x: ~F.array_contains(whole, x["license"]))
    kind = "array<struct<dice:double,size:int,template:int,start:int,end:int,line:int,license:string>>"
    apart = F.aggregate(F.reverse(F.array_sort(candidates.cast(kind))), F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: (-x["start"] <= y["end"] + 1) & (x["end"] + 1 >= -y["start"])), acc).otherwise(F.array_append(acc, x)))
    return F.transform(apart, lambda x: F.struct(x["dice"], x["size"], x["template"], x["line"], x["license"]))


def hits(text: Column, threshold: float = DICE, templates=TEMPLATES) -> Column:
    """array<struct<dice, size, template, line, license>>: the best template of each unit that has one: lines in order, then windows."""
    known = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n")) for k, (name, t) in enumerate(templates) if (b := bigrams_of(t))))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    kind = "struct<dice:double,size:int,template:int,line:int,license:string>"

    def best(line: Column, unit: Column) -> Column:
        def within(own: Column) -> Column:
            n = F.size(own)
            fit = F.filter(known, lambda t: (n >= t["n"] * low - 1e-9) & (n <= t["n"] * high + 1e-9))
            scored = F.transform(fit, lambda t: F.struct((2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (n + t["n"])).alias("dice"), t["n"].alias("size"), (-t["template"]).alias("template"), line.cast("int").alias("line"), t["license"].alias("license")))
            return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold - 1e-9)).cast(kind)

        return F.transform(F.array(_bigrams(unit)), within)[0]

    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda u, i: F.struct(i.alias("line"), u.alias("unit"))), lambda x: _gate(x["unit"], threshold, templates))
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), text.alias("unit"))), lines)
    found = F.filter(F.transform(units, lambda x: best(x["line"], x["unit"])), lambda h: h.isNotNull())
    found = _bound(found, lambda found: F.concat(found, F.coalesce(_windows(text, found, threshold, templates), F.array()).cast(f"array<{kind}>")))
    return F.when(_gate(text, threshold, templates), found).otherwise(F.array().cast(f"array<{kind}>"))


def scan(docs: DataFrame, threshold: float = DICE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, hits: one row for each row of docs."""
    return docs.select("doc_id", hits(F.coalesce("text", F.lit("")), threshold).alias("hits"))


def summary(docs: DataFrame, threshold: float = DICE) -> DataFrame:
    """doc_id, n_hits, licenses (sorted, comma-joined), license, dice, line: the best hit."""
    ranked = F.array_max(F.transform("hits", lambda h: F.struct(h["dice"], h["size"], h["template"], (-h["line"]).alias("line"), h["license"])))
    found = scan(docs, threshold).withColumn("best", ranked)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",")
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), names.alias("licenses"), F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), (-F.col("best.line")).cast("long").alias("line"))


def oracle() -> str:
    """The same in DuckDB's SQL, every unit against every template."""
    quoted = ", ".join(f"({k}, '{name}', '{' '.join(words_of(t))}')" for k, (name, t) in enumerate(TEMPLATES))
    norm = "string_split(trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH t0(template, license, body) AS (VALUES {quoted}),
t1 AS (SELECT template, license, string_split(body, ' ') AS w FROM t0),
t AS (SELECT template, license, {pairs} AS b FROM t1),
units AS (
  SELECT doc_id, -1 AS line, coalesce(text, '') AS unit FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS unit FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
worded AS (SELECT doc_id, line, {norm.format('unit')} AS w FROM units),
own AS (SELECT doc_id, line, {pairs} AS b FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, line, template, license, len(t.b) AS size, 2.0::DOUBLE * len(list_intersect(own.b, t.b)) / (len(own.b) + len(t.b)) AS dice
  FROM own JOIN t ON len(own.b) BETWEEN len(t.b) * {DICE / (2 - DICE)!r} - 1e-9 AND len(t.b) * {(2 - DICE) / DICE!r} + 1e-9),
per_unit AS (SELECT * FROM scored WHERE dice >= {DICE} - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, size DESC, template) = 1),
best AS (SELECT * FROM per_unit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, size DESC, template, line) = 1),
sums AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM per_unit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_hits, coalesce(names, '') AS licenses, license, round(dice, 6) AS dice, line::BIGINT AS line
FROM documents d LEFT JOIN sums USING (doc_id) LEFT JOIN best USING (doc_id)
"""

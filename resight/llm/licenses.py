"""License scans: an exact set-similarity join of text blocks with license templates.

A block meets a template if it holds at least a share `threshold` of the template's different words.  Words are ordered by the
number of documents that hold them, rare ones first.  A block that meets a template holds one of its first words in that order (the
prefix); enough words of the vocabulary (length); and enough of them on either side of the shared one (position).  Blocks that
pass are compared exactly.  All of it is DataFrame and SQL functions.

Blocks are lines, sentences in them, and across line ends all runs of as many words as the template has, so that wrapped
notices are met too; for templates of several sentences also across the ends of sentences.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ordered, written

# Phrases whose consecutive words make a base label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Sentences of public license notices and whole notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
    # whole notices
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_W = "0-9a-z\\x{80}-\\x{10FFFF}"
WORD = f"[{_W}]+"
#: Blocks of one line end at line ends, and after a sentence.
SENTENCE_END = "(?<=[.!?])[ \\t]+"
BLOCK_END = "\\n|" + SENTENCE_END


def words_of(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _branches(words: set[str]) -> str:
    """A regular expression for any of the words, branching by one character after the other."""
    by: dict[str, set[str]] = {}
    for w in words:
        by.setdefault(w[:1], set()).add(w[1:])
    inner = [re.escape(c) + _branches(rest) for c, rest in sorted(by.items()) if c]
    if not inner or (len(inner) == 1 and "" not in by):
        return "".join(inner)
    return f"(?:{'|'.join(inner)})" + ("?" if "" in by else "")


def _any_of(words: list[str], tail: str = "") -> str:
    return f"(?<![{_W}]){_branches(set(words))}{tail}(?![{_W}])"


def _bases(phrases: dict[str, str], vocabulary: list[str]) -> str:
    """SQL for the figures of one array of words w."""
    places = []
    for phrase in phrases:
        p = phrase.split()
        same = " AND ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(p))
        places.append(f"filter(sequence(0, greatest(size(w) - 1, 0)), i -> {same})")
    listed = ", ".join(f"'{v}'" for v in vocabulary)
    return f"named_struct('n', cast(size(w) AS bigint), 'places', CASE WHEN hit THEN array({', '.join(places)}) ELSE array() END, 'known', array_intersect(w, array({listed})))"


def _wrapped(rows: DataFrame, index: list[tuple], known: Column) -> DataFrame:
    """(_ord, label, both, size) of the runs of words over the end of a line (or of any block, for templates of several) that meet a template,
    around each of its prefix words."""
    table = rows.sparkSession.createDataFrame([(rank, width, several, label, need, own) for rank, _, label, need, own, width, several in index], "rank int, width int, several boolean, label string, need int, own array<int>")
    most = {r: max(x[5] for x in index if x[0] == r) for r in {x[0] for x in index}}
    prefix, reach = ", ".join(map(str, sorted(most))), f"element_at(map({', '.join(f'{r}, {w}' for r, w in sorted(most.items()))}), w[i].rank)"
    word = lambda k, j: lambda v: F.struct(F.coalesce(F.try_element_at(known, v), F.lit(-1)).alias("rank"), k.alias("line"), (F.shiftleft(k.cast("bigint"), 32) + j).alias("block"))
    line = F.transform(F.split("t", "\n"), lambda b, k: F.flatten(F.transform(F.split(b, SENTENCE_END), lambda c, j: F.transform(_words(c), word(k, j)))))
    found = rows.filter(F.col("t").rlike(BLOCK_END)).select("_ord", F.flatten(line).alias("w"))
    # of the words, only those that a run with the prefix word can hold go on; a one-element array binds w
    near = f"slice(w, greatest(i - {reach} + 1, 0) + 1, least(i, {reach} - 1) + {reach})"
    found = found.select("_ord", F.expr(f"inline(flatten(transform(array(w), w -> transform(filter(sequence(0, size(w) - 1), i -> w[i].rank IN ({prefix})), i -> struct(w[i].rank AS rank, least(i, {reach} - 1) AS at, {near} AS near)))))"))
    found = found.filter("near[0].block < near[size(near) - 1].block").select("_ord", "rank", "at", F.col("near.rank").alias("ranks"), F.col("near.line").alias("lines"), F.col("near.block").alias("blocks"))
    pairs = found.join(F.broadcast(table), "rank").filter("size(array_intersect(own, slice(ranks, greatest(at - width + 1, 0) + 1, 2 * width - 1))) >= need")
    last = "least(i + width, size(lines)) - 1"
    run = f"CASE WHEN CASE WHEN several THEN blocks[i] < blocks[{last}] ELSE lines[i] < lines[{last}] END THEN size(array_intersect(own, slice(ranks, i + 1, width))) END"
    best = F.expr(f"array_max(transform(sequence(greatest(at - width + 1, 0), at), i -> {run}))")
    return pairs.select("_ord", "label", "need", best.alias("both"), F.size("own").alias("size")).filter("both >= need").drop("need")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    Base: all places where the words of a phrase stand one after the other, words lower-cased (A-Z) and counted from 0; first_word
    and last_word are null where there is none.  labels also holds the labels of templates that some block (a line, a sentence of it, or a run of as many words as
    the template has over a line end, for templates of several sentences over any block's end) meets; score is 1 where there is a base place, else the largest share of a template's words found in a block that
    meets it, else 0.  Labels are sorted, different and comma-joined.  A null text counts as empty; rows of equal ids are rows of
    their own; an empty table gives an empty result.  Whole texts are read.  The templates are a fixed list: tables made from them have a
    row for each of their words.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    sets = [(label, set(words_of(t)), len(words_of(t)), re.search(BLOCK_END, t) is not None) for label, t in templates if words_of(t)]
    vocabulary = sorted(set().union(*(x[1] for x in sets))) if sets else []
    rows, _ = ordered(docs, id_col, text_col)
    rows = rows.select(F.col(id_col).alias("_id"), "_ord", F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower()).alias("t"))

    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.col("t").rlike(f"(?<![{_W}])" + f"[^{_W}]+".join(map(re.escape, p.split())) + f"(?![{_W}])")
    bound = rows.withColumn("hit", hit).withColumn("w", _words(F.col("t")))
    # a one-element array binds w: the words are split once
    figures = bound.select("_id", "_ord", F.expr(f"transform(array(w), w -> {_bases(phrases, vocabulary)})[0]").alias("x"))
    starts = "flatten(x.places)"
    labels = ", ".join(f"CASE WHEN size(get(x.places, {i})) > 0 THEN '{label}' END" for i, label in enumerate(phrases.values()))
    figures = figures.select(
        "_id",
        "_ord",
        F.expr("x.n AS n_words"),
        F.expr(f"cast(size({starts}) AS bigint) AS n_base"),
        F.expr(f"cast(array_min({starts}) AS bigint) AS first_word"),
        F.expr(f"cast(array_max({starts}) AS bigint) AS last_word"),
        F.expr(f"array_sort(array_distinct(filter(array({labels}), y -> y IS NOT NULL))) AS base"),
        F.expr("x.known AS known"),
    )
    figures = written(figures, "licenses")

    # words of templates in their global order: the table has a row for each word of the fixed templates
    counts = {r.v: r.n for r in figures.select(F.explode("known").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {v: i for i, v in enumerate(sorted(vocabulary, key=lambda v: (counts.get(v, 0), v)))}
    index, prefix = [], set()
    for label, words, width, several in sets:
        ranks = sorted(order[v] for v in words)
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        for i in range(len(ranks) - need + 1):
            index.append((ranks[i], i, label, need, ranks, width, several))
            prefix.add(ranks[i])
    if not index:
        met = spark.createDataFrame([], "_ord bigint, found array<string>, share double")
    else:
        first = _any_of([v for v, i in order.items() if i in prefix])
        least = min(x[3] for x in index)
        known = F.create_map(*(F.lit(x) for v, i in order.items() for x in (v, i)))
        rows = written(rows.filter(F.col("t").rlike(first)).select("_ord", "t"), "candidates")  # texts with a prefix word
        blocks = rows.select("_ord", F.explode(F.filter(F.split("t", BLOCK_END), lambda b: b.rlike(first))).alias("b"))
        blocks = blocks.select("_ord", F.array_sort(F.filter(F.transform(F.array_distinct(_words(F.col("b"))), lambda v: F.try_element_at(known, v)), lambda r: r.isNotNull())).alias("ranks"))
        tokens = blocks.filter(F.size("ranks") >= least).select("_ord", "ranks", F.posexplode("ranks").alias("at", "rank"))
        table = spark.createDataFrame([x[:5] for x in index], "rank int, place int, label string, need int, own array<int>")
        pairs = tokens.join(F.broadcast(table), "rank").filter("size(ranks) >= need AND least(at, place) + 1 + least(size(ranks) - at, size(own) - place) - 1 >= need")
        pairs = pairs.select("_ord", "label", "need", F.expr("size(array_intersect(ranks, own))").alias("both"), F.size("own").alias("size")).filter("both >= need")
        pairs = pairs.drop("need").unionByName(_wrapped(rows, index, known))
        met = pairs.groupBy("_ord").agg(F.collect_set("label").alias("found"), F.max(F.col("both") / F.col("size")).alias("share"))
    out = figures.join(met.hint("shuffle_hash"), "_ord", "left")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.expr("cast(array() AS array<string>)")))), ",").alias("labels"),
        F.expr("CASE WHEN n_base > 0 THEN 1D ELSE coalesce(share, 0D) END").alias("score"),
    )

"""Operator 6, licence scan: a trained paragraph classifier, DataFrame only.

Paragraphs are single lines, and, as licence texts are mostly wrapped, blocks
of lines without a blank line between them, freed of comment marks and joined.

Training set: licence notices made by rule (every frame with every name of
every family, and frames with the names of two), paragraphs of licence headers
and texts, and ordinary paragraphs: all of the corpus that share no word
shingle with a notice, half of them (by hash) kept out; copies of a paragraph
count once.  Features are the presence of the notices' words and word pairs;
paragraphs with the same features are one weighted example.  Each family has a
logistic regression with sparse (L1) weights against all else, fit by proximal
gradient steps, each a query over all examples.  The unknown class is
calibrated on all ordinary paragraphs kept out of training: a family must be
more probable than all but ``false_share`` of those made it.  Every family that reaches the
threshold is predicted, and confirmed if a template of its own (a notice, a
name, a paragraph of its text) has at least ``SIMILAR`` of its five-word
shingles in the paragraph.  A block reports confirmed families only, and those
that none of its lines has confirmed.

Scoring touches few texts: from the weights follow words of which every
paragraph with a licence must hold one (all other words together can't lift
its score over the threshold).  A text without them has no licence, and its
lines are never taken apart; this loses nothing.

Defined results.  Null or empty text has no paragraphs.  A null id stays null.
Repeated rows each report.  Of templates that are equally similar any counts.
Very long texts are taken whole.  An empty table gives no rows; notices alone
then train the model.  Other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tagged, written

SIMILAR = 0.8
SHINGLE = 5
STEPS, RATE, MOMENTUM, SPARSE = 80, 0.25, 0.9, 2e-4
LEAST = 0.8               # a family is reported from this probability on, or a higher calibrated one
COMMON = 0.01             # a gram of more ordinary paragraphs says nothing of licences
EXAMPLES = 50_000         # different examples of a task
BINS = 10_000             # steps of probability in which the threshold is looked for
UNKNOWN = "unknown"

# Names of licence families, and frames of notices.
FAMILIES = {
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2",
            "GNU GPL", "GPL-3.0", "GPL-2.0"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU LGPL", "LGPL-2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0"],
    "MPL": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "EPL": ["Eclipse Public License, version 2.0", "EPL-2.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
FRAMES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.",
    "This work is licensed under {}.", "This work is licensed under the {}.",
    "This software is distributed under the terms of the {}.",
    "This file is made available under the {}.", "The code is covered by the {}.",
    "You may use it under the terms of the {}.", "SPDX-License-Identifier: {}",
]
PAIR_FRAMES = ["Licensed under the {} or the {}.", "Dual licensed under the {} and the {}."]
RIGHTS = "All-rights-reserved"
_GNU = [
    "This {1} is free software: you can redistribute it and/or modify it under the terms of the {0} as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This {1} is free software; you can redistribute it and/or modify it under the terms of the {0} as published "
    "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details.",
    "You should have received a copy of the {0} along with this {1}. If not, see <https://www.gnu.org/licenses/>.",
]
# Paragraphs of licence headers and texts.
TEXTS = {
    RIGHTS: [
        "All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.",
        "Copyright 2021 Example Inc. All Rights Reserved.", "All rights reserved by the author.",
        "This software is proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means "
        "without the prior written permission of the publisher.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
        # the same without the holder's name
        "nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [t.format("GNU General Public License", "program") for t in _GNU],
    "LGPL": [t.format("GNU Lesser General Public License", "library") for t in _GNU],
    "AGPL": [t.format("GNU Affero General Public License", "program") for t in _GNU],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
CLASSES = [*FAMILIES, RIGHTS]
# Ordinary sentences that share words with notices.
ORDINARY = [
    "She renewed her driving licence last week.", "The general public was not admitted.",
    "The Apache helicopter landed under the bridge.", "MIT researchers released a new study.",
    "The software was released in version 2.0.", "Creative people commonly share their work.",
    "The new law is covered by the press.", "This work is distributed in three terms.",
    "Mozilla and Eclipse released the file.", "The fishing license costs ten dollars.",
    "All seats are reserved for members.", "Human rights groups reserved judgement.",
    "Permission to enter was granted by the court.", "The copies were sold without a warranty.",
]
_MARKS = ",;:!?()[]{}\"'`*<>|\t\r"


def words(text: Column) -> Column:
    flat = F.translate(F.lower(text), _MARKS, " " * len(_MARKS))
    return F.filter(F.transform(F.split(flat, " "), lambda w: F.rtrim(w, F.lit("."))), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not at each mention."""
    return F.transform(F.array(value), use)[0]


def grams(w: Column) -> Column:
    def pairs(x):
        return F.transform(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))),
                           lambda a, i: F.concat_ws(" ", a, F.get(x, i + 1)))
    return _once(w, lambda x: F.array_distinct(F.concat(x, pairs(x))))


def _runs(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(x, i, n), " "))


def shingles(w: Column) -> Column:
    return _once(w, lambda x: F.array_distinct(_runs(x, SHINGLE)))


def all_shingles(w: Column) -> Column:
    """Also the shorter runs of words, as a template of fewer words than
    ``SHINGLE`` is one shingle that may stand anywhere in a paragraph."""
    return _once(w, lambda x: F.array_distinct(F.concat(*[_runs(x, n) for n in range(1, SHINGLE + 1)])))


def lines(texts: DataFrame) -> DataFrame:
    """``doc_id, tag, paragraph, last, body`` of each line that is not blank;
    a paragraph is named by its first line."""
    return (texts.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
            .withColumn("last", F.col("paragraph")).filter("trim(body) <> ''"))


# Marks that begin a commented line.
_COMMENT = r"^\s*(?://+|/\*+|\*+/?|#+|;+|--+|<!--+|%+|>+|rem(?=\s))\s*"


def blocks(texts: DataFrame) -> DataFrame:
    """As ``lines``, of two lines or more between blank ones."""
    plain = F.trim(F.regexp_replace("line", _COMMENT, ""))
    rows = (texts.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .withColumn("line", plain).withColumn("blank", (F.col("line") == "").cast("int")))
    before = Window.partitionBy("tag").orderBy("at")
    rows = rows.withColumn("block", F.sum("blank").over(before)).filter("blank = 0")
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    return (rows.groupBy("tag", "block").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("paragraph"),
                                             F.max("at").alias("last"), parts.alias("parts"))
            .filter("last > paragraph")
            .select("doc_id", "tag", "paragraph", "last", F.array_join("parts.line", " ").alias("body")))


def notices(spark: SparkSession) -> DataFrame:
    """``family, notice, body``: every name, every frame with it, every text,
    and frames with two names (families joined by a bar)."""
    rows = [(family, f"{family}/{i}/{j}", frame.format(name))
            for family, names in FAMILIES.items()
            for i, name in enumerate(names) for j, frame in enumerate(["{}", *FRAMES])]
    rows += [(family, f"{family}/text/{i}", body) for family, bodies in TEXTS.items() for i, body in enumerate(bodies)]
    known = list(FAMILIES)
    for i, a in enumerate(known):
        for step in (1, 2, 5):
            b = known[(i + step) % len(known)]
            rows += [(f"{a}|{b}", f"{a}|{b}/{j}", frame.format(FAMILIES[a][0], FAMILIES[b][0]))
                     for j, frame in enumerate(PAIR_FRAMES)]
    return spark.createDataFrame(rows, "family string, notice string, body string")


def template_shingles(spark: SparkSession) -> DataFrame:
    """``family, notice, n, shingle`` of a fixed set of templates: notices of
    one family."""
    w = notices(spark).filter(~F.col("family").contains("|")).withColumn("s", shingles(words(F.col("body"))))
    return w.select("family", "notice", F.size("s").alias("n"), F.explode("s").alias("shingle"))


def _ordinary(paras: DataFrame, count: int) -> DataFrame:
    """At most ``count`` different paragraphs of the smallest hashes that
    share no shingle with a notice, to look at; ``train`` takes all."""
    spark = paras.sparkSession
    hashed = paras.select("body", F.xxhash64("body", F.lit(3)).alias("h"))
    kinds = hashed.agg(F.approx_count_distinct("h")).first()[0]
    # only hashes small enough to be near the bound are ranked
    near = F.pmod("h", F.lit(1 << 30)) < F.lit((2.0 * count + 50) / max(kinds, 1) * (1 << 30) + 1)
    some = (hashed.filter(near).dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(count))
    known = template_shingles(spark).select("shingle").distinct()
    same = (some.select("h", F.explode(all_shingles(words(F.col("body")))).alias("shingle"))
            .join(F.broadcast(known), "shingle").select("h").distinct())
    return some.join(same, "h", "left_anti").select("h", "body")


class Model:
    """A weight per gram and family, a bias per family, and the least
    probability at which a family is reported (below it: unknown)."""

    def __init__(self, classes: list[str], vocabulary: list[tuple[str, int]], weights: np.ndarray, bias: np.ndarray):
        used = np.flatnonzero(np.abs(weights).max(axis=0) > 0)
        self.classes, self.bias, self.threshold = classes, bias, LEAST
        self.grams, self.weights = [vocabulary[i][0] for i in used], weights[:, used]
        self.plain = dict(vocabulary)              # ordinary training paragraphs with a gram

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, *map(float, self.weights[:, i])) for i, g in enumerate(self.grams)]
        return spark.createDataFrame(rows, "gram string, " + ", ".join(
            f"w{k} double" for k in range(len(self.classes))))

    def needed(self) -> list[str]:
        """Words of which a paragraph over the threshold must hold one: all
        others together can't lift any family's score to it.  Words that
        ordinary paragraphs lack come first.  Empty if no such words exist."""
        want = np.log(self.threshold / (1 - self.threshold)) - self.bias
        if (want <= 0).any():
            return []
        by_word: dict[str, list[int]] = {}
        for i, g in enumerate(self.grams):
            for w in g.split(" "):
                by_word.setdefault(w, []).append(i)
        left, out = np.maximum(self.weights, 0), []
        while by_word and (left.sum(axis=1) >= want).any():
            short = left[left.sum(axis=1) >= want]
            best = max(by_word, key=lambda w: (-self.plain.get(w, 1 << 62), short[:, by_word[w]].sum(), w))
            left[:, by_word.pop(best)] = 0
            out.append(best)
        return out


def _ordinary_grams(paras: DataFrame, seen: list[str]) -> DataFrame:
    """``h, x``: every different paragraph that shares no shingle with a
    notice, and those of its grams that are in ``seen`` (all of notices)."""
    templates = [r[0] for r in template_shingles(paras.sparkSession).select("shingle").distinct().collect()]  # fixed
    short = [t for t in templates if t.count(" ") < 2]
    long = [t.split(" ") for t in templates if t.count(" ") >= 2]
    single, pairs = [g for g in seen if " " not in g], [g for g in seen if " " in g]
    first, begin = sorted({t[0] for t in long}), sorted({" ".join(t[:2]) for t in long})
    sizes = sorted({len(t) for t in long})

    def pair(a, i):
        return F.concat_ws(" ", a, F.get("w", i + 1))

    def starts(i):
        return reduce(or_, [F.array_join(F.slice("w", i + 1, n), " ").isin(templates) for n in sizes])
    rows = paras.select(F.xxhash64("body", F.lit(3)).alias("h"), words(F.col("body")).alias("w"))
    rows = rows.select("h", "w", F.filter("w", lambda a: a.isin(single)).alias("single"), F.filter(F.transform(
        "w", lambda a, i: F.when(a.isin(single), pair(a, i))), lambda p: p.isin(pairs)).alias("pairs"), F.filter(F.transform(
            "w", lambda a, i: F.when(a.isin(first), F.when(pair(a, i).isin(begin), i))), lambda i: i.isNotNull()).alias("at"))
    rows = rows.select("h", "w", "at", F.sort_array(F.array_distinct(F.concat("single", "pairs"))).alias("x"))
    rows = rows.select("h", "x", (F.exists("at", starts) | F.exists("x", lambda g: g.isin(short))).alias("like"))
    # a filter before this would be pushed down, and the words taken anew at each mention
    return written(rows.distinct(), "ordinary").filter("NOT like").select("h", "x")


def _margins(examples: DataFrame, weights: np.ndarray, bias: np.ndarray, *columns: np.ndarray) -> DataFrame:
    """A row of each example and class ``c``: ``f``, the sum of the weights of
    its grams ``x`` and the bias; ``columns`` by class follow as ``v0``, ...
    The weights of the known grams (a fixed set of notices') go to each task,
    as texts: literals of so many numbers are slow to plan."""
    rows = [(c, ",".join(map(repr, of)), *more) for c, (of, *more) in enumerate(zip(
        np.column_stack([weights, bias]).tolist(), *(v.tolist() for v in columns), strict=True))]
    names = "".join(f", v{i} double" for i in range(len(columns)))
    table = examples.sparkSession.createDataFrame(rows, "c int, weights string" + names)
    table = table.withColumn("weights", F.split("weights", ",").cast("array<double>"))
    f = F.aggregate("x", F.get("weights", F.size("weights") - 1), lambda a, g: a + F.get("weights", g))
    return examples.crossJoin(F.broadcast(table)).withColumn("f", f).drop("weights")


def _fitted(examples: DataFrame, grams_: int, ones: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic regression per class over ``x, y,
    n``.  ``ones``: examples of each class; ``mass``: the weight of all
    examples together."""
    weights, bias = np.zeros((len(ones), grams_)), np.zeros(len(ones))
    push, up = np.zeros_like(weights), np.zeros_like(bias)
    y, p = F.expr("array_contains(y, c)"), 1 / (1 + F.exp(-F.col("f")))
    error = (F.when(y, (p - 1) * F.col("v0")).otherwise(p * F.col("v1")) * F.col("n")).alias("error")
    places = F.concat("x", F.array(F.lit(grams_))).alias("x")                # the bias last
    for _ in range(STEPS):
        rows = _margins(examples, weights, bias, 0.5 / ones, 0.5 / (mass - ones)).select("c", places, error)
        got = rows.select("c", F.explode("x").alias("g"), "error").groupBy("c", "g").agg(F.sum("error")).toArrow()
        slope = np.zeros((len(ones), grams_ + 1))
        slope[got[0].to_numpy(), got[1].to_numpy()] = got[2].to_numpy()
        push, up = push * MOMENTUM - slope[:, :-1] * RATE, up * MOMENTUM - slope[:, -1] * RATE
        weights, bias = weights + push, bias + up
        weights = np.sign(weights) * np.maximum(np.abs(weights) - RATE * SPARSE, 0)
    return weights, bias


def _high(held: DataFrame, weights: np.ndarray, bias: np.ndarray, false_share: float) -> float:
    """The probability that all but ``false_share`` of the paragraphs ``x, n``
    with a gram of some weight reach at most, to a step of ``BINS`` upwards; 0
    if it is under ``LEAST``."""
    used = [int(g) for g in np.flatnonzero(np.abs(weights).max(axis=0) > 0)]
    some = held.filter(F.exists("x", lambda g: g.isin(used)))
    some = some.withColumn("e", F.monotonically_increasing_id())
    best = _margins(some, weights, bias).groupBy("e", "n").agg(F.max("f").alias("f"))
    bins = (best.select("n", (1 / (1 + F.exp(-F.col("f")))).alias("p"))
            .groupBy(F.when(F.col("p") >= LEAST, F.floor(F.col("p") * BINS)).alias("bin"))
            .agg(F.max("p").alias("p"), F.sum("n").alias("n")).collect())
    left = int(false_share * sum(r["n"] for r in bins))
    for r in sorted((r for r in bins if r["bin"] is not None), key=lambda r: -r["bin"]):
        left -= r["n"]
        if left < 0:
            return r["p"]
    return 0.0


def train(paras: DataFrame, ordinary: int = 2000, false_share: float = 0.001) -> Model:
    """Fit on all notices and half of all ordinary paragraphs, calibrated on
    the other half.  Ordinary paragraphs in training weigh 1 each, as a notice
    does, and together ``ordinary / 2`` at most, or notices of other families
    would count for nothing beside them.  Grams that stand in more than
    ``COMMON`` of the ordinary ones are not known."""
    spark = paras.sparkSession
    hard = spark.createDataFrame([(s,) for s in ORDINARY], "body string")
    taught = (notices(spark).select("family", "body")
              .unionByName(hard.select(F.lit(UNKNOWN).alias("family"), "body"))
              .withColumn("e", F.monotonically_increasing_id()))
    taught = written(taught.select("e", "family", grams(words(F.col("body"))).alias("grams")), "taught")
    of_notices = taught.filter(F.col("family") != UNKNOWN).select(F.explode("grams").alias("gram")).distinct()
    seen = sorted(r["gram"] for r in of_notices.collect())                   # words of a fixed set of notices
    plain = _ordinary_grams(paras, seen)
    training = F.pmod("h", F.lit(2)) == 0
    plain_kinds = plain.groupBy(training.alias("training"), "x").agg(F.count(F.lit(1)).alias("n"))
    taught_kinds = taught.filter(F.col("family") == UNKNOWN).select(F.col("grams").alias("x"), F.lit(1).alias("n"))
    counts = {r["g"]: r["n"] for r in plain_kinds.filter("training").select("x", "n").unionByName(taught_kinds)
              .select(F.explode("x").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n")).collect() if r["g"] in seen}
    n = plain.filter(training).count()
    share = min(1.0, ordinary / 2 / max(n, 1))
    most = COMMON * (n + len(ORDINARY))
    vocabulary = [(g, counts.get(g, 0)) for g in seen if counts.get(g, 0) <= most]
    known = [g for g, _ in vocabulary]
    numbers = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(vocabulary)], "gram string, g int")
    plain = plain.select(training.alias("training"), F.filter("x", lambda g: g.isin(known)).alias("x"))
    plain = plain.groupBy("training", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("e", F.monotonically_increasing_id())
    plain = (plain.select("e", "training", "n", F.explode_outer("x").alias("gram")).join(F.broadcast(numbers), "gram", "left")
             .groupBy("e", "training", "n").agg(F.sort_array(F.collect_list("g")).alias("x")))
    plain = written(plain, "plain")
    of = F.transform(F.split("family", r"\|"), lambda f: F.array_position(F.lit(CLASSES), f).cast("int") - 1)
    taught = (taught.select("e", F.filter(of, lambda c: c >= 0).alias("y"), F.explode("grams").alias("gram"))
              .join(F.broadcast(numbers), "gram", "left").groupBy("e", "y").agg(F.sort_array(F.collect_list("g")).alias("x"))
              .select("x", "y", F.lit(1.0).alias("n")))
    examples = taught.unionByName(plain.filter("training").select(
        "x", F.array().cast("array<int>").alias("y"), (F.col("n") * share).alias("n")))
    parts = 1 + plain.count() // EXAMPLES
    examples = written(examples.repartition(parts), "examples").coalesce(parts)
    labels = {r["c"]: r["n"] for r in examples.select(F.explode("y").alias("c")).groupBy("c").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    mass = examples.agg(F.sum("n")).first()[0]
    weights, bias = _fitted(examples, len(vocabulary), np.array([labels[c] for c in range(len(CLASSES))], float), mass)
    model = Model(CLASSES, vocabulary, weights, bias)
    high = _high(plain.filter("NOT training").select("x", "n"), weights, bias, false_share)
    model.threshold = min(max(LEAST, high), 0.95)
    return model


UNIT = ["tag", "paragraph", "last"]


def score(paras: DataFrame, model: Model) -> DataFrame:
    """``tag, paragraph, last, family, p`` of every family for each paragraph
    (``tag, paragraph, last, body``) that holds a known gram."""
    k = len(model.classes)
    hits = (paras.select(*UNIT, F.explode(grams(words(F.col("body")))).alias("gram"))
            .join(F.broadcast(model.table(paras.sparkSession)), "gram")      # a fixed set of notices' words
            .groupBy(*UNIT).agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in range(k)]))
    logits = [F.struct((F.col(f"w{c}") + F.lit(float(model.bias[c]))).alias("f"), F.lit(name).alias("family"))
              for c, name in enumerate(model.classes)]
    each = hits.select(*UNIT, F.explode(F.array(*logits)).alias("b"))
    return each.select(*UNIT, "b.family", (1 / (1 + F.exp(-F.col("b.f")))).alias("p"))


def any_of(found: list[str]) -> str:
    """Pattern of any of the words, which are tried letter by letter: common
    beginnings are looked at once."""
    rest: dict[str, list[str]] = {}
    for w in sorted(set(found)):
        rest.setdefault(w[:1], []).append(w[1:])
    ends = rest.pop("", None)
    each = [re.escape(c) + (any_of(t) if t != [""] else "") for c, t in rest.items()]
    if not each:
        return ""
    body = each[0] if len(each) == 1 and not ends else f"(?:{'|'.join(each)})"
    return body + "?" if ends else body


def likely(texts: DataFrame, model: Model, col: str = "text") -> DataFrame:
    """Rows whose text can reach the threshold."""
    anchors = model.needed()
    if not anchors:
        return texts
    return texts.filter(F.lower(col).rlike(rf"(?:^|\W){any_of(anchors)}(?![\p{{L}}\p{{N}}])"))


def similarities(paras: DataFrame) -> DataFrame:
    """``tag, paragraph, last, family, similarity``: of a paragraph's
    ``family``, that of its closest template, if any shingle is the same."""
    parts = paras.select(*UNIT, "family", F.explode(all_shingles(words(F.col("body")))).alias("shingle"))
    return (parts.join(F.broadcast(template_shingles(paras.sparkSession)), ["family", "shingle"])
            .groupBy(*UNIT, "family", "notice").agg((F.count(F.lit(1)) / F.max("n")).alias("similarity"))
            .groupBy(*UNIT, "family").agg(F.max("similarity").alias("similarity")))


def _predicted(paras: DataFrame, model: Model) -> DataFrame:
    """One row per paragraph and family over the threshold."""
    paras = written(likely(paras, model, "body"), "paragraphs")
    found = (score(paras, model).filter(F.col("p") >= model.threshold)).join(paras, UNIT)
    found = written(found, "licences")
    out = found.join(similarities(found), [*UNIT, "family"], "left")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return out.select("doc_id", *UNIT, "family", F.col("p").alias("probability"), similarity.alias("similarity"),
                      (similarity >= SIMILAR).alias("confirmed"))


def license_scan(docs: DataFrame, ordinary: int = 2000, false_share: float = 0.001,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph and licence family: ``doc_id, tag, paragraph,
    last, family, probability, similarity, confirmed`` (``paragraph`` to
    ``last``: its lines)."""
    texts = tagged(docs, id_col, text_col)
    model = train(lines(texts), ordinary, false_share)
    some = written(likely(texts, model), "likely")
    single = written(_predicted(lines(some), model), "single")
    wrapped = _predicted(blocks(some), model).filter("confirmed").alias("w")
    seen = single.filter("confirmed").select("tag", "paragraph", "family").alias("s")
    wrapped = wrapped.join(seen, F.expr("w.tag = s.tag AND w.family = s.family AND s.paragraph >= w.paragraph "
                                        "AND s.paragraph <= w.last"), "left_anti")
    return single.unionByName(wrapped)

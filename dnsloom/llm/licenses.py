"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line, read on into the lines after it up to one without words,
so a notice may be wrapped; it counts for the line it begins in. Features are
the words and word pairs shared with a vocabulary drawn from licence notices; a multinomial logistic regression gives
each licence family, and "unknown", a probability. Training goes by gradient
steps: the executors sum the gradient over the training rows, the driver holds
the weights (a few thousand numbers). Training rows are the notices below, each
also with every single word left out, and a bounded sample of paragraphs
(``SAMPLE``, by hash order), unknown unless they hold a whole notice. Half of
the unknown ones are kept out of training; the probability that a family must
reach is calibrated on them.

Each notice is compared by itself. From every one of its words in a line on, the
stretch that holds most of its words is found (of equals the shortest; up to
the line's end, or twice the notice's length if that is more). The family is
reported if the stretch confirms the notice (``CONFIRM``), no other family's
confirmed notice accounts for all the words (the GNU GPL's are in the Lesser
one's), and the family's probability passes on the notice's features there. So a
line may name several families. Lines of over ``CHUNK`` words go piece by piece;
stretches run on from one piece into the next.

A text without most words of any notice is cleared by one look; nothing is capped.

Null or empty text: no paragraphs. Repeated rows and ids: a row each. Empty
tables give empty results (the model then comes from the notices alone).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording of public licence notices by family.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "You can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0": ["You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited"],
}
FAMILIES = sorted(NOTICES)
#: Paragraphs sampled for training and calibration; gradient steps; share of a notice's words that confirm it.
SAMPLE, STEPS, CONFIRM = 4000, 25, 0.8
#: Words of a line that are compared at once.
CHUNK = 64


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def grams(w: Column) -> Column:
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(w, F.coalesce(pairs, F.array().cast("array<string>"))))


def _word_list(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def _gram_set(w: list[str]) -> frozenset[str]:
    return frozenset(w) | frozenset(" ".join(p) for p in zip(w, w[1:], strict=False))


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _longest() -> int:
    return max(len(_word_list(n)) for f in FAMILIES for n in NOTICES[f])


def sample_paragraphs(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """A bounded sample: of the documents first by hash, up to ``most`` paragraphs, as arrays of words, and with the words around them (near)."""
    texts = docs.filter(F.length(text_col) > 0).select(F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    first = texts.select("h").distinct().orderBy("h").limit(most // 4)  # hashes only; their number is bounded
    some = texts.join(F.broadcast(first), "h").dropDuplicates(["h"])
    side = _longest() - 1
    lines = some.select(F.split("t", "\n").alias("lines")).select("lines", F.transform("lines", words).alias("ws"))

    def around(w: Column, i: Column) -> Column:
        before = F.flatten(F.slice("ws", F.greatest(i - side, F.lit(0)) + 1, F.least(i, F.lit(side))))
        before = F.slice(before, F.greatest(F.size(before) - side, F.lit(0)) + 1, F.lit(side))
        return F.struct(F.get("lines", i).alias("line"), w.alias("w"), F.concat(before, w, F.slice(F.flatten(F.slice("ws", i + 2, F.lit(side))), 1, side)).alias("near"))

    return lines.select(F.inline(F.transform("ws", around))).orderBy(F.xxhash64("line"), F.xxhash64("near")).limit(most).select("w", "near")


class Model:
    """Weights per vocabulary entry (a number per family) and what calibration found."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float], floor: float):
        self.weights, self.bias, self.floor = weights, bias, floor

    def probabilities(self, features: Column) -> Column:
        """array<double>: a probability per family; what is missing to 1 is unknown's."""
        return _softmax(_logits(features, self.weights, self.bias))


def _logits(features: Column, weights: dict, bias: list[float]) -> Column:
    table = _literal(weights, "map<string,array<double>>")
    return F.aggregate(features, _literal(bias, "array<double>"), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _softmax(logits: Column) -> Column:
    def scaled(z: Column) -> Column:
        return _let(F.greatest(F.array_max(z), F.lit(0.0)), lambda top: F.concat(F.transform(z, lambda x: F.exp(x - top)), F.array(F.exp(-top))))

    def shares(e: Column) -> Column:
        return _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(F.slice(e, 1, F.size(e) - 1), lambda x: x / total))

    return _let(_let(logits, scaled), shares)


def train(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE, steps: int = STEPS) -> Model:
    """Fits the classifier; see the module's text."""
    wholes = [(k, _word_list(n)) for k, f in enumerate(FAMILIES) for n in NOTICES[f]]
    seen = sample_paragraphs(docs, text_col, sample)
    # A sampled paragraph that holds a whole notice, or a line of a wrapped one, is no example of "unknown".
    joined = F.concat(F.lit(" "), F.array_join("near", " "), F.lit(" "))
    known = [F.contains(joined, F.lit(f" {' '.join(w)} ")) for _, w in wholes]
    clean = seen.filter(F.size("w") > 0)
    for k in known:
        clean = clean.filter(~k)
    vocabulary = sorted({g for _, w in wholes for g in _gram_set(w)})
    listed = _literal(vocabulary, "array<string>")
    rows = clean.select(F.array_sort(F.array_intersect(grams(F.col("w")), listed)).alias("f"), F.pmod(F.xxhash64("w"), F.lit(2)).alias("half"))
    rows = [(tuple(r[0]), r[1], r[2]) for r in rows.groupBy("f", "half").count().orderBy(F.desc("count"), "f", "half").limit(sample).collect()]
    seen_rows = sum(n for _, _, n in rows)
    # Entries that many unknown paragraphs have tell nothing.
    common: dict[str, int] = {}
    for f, _, n in rows:
        for g in f:
            common[g] = common.get(g, 0) + n
    vocabulary = [g for g in vocabulary if common.get(g, 0) * 50 <= seen_rows]
    kept = set(vocabulary)
    unknown = [(sorted(kept & set(f)), half, n) for f, half, n in rows]

    examples: dict[tuple, float] = {}
    for k, w in wholes:
        for left in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
            key = (k, tuple(sorted(kept & _gram_set(left))))
            examples[key] = examples.get(key, 0) + 10.0 / len(w)
    for f, half, n in unknown:
        if not half:
            examples[len(FAMILIES), tuple(f)] = examples.get((len(FAMILIES), tuple(f)), 0) + n
    table = [{"y": y, "f": list(f), "n": n} for (y, f), n in sorted(examples.items()) if f or y == len(FAMILIES)]
    training = docs.sparkSession.range(1).select(F.inline(_literal(table, "array<struct<y:int,f:array<string>,n:double>>")))
    weights = {g: [0.0] * len(FAMILIES) for g in vocabulary}
    bias = [-2.0] * len(FAMILIES)
    squares: dict[tuple[str, int], float] = {}
    for _ in range(steps):
        p = _softmax(_logits(F.col("f"), weights, bias))
        error = F.transform(p, lambda x, i: F.col("n") * (F.when(F.col("y") == i, 1.0).otherwise(0.0) - x))
        pushed = training.select(F.explode(F.concat("f", F.array(F.lit("")))).alias("g"), F.posexplode(error).alias("k", "e"))
        for g, k, e in pushed.groupBy("g", "k").agg(F.sum("e")).collect():
            value = e - 0.01 * (weights[g][k] if g else 0.0)
            squares[g, k] = squares.get((g, k), 1e-6) + value * value
            move = 0.6 * value / math.sqrt(squares[g, k])
            if g:
                weights[g][k] += move
            else:
                bias[k] += move
    held = [(f, n) for f, half, n in unknown if half]
    floor = 0.5
    for f, _ in held:
        z = [b + sum(weights[g][k] for g in f) for k, b in enumerate(bias)]
        top = max(0.0, *z)
        total = math.exp(-top) + sum(math.exp(x - top) for x in z)
        floor = max(floor, min(0.95, math.exp(max(z) - top) / total + 1e-6))
    return Model(weights, bias, floor)


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """Per row: id, n_paragraphs, and found: array<struct<paragraph, family, probability, share>> of confirmed paragraphs, in order; a row for each family of a paragraph."""
    lines = F.when(F.length(text_col) > 0, F.split(F.col(text_col).cast("string"), "\n")).otherwise(F.array().cast("array<string>"))
    wholes = [(k, _word_list(n)) for k, f in enumerate(FAMILIES) for n in NOTICES[f]]
    listed = _literal(sorted({x for _, w in wholes for x in w}), "array<string>")
    table = [{"id": i, "k": k, "reach": 2 * len(w), "w": sorted(set(w)), "g": sorted(_gram_set(w) & set(model.weights))} for i, (k, w) in enumerate(wholes)]
    notices = _literal(table, "array<struct<id:int,k:int,reach:int,w:array<string>,g:array<string>>>")
    families = _literal(FAMILIES, "array<string>")
    reach = 2 * _longest()
    found_type = "array<struct<paragraph:int,family:string,probability:double,share:double>>"

    def share(n: Column, w: Column) -> Column:
        return F.size(F.array_intersect(n["w"], w)) / F.size(n["w"])

    def possible(w: Column) -> Column:
        """Notices that could be confirmed in a text of these words."""
        return _let(F.array_intersect(listed, w), lambda have: F.filter(notices, lambda n: share(n, have) >= confirm))

    def chunks(w: Column, i: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(CHUNK)), lambda o: F.slice(w, o + 1, CHUNK))
        return F.transform(cut, lambda c: F.struct(i.alias("i"), c.alias("w")))

    def following(j: Column) -> Column:
        """The words after a chunk, up to a line without words."""
        after = F.transform(F.slice("_chunks", j + 2, F.lit(reach)), lambda c: c["w"])
        blank = lambda a: F.array_position(a, F.array().cast("array<string>")).cast("int")
        return F.slice(F.flatten(_let(after, lambda a: F.when(blank(a) > 0, F.slice(a, F.lit(1), blank(a) - 1)).otherwise(a))), 1, reach)

    def explained(n: Column, w: Column) -> Column:
        """Whether another family's confirmed notice accounts for all that the stretch has of this one."""
        mine = F.array_intersect(n["w"], w)

        def by(m: Column) -> Column:
            theirs = F.array_intersect(m["w"], w)
            closer = (F.size(mine) == F.size(theirs)) & (F.size(n["w"]) < F.size(m["w"]))
            return (m["k"] != n["k"]) & (share(m, w) >= confirm) & (F.size(F.array_except(mine, theirs)) == 0) & ~closer

        return F.exists(notices, by)

    def stretches(unit: Column, n: Column, own: Column) -> Column:
        """From each of the notice's words in the chunk on, the shortest stretch with as many of its words as come."""

        def from_(s: Column) -> Column:
            rest = F.slice(unit, s + 1, F.greatest(n["reach"], own - s))
            to = lambda w: F.array_max(F.transform(F.array_intersect(n["w"], w), lambda x: F.array_position(w, x))).cast("int")
            return _let(rest, lambda w: F.struct(s.alias("s"), share(n, w).alias("share"), F.slice(w, F.lit(1), to(w)).alias("w")))

        starts = F.filter(F.sequence(F.lit(0), own - 1), lambda s: F.array_contains(n["w"], F.get(unit, s)))
        # A first word that comes again is not needed.
        needed = lambda x: ~F.array_contains(F.slice(x["w"], F.lit(2), F.size(x["w"])), F.get(x["w"], F.lit(0)))
        return F.filter(F.transform(starts, from_), lambda x: (x["share"] >= confirm) & needed(x) & ~explained(n, x["w"]))

    def best(unit: Column, n: Column, own: Column) -> Column:
        ranked = F.transform(stretches(unit, n, own), lambda x: F.struct(x["share"].alias("share"), (-F.size(x["w"])).alias("short"), (-x["s"]).alias("early"), x["w"].alias("w")))
        return F.array_max(ranked)

    def judged(c: Column, j: Column) -> Column:
        def with_notices(unit: Column) -> Column:
            def one(n: Column) -> Column:
                return _let(best(unit, n, F.size(c["w"])), lambda x: outcome(n, x))

            def outcome(n: Column, x: Column) -> Column:
                p = F.get(model.probabilities(F.array_intersect(grams(x["w"]), n["g"])), n["k"])
                past = F.size(x["w"]) - x["early"] - F.size(c["w"])
                return F.when(
                    x.isNotNull(),
                    F.struct(c["i"].alias("paragraph"), F.get(families, n["k"]).alias("family"), p.alias("probability"), x["share"].alias("share"), n["id"].alias("id"), j.alias("j"), (-x["early"]).alias("s"), past.alias("past")),
                )

            return F.filter(F.transform(possible(unit), one), lambda x: x["probability"] >= model.floor)

        return F.when(F.arrays_overlap(c["w"], listed), _let(F.concat(c["w"], following(j)), with_notices))

    def overlap(x: Column, y: Column) -> Column:
        """Whether x, of an earlier chunk, runs into y."""
        between = F.aggregate(F.slice("_chunks", x["j"] + 2, F.greatest(y["j"] - x["j"] - 1, F.lit(0))), F.lit(0), lambda n, c: n + F.size(c["w"]))
        return (x["id"] == y["id"]) & (x["j"] < y["j"]) & (x["past"] > 0) & (between + y["s"] < x["past"])

    # Of overlapping finds of one notice the fullest stays, of equals the last.
    kept = F.filter("_found", lambda x: ~F.exists("_found", lambda y: ((y["share"] >= x["share"]) & overlap(x, y)) | ((y["share"] > x["share"]) & overlap(y, x))))
    # Once for each paragraph and family, by its fullest notice.
    better = lambda x, y: (x["paragraph"] == y["paragraph"]) & (x["family"] == y["family"]) & (F.struct(y["share"], y["id"], y["j"]) > F.struct(x["share"], x["id"], x["j"]))
    once = F.filter("_kept", lambda x: ~F.exists("_kept", lambda y: better(x, y)))
    order = F.array_sort(F.transform(once, lambda x: F.struct(*[x[c].alias(c) for c in ("paragraph", "family", "probability", "share")])))

    step = docs.select(F.col(id_col), F.transform(lines, words).alias("_words"))
    step = step.select(id_col, F.size("_words").cast("long").alias("n_paragraphs"), F.when(F.size(possible(F.flatten("_words"))) > 0, F.flatten(F.transform("_words", chunks))).alias("_chunks"))
    step = step.select(id_col, "n_paragraphs", "_chunks", F.flatten(F.filter(F.transform("_chunks", judged), lambda x: x.isNotNull())).alias("_found"))
    step = step.select(id_col, "n_paragraphs", kept.alias("_kept"))
    return step.select(id_col, "n_paragraphs", F.coalesce(order, F.array()).cast(found_type).alias("found"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size(F.array_distinct("found.paragraph")).cast("long").alias("n_licence"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",").alias("paragraphs"),
    )

"""Licence scan of paragraphs, in DataFrame operations only once the model is fitted.

A paragraph (a line of text, or a notice wrapped over lines) is scored by multinomial logistic regression over its distinct words and word pairs. The
model is sparse: it knows the n-grams of the notices below and nothing else, so its weights are a small fixed table that
is broadcast. An ``unknown`` class is trained on look-alike prose, and the probability threshold ``LEAST`` is calibrated
on notices and prose that were left out. A predicted family is confirmed by comparison with its templates:
enough of the word triples of one of them must stand in the paragraph.

Lines are scored if they have a cue string or a word triple of a template; others cannot be confirmed. Notices that are
wrapped over several lines of a paragraph are found by their triples across line ends and scored as one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Short notices of public licences, by family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Distributed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
#: Prose with the same cues that names no licence.
LOOK_ALIKES = [
    "He lost his driving license after the second version of the story.",
    "The copyright office opened a new public building in the city.",
    "A fishing license is required, and permission is granted by the county.",
    "She asked for permission to leave the general meeting.",
    "The warranty covers the source of the fault for two years.",
    "The licence fee was raised by the broadcasting company.",
    "Redistribution of wealth was the subject of the work.",
    "The apache helicopter landed near the foundation.",
    "Students of MIT published a paper under the lesser known title.",
    "Rights of the public were reserved for all.",
]
CUES = ("licen", "copyright", "rights reserved", "permission", "redistribut", "warrant", "gpl")
UNKNOWN = "unknown"
LEAST = 0.6
CONFIRM = 0.6
WORD = r"[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w]


def grams(ws: list[str]) -> set[str]:
    return set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}


@lru_cache(maxsize=1)
def fitted() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Classes, weights of each n-gram, biases and the temperature. Deterministic; the training set is the notices above, with noise."""
    rng = np.random.default_rng(3)
    classes = [*NOTICES, UNKNOWN]
    source = [(k, n) for k, family in enumerate(NOTICES) for n in NOTICES[family]] + [(len(NOTICES), n) for n in LOOK_ALIKES]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(grams(words(n)) for _, n in source))))}
    samples: list[tuple[int, set[int]]] = []
    for k, notice in source:
        for copy in range(30):
            ws = [w for w in words(notice) if copy == 0 or rng.random() > 0.1]
            noise = [f"w{rng.integers(10_000)}" for _ in range(rng.integers(0, 12))]
            samples.append((k, {vocabulary[g] for g in grams([*noise[: len(noise) // 2], *ws, *noise[len(noise) // 2 :]]) if g in vocabulary}))
    for _ in range(300):  # single words out of context say nothing
        picked = rng.choice(len(vocabulary), rng.integers(0, 3), replace=False)
        samples.append((len(NOTICES), set(picked.tolist())))
    x = np.zeros((len(samples), len(vocabulary)))
    for row, (_, found) in zip(x, samples, strict=True):
        row[list(found)] = 1
    y = np.eye(len(classes))[[k for k, _ in samples]]
    fit = rng.random(len(samples)) < 0.8
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    for _ in range(400):
        p = softmax(x[fit] @ w + b)
        g = (p - y[fit]) / fit.sum()
        w -= 4.0 * (x[fit].T @ g + 2e-5 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * 2e-5, 0)  # sparse
        b -= 4.0 * g.sum(0)
    held = x[~fit] @ w + b
    temperature = min((t for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)), key=lambda t: -np.log(np.maximum((softmax(held / t) * y[~fit]).sum(1), 1e-12)).mean())
    return classes, {g: [round(float(v), 4) for v in w[i]] for g, i in vocabulary.items() if np.abs(w[i]).max() > 0}, [round(float(v), 4) for v in b], float(temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def weight_table(spark: SparkSession) -> DataFrame:
    """gram, w array<double>: some hundreds of rows, fixed by the notices."""
    _, weights, _, _ = fitted()
    rows = ", ".join(f"('{g}', array({', '.join(f'{v}D' for v in w)}))" for g, w in weights.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(gram, w)")


def triples(ws: str) -> str:
    """SQL for the distinct word triples of the word array ``ws``, or the whole of fewer words."""
    return f"CASE WHEN size({ws}) < 3 THEN array(array_join({ws}, ' ')) ELSE array_distinct(transform(sequence(1, size({ws}) - 2), i -> concat_ws(' ', {ws}[i - 1], {ws}[i], {ws}[i + 1]))) END"


def python_triples(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)} if len(ws) >= 3 else {" ".join(ws)}


def likeness() -> Column:
    """Largest share of a template's triples that the column ``found`` has, over the templates of the column ``family``."""
    cases = F.lit(0.0)
    for family, notices in NOTICES.items():
        shares = [F.size(F.array_intersect("found", F.array(*map(F.lit, sorted(python_triples(words(n))))))) / F.lit(float(len(python_triples(words(n))))) for n in notices]
        cases = F.when(F.col("family") == family, F.greatest(*shares)).otherwise(cases)
    return cases


def quoted(some: set[str]) -> str:
    return f"array({', '.join(repr(t) for t in sorted(some))})"


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, n_paragraphs of each row of ``docs``, with unit, pos, last, target, ws of each piece of it to be scored (null without any).

    Pieces are lines with a cue or a word triple of a template, and what may be a notice that is wrapped over lines
    ``pos`` to ``last``: the words from the first to the last triple of the templates of one family (``target``), between blank
    lines and with no more than the words of the longest template between two of them.
    """
    by_family = [set().union(*(python_triples(words(n)) for n in notices)) for notices in NOTICES.values()]
    known = quoted(set().union(*by_family))
    gap = max(len(words(n)) for notices in NOTICES.values() for n in notices)
    cue = " OR ".join(f"contains(low[n], '{c}')" for c in CUES)
    none = "cast(array() AS array<struct<pos:int,last:int,target:string,ws:array<string>>>)"
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(F.lower(text_of(text_col)), "\n").alias("low"))
        .withColumn("lw", F.expr(f"transform(low, l -> filter(split(l, '{WORD}'), w -> w != ''))"))
        .withColumn("flat", F.flatten("lw"))
        .withColumn("likely", F.expr(f"arrays_overlap({triples('flat')}, {known})"))
        .withColumn("tok", F.expr(f"CASE WHEN likely THEN flatten(transform(low, (l, i) -> CASE WHEN trim(BOTH ' \t\r' FROM l) = '' THEN array_repeat(struct('' AS w, i AS i), {gap}) ELSE transform(lw[i], w -> struct(w AS w, i AS i)) END)) END"))
        .withColumn("hits", F.expr(f"CASE WHEN size(tok) >= 3 THEN filter(transform(sequence(0, size(tok) - 3), k -> struct(k AS k, concat_ws(' ', tok[k].w, tok[k + 1].w, tok[k + 2].w) AS t)), h -> array_contains({known}, h.t)) ELSE cast(array() AS array<struct<k:int,t:string>>) END"))
        .withColumn("of", F.expr(f"transform(array({', '.join(map(quoted, by_family))}), f -> filter(hits, h -> array_contains(f, h.t)))"))
        .withColumn("starts", F.expr(f"transform(of, h -> CASE WHEN size(h) = 0 THEN cast(array() AS array<int>) ELSE filter(sequence(0, size(h) - 1), k -> k = 0 OR h[k].k - h[greatest(k - 1, 0)].k > {gap}) END)"))
        .withColumn("spans", F.expr(f"flatten(transform(of, (h, f) -> transform(starts[f], (s, j) -> struct(array({', '.join(map(repr, NOTICES))})[f] AS target, h[s].k AS a, h[CASE WHEN j + 1 < size(starts[f]) THEN starts[f][j + 1] - 1 ELSE size(h) - 1 END].k + 2 AS b))))"))
        .withColumn("lines", F.expr(f"transform(filter(sequence(0, size(low) - 1), n -> {cue} OR (likely AND arrays_overlap({triples('lw[n]')}, {known}))), n -> struct(n AS pos, n AS last, cast(NULL AS string) AS target, lw[n] AS ws))"))
        .withColumn("wrapped", F.expr(f"CASE WHEN likely THEN transform(filter(spans, s -> tok[s.a].i < tok[s.b].i), s -> struct(tok[s.a].i AS pos, tok[s.b].i AS last, s.target AS target, transform(slice(tok, s.a + 1, s.b - s.a + 1), t -> t.w) AS ws)) ELSE {none} END"))
        .select("row", "id", F.size("low").alias("n_paragraphs"), F.posexplode_outer(F.concat("lines", "wrapped")).alias("unit", "u"))
        .select("row", "id", "n_paragraphs", "unit", "u.pos", "u.last", "u.target", "u.ws")
    )


def scored_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``units`` without the words, and cued (whether there is a unit), family, probability, likeness, confirmed."""
    classes, _, bias, temperature = fitted()
    pairs = F.expr("CASE WHEN size(ws) < 2 THEN cast(array() AS array<string>) ELSE transform(sequence(1, size(ws) - 1), i -> concat_ws(' ', ws[i - 1], ws[i])) END")
    place = ["row", "id", "n_paragraphs", "unit", "pos", "last", "target"]
    scored = (
        units(docs, id_col, text_col)
        .select(*place, F.expr(triples("ws")).alias("found"), F.explode_outer(F.array_distinct(F.concat("ws", pairs))).alias("gram"))
        .join(F.broadcast(weight_table(docs.sparkSession)), "gram", "left")
        .groupBy(*place)
        .agg(F.any_value("found").alias("found"), *[F.round(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)), 4).alias(f"z{k}") for k in range(len(classes))])
    )
    z = [(F.col(f"z{k}") + F.lit(bias[k])) / F.lit(temperature) for k in range(len(classes))]
    top = F.greatest(*z)
    best = F.coalesce(*[F.when(z[k] == top, F.lit(c)) for k, c in enumerate(classes)])
    share = 1 / sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    own = F.col("target").isNull() | (F.col("target") == F.col("family"))
    return (
        scored.select(*place, F.col("unit").isNotNull().alias("cued"), "found", best.alias("best"), share.alias("probability"))
        .withColumn("family", F.when(F.col("cued") & (F.col("probability") >= LEAST), F.col("best")).otherwise(UNKNOWN))
        .withColumn("likeness", likeness())
        .select(*place, "cued", "family", "probability", "likeness", ((F.col("family") != UNKNOWN) & own & (F.coalesce("likeness", F.lit(0.0)) >= CONFIRM)).alias("confirmed"))
    )


def scan_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, pos, cued, family, probability, likeness, confirmed of each line that is scored. ``row`` tells repeated rows apart."""
    return scored_units(docs, id_col, text_col).where("cued AND target IS NULL").select("row", "id", "pos", "cued", "family", "probability", "likeness", "confirmed")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_paragraphs (lines), n_cued (lines scored), n_licence (confirmed), families (sorted, joined by commas), probability (largest) for each row.

    A wrapped notice counts in n_licence once, unless a line of it is confirmed alone. Null and empty texts have one empty
    paragraph and no licence. Repeated rows are scanned each. Other columns are ignored. An empty table gives an empty result.
    """
    confirmed = F.col("confirmed")
    found = scored_units(docs, id_col, text_col).groupBy("row", "id", "n_paragraphs").agg(
        F.count_if(F.col("cued") & F.col("target").isNull()).alias("n_cued"),
        F.collect_list(F.when(confirmed, F.struct("pos", "last", "target", "family"))).alias("sure"),
        F.array_join(F.array_sort(F.collect_set(F.when(confirmed, F.col("family")))), ",").alias("families"),
        F.max(F.when(confirmed, F.round("probability", 6))).alias("probability"),
    )
    n_licence = F.expr("cast(size(filter(sure, u -> u.target IS NULL OR NOT exists(sure, v -> v.target IS NULL AND v.family = u.family AND v.pos BETWEEN u.pos AND u.last))) AS bigint)")
    return found.select(F.col("id").alias(id_col), F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "n_cued", n_licence.alias("n_licence"), "families", "probability")

"""Licence notices by a trained paragraph classifier; scoring is in SQL functions alone.

A multinomial logistic regression over word unigrams and bigrams is fitted on
the driver, from variants of short notices of each licence family and from
sentences that only sound alike, which make up the unknown class. Its
probabilities are calibrated by a temperature fitted on variants it has not
seen. Scoring explodes a paragraph's n-grams, joins them with the table of
weights (a bounded vocabulary, so it is broadcast) and sums them up. A family
counts if it is the likeliest, by the threshold, and one of its notices shares
most of its words with the paragraph. As both must hold, the cheaper condition
is looked at first: paragraphs that share enough words with no notice of any
family can show none, whatever the classifier says of them.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import materialize, table

UNKNOWN = "unknown"
THRESHOLD = 0.6
#: Least share of a notice's words that a paragraph must hold.
OVERLAP = 0.6
MAX_NGRAMS = 4096
#: What parts blocks of lines: lines without a letter or digit, as in empty comment lines.
_BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"

#: Notices by family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain",
        "To the extent possible under law, the author has dedicated all copyright to the public domain CC0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "Copyright 2020 the authors. All rights reserved",
        "Unauthorized copying or redistribution of this file is strictly prohibited",
    ],
}

#: Sentences that mention the same words without granting anything.
ALIKE = [
    "She renewed her driver's license at the public office",
    "The warranty of this washing machine ends after two years",
    "Copyright law was debated in parliament last week",
    "He has a license to fish in the lake with permission of the owner",
    "The software version 2.0 was released under pressure",
    "A general practitioner works under the terms of the public health act",
    "Redistribution of wealth is a matter of public policy",
    "The source of the river is in compliance with the map",
    "Attribution of the painting to the master is in doubt",
    "This work is under construction and will be released in version 3",
    "The Apache helicopter landed at MIT in Massachusetts",
    "The foundation published a free book for the general public",
    "Our license plate was stolen and the warrant was issued",
]
_FILLER = "the and of to in it that was for on with as at by from or had not are but some what there we out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
_SEPARATOR = "[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATOR, text.lower()) if w]


def _ngrams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def training_set(seed: int) -> tuple[list[list[str]], list[int]]:
    """Variants of every notice and of the sentences alike (class 0): words lost, words around them."""
    random, rows, classes = np.random.default_rng(seed), [], []

    def around(n: int) -> list[str]:
        return [_FILLER[i] for i in random.integers(0, len(_FILLER), n)]

    for c, texts in enumerate([ALIKE, *NOTICES.values()]):
        for text in texts:
            for _ in range(12 if c == 0 else 24):
                words = [w for w in _words(text) if random.random() > 0.08]
                rows.append(around(random.integers(0, 12)) + words + around(random.integers(0, 12)))
                classes.append(c)
    for _ in range(150):
        rows.append(around(random.integers(1, 40)))
        classes.append(0)
    every = sorted({w for texts in NOTICES.values() for t in texts for w in _words(t)})
    for _ in range(150):  # single words of notices amid others
        words = around(random.integers(5, 30))
        words[random.integers(0, len(words))] = every[random.integers(0, len(every))]
        rows.append(words)
        classes.append(0)
    return rows, classes


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float

    def probabilities(self, text: str) -> dict[str, float]:
        """The same scores without Spark, for tests and single paragraphs."""
        z = np.array(self.bias)
        for g in _ngrams(_words(text)):
            z = z + np.array(self.weights.get(g, [0.0] * len(z)))
        e = np.exp((z - z.max()) / self.temperature)
        return dict(zip(self.families, (e / e.sum()).tolist(), strict=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def fit_licences(rounds: int = 300, ridge: float = 2e-3) -> LicenceModel:
    rows, classes = training_set(1)
    held, held_classes = training_set(2)
    counts: dict[str, int] = {}
    for words in rows:
        for g in _ngrams(words):
            counts[g] = counts.get(g, 0) + 1
    vocabulary = sorted(sorted(counts), key=counts.__getitem__, reverse=True)[:MAX_NGRAMS]
    place = {g: i for i, g in enumerate(vocabulary)}
    families = (UNKNOWN, *NOTICES)

    def matrix(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(vocabulary)))
        for i, words in enumerate(texts):
            x[i, [place[g] for g in _ngrams(words) if g in place]] = 1
        return x

    x, y = matrix(rows), np.eye(len(families))[classes]
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    step = 4.0 / max(1.0, float((x**2).sum(axis=1).mean()))
    for _ in range(rounds):
        error = (_softmax(x @ w + b) - y) / len(x)
        w -= step * len(families) * (x.T @ error + ridge / len(families) * w)
        b -= step * len(families) * error.sum(axis=0)
    z = matrix(held) @ w + b
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), held_classes] + 1e-12).mean()
    temperature = min((math.exp(k / 10) for k in range(-15, 16)), key=loss)
    return LicenceModel(families, {g: w[i].round(6).tolist() for g, i in place.items()}, b.round(6).tolist(), temperature)


def _word_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SEPARATOR), lambda w: w != "")


def _notice_words() -> list[str]:
    return sorted({w for notices in NOTICES.values() for n in notices for w in _words(n)})


def _shares_enough(words: Column, notices: list[str]) -> Column:
    """Whether one of the notices has at least ``OVERLAP`` of its words among distinct ``words``."""
    out = F.lit(False)
    for notice in notices:
        own = sorted(set(_words(notice)))
        out |= F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) >= OVERLAP * len(own)
    return out


def _confirmed(words: Column, family: Column) -> Column:
    """Whether one of the family's notices shares enough of its words with a paragraph."""
    out = F.lit(False)
    for name, notices in NOTICES.items():
        out |= (family == name) & _shares_enough(words, notices)
    return out


def classify_paragraphs(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(row, paragraph, line, family, probability) of each licence notice in ``docs`` (doc_id, text).

    ``row`` is the text's MD5, which equal texts share; paragraphs are the
    blocks between blank lines. Each line of a block is classified, and where it
    has several also the block with its lines joined (line -1), which finds
    wrapped notices; it counts for a family none of its lines shows. Of equally
    likely families the one listed first counts.
    """
    model = model or fit_licences()
    spark, names = docs.sparkSession, [f"z{i}" for i in range(len(model.families))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split("body", "\n")
    units = F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("text"))), F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line"), F.regexp_replace("body", r"\n\W*+", " ").alias("text")))).otherwise(F.expr("cast(array() as array<struct<line:int,text:string>>)")))
    blocks = docs.select(F.md5(text).alias("row"), F.posexplode(F.split(text, _BLANK)).alias("paragraph", "body")).select("row", "paragraph", F.explode(units).alias("u"))
    split = blocks.select("row", "paragraph", "u.line", _word_column(F.col("u.text")).alias("words"))
    every = [n for notices in NOTICES.values() for n in notices]
    fewest = math.ceil(OVERLAP * min(len(set(_words(n))) for n in every))
    common = split.withColumn("common", F.array_intersect("words", F.array(*map(F.lit, _notice_words())))).filter(F.size("common") >= fewest)
    words = materialize(common.filter(_shares_enough(F.col("common"), every)).dropDuplicates(["row", "paragraph", "line"]), "paragraphs")
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    grams = words.select("row", "paragraph", "line", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    entries = json.dumps([{"gram": g, **dict(zip(names, w, strict=True))} for g, w in model.weights.items()])
    kind = "array<struct<gram:string," + ",".join(f"{n}:double" for n in names) + ">>"
    weights = spark.range(1).select(F.explode(F.from_json(F.lit(entries), kind)).alias("w")).select("w.*")
    summed = grams.join(F.broadcast(weights), "gram").groupBy("row", "paragraph", "line").agg(*(F.sum(n).alias(n) for n in names))
    logits = F.array(*((F.col(n) + F.lit(b)) / F.lit(model.temperature) for n, b in zip(names, model.bias, strict=True)))
    highest = F.array_max("z")
    scored = summed.select("row", "paragraph", "line", logits.alias("z")).select(
        "row",
        "paragraph",
        "line",
        F.element_at(F.array(*map(F.lit, model.families)), F.array_position("z", highest).cast("int")).alias("family"),
        (1 / F.aggregate(F.transform("z", lambda x: F.exp(x - highest)), F.lit(0.0), lambda a, x: a + x)).alias("probability"),
    )
    likely = scored.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= THRESHOLD))
    found = likely.join(words, ["row", "paragraph", "line"]).filter(_confirmed(F.col("common"), F.col("family")))
    last = F.max("line").over(Window.partitionBy("row", "paragraph", "family"))
    return found.withColumn("last", last).filter("line >= 0 or last < 0").select("row", "paragraph", "line", "family", "probability")


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, n_notices, families, best_probability) per row of ``docs`` (doc_id, text).

    families are sorted and comma-joined, '' where there is no notice. A null
    text counts as empty. Repeated rows stay repeated; an empty table gives an
    empty result. Other columns are ignored. Very long texts are read whole.
    """
    found = classify_paragraphs(docs, model).groupBy("row").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("best_probability"))
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"))
    return rows.join(found, "row", "left").select("doc_id", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("best_probability", F.lit(0.0)).alias("best_probability"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))

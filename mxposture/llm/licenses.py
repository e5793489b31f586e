"""Licence notices: a trained paragraph classifier over word n-grams, confirmed by templates.

Training. Each family has short notices (``NOTICES``). Its examples are the notices alone, with a
lead-in, and without their first or last words; the unknown class gets paragraphs of the corpus that
share no more than a few n-grams with any notice (at most ``BACKGROUND``, picked by hash). A
multinomial logistic regression is fitted on the bigrams and trigrams that notices contain. A third
of the examples is held out: on it one temperature is fitted to the probabilities, and the least
probability that counts is set so that at most ``FALSE_RATE`` of the held-out unknown paragraphs
reach it.

Scoring. Paragraphs (lines) are cut into words, their n-grams joined with the weights, a table
bounded by the notices, and the sums turned into probabilities. A prediction is confirmed when
at least ``CONFIRMED`` of a notice's n-grams stand in the paragraph.

All of it is DataFrame functions; the fit is Spark ML's on the bounded sample.

Cases: a null or empty text has no paragraphs. Words are runs of ASCII letters and digits,
lower-cased; a paragraph with fewer than two has no n-gram and is unknown. Rows with equal ids give
rows of their own. No documents: an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.llm.common import empty_text, settled

BACKGROUND = 4000
FALSE_RATE = 0.001
CONFIRMED = 0.5
UNKNOWN = "unknown"

#: How the notices of common licences read.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the 3-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ],
    "reserved": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
LEADS = ["", "This file is part of the project.", "Text:", "Note."]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column) -> Column:
    """Hashes of the distinct word bigrams and trigrams."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
        grams = F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(tokens, i - 1 + k) for k in range(n)]))
        return F.coalesce(grams, F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(of(2), of(3)))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, grams): the n-grams of every notice."""
    rows = [(family, k, text) for family, texts in NOTICES.items() for k, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "family string, notice int, text string")
    return table.select("family", "notice", "text", ngrams(words(F.col("text"))).alias("grams"))


def paragraphs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``paragraph`` (from 0) and its ``tokens``; lines without words are left out."""
    lines = docs.select(*keep, F.posexplode(F.split(empty_text(text), "\n")).alias("paragraph", "line"))
    found = lines.select(*keep, "paragraph", words(F.col("line")).alias("tokens"))
    return found.where(F.size("tokens") > 1)


class Classifier:
    """Weights per n-gram and family, temperature and least probability."""

    def __init__(self, families, weights, intercepts, temperature, least):
        self.families, self.weights, self.intercepts = families, weights, intercepts
        self.temperature, self.least = temperature, least


def train(docs: DataFrame, text: str = "text", background: int = BACKGROUND, seed: int = 5) -> Classifier:
    spark = docs.sparkSession
    known = settled(notices(spark))
    grams = sorted(r["gram"] for r in known.select(F.explode("grams").alias("gram")).distinct().collect())
    vocabulary_ = F.array(*map(F.lit, grams))
    texts = known.select("family", F.explode(F.array(*map(F.lit, LEADS))).alias("lead"), "text")
    tokens = words(F.concat_ws(" ", "lead", "text"))
    whole = texts.select("family", tokens.alias("tokens"))
    n = F.size("tokens")
    parts = F.array(
        F.col("tokens"),
        F.slice("tokens", F.lit(2), F.greatest(n - 1, F.lit(1))),
        F.slice("tokens", F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.slice("tokens", F.lit(1), F.greatest(F.floor(n * 2 / 3).cast("int"), F.lit(2))),
    )
    examples = whole.select("family", F.explode(parts).alias("tokens")).select(
        "family", F.array_intersect(ngrams(F.col("tokens")), vocabulary_).alias("grams")
    ).where(F.size("grams") > 0)
    # As many documents as give enough paragraphs, by hash, so the order below sees a bounded table.
    share = min(1.0, 2.0 * background / max(1, docs.count()))
    picked = F.pmod(F.xxhash64(F.lit(seed), empty_text(text)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    unknown = (
        paragraphs(docs.where(picked), [], text)
        .select("tokens", F.xxhash64(F.lit(seed), "tokens").alias("order"))
        .select("order", F.array_intersect(ngrams(F.col("tokens")), vocabulary_).alias("grams"))
        .dropDuplicates(["order"])
        .where(F.size("grams") < 4)
        .orderBy("order")
        .limit(background)
        .select(F.lit(UNKNOWN).alias("family"), "grams")
    )
    families = [UNKNOWN, *NOTICES]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    present = F.transform(vocabulary_, lambda g: F.array_contains("grams", g).cast("double"))
    rows = examples.unionAll(unknown).select(
        label.cast("double").alias("label"),
        array_to_vector(present).alias("features"),
        (F.pmod(F.xxhash64(F.lit(seed), "family", "grams"), F.lit(3)) == 0).alias("held"),
    )
    rows = settled(rows)
    share = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    fit = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, weightCol="weight")
    # Families are rare beside the unknown class: each class weighs the same in the fit.
    weighed = rows.where("not held").join(share, "label").withColumn("weight", 100.0 / F.col("n"))
    model = fit.fit(weighed)
    matrix = model.coefficientMatrix.toArray()
    present_labels = range(matrix.shape[0])
    weights = [(g, [float(matrix[k][i]) for k in present_labels]) for i, g in enumerate(grams)]
    intercepts = [float(x) for x in model.interceptVector.toArray()]
    # The prior of the unknown class in the corpus is larger than in the balanced fit; the least
    # probability below takes that up.
    held = model.transform(rows.where("held")).select("label", "rawPrediction").collect()
    raw = [(int(r["label"]), [float(v) for v in r["rawPrediction"]]) for r in held]
    temperature = min(
        (0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: sum(-math.log(max(softmax(v, t)[k], 1e-12)) for k, v in raw)
    )
    wrong = sorted((1 - softmax(v, temperature)[0] for k, v in raw if k == 0), reverse=True)
    allowed = int(FALSE_RATE * len(wrong))
    least = max(0.5, wrong[allowed] + 1e-9 if len(wrong) > allowed else 0.5)
    return Classifier(families, weights, intercepts, temperature, least)


def softmax(values: list[float], temperature: float) -> list[float]:
    top = max(values)
    powers = [math.exp((v - top) / temperature) for v in values]
    return [p / sum(powers) for p in powers]


def scanned(docs: DataFrame, keep: list[str], text: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """``keep``, paragraph, family, probability, containment and confirmed of the predicted notices."""
    spark = docs.sparkSession
    classifier = classifier or train(docs, text)
    k = len(classifier.intercepts)
    weights = spark.createDataFrame(classifier.weights, "gram long, weights array<double>")
    per_notice = notices(spark).select("family", "notice", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    in_notices = per_notice.groupBy("gram").agg(
        F.collect_list(F.struct("family", "notice", "n")).alias("notices")
    )
    # The table is as large as the notices above, whatever the corpus.
    table = F.broadcast(weights.join(in_notices, "gram"))
    row = [F.monotonically_increasing_id().alias("_row")]
    lines = paragraphs(docs, keep, text).select(*keep, "paragraph", "tokens", *row)
    grams = lines.select(*keep, "paragraph", "_row", F.explode(ngrams(F.col("tokens"))).alias("gram"))
    hits = grams.join(table, "gram")
    own = [*keep, "paragraph", "_row"]
    sums = [F.sum(F.col("weights")[i]).alias(f"_w{i}") for i in range(k)]
    found = hits.groupBy(*own).agg(*sums, F.collect_list("notices").alias("_notices"))
    logits = F.array(*[F.col(f"_w{i}") + F.lit(classifier.intercepts[i]) for i in range(k)])
    scored = found.select(*own, "_notices", logits.alias("_logits"))
    top = F.array_max("_logits")
    powers = F.transform("_logits", lambda v: F.exp((v - top) / classifier.temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    shares = scored.select(*own, "_notices", F.transform(powers, lambda v: v / total).alias("_p"))
    best = F.array_max(F.slice("_p", 2, k - 1))
    place = F.array_position("_p", best).cast("int")
    named = shares.select(
        *own,
        "_notices",
        F.element_at(F.array(*map(F.lit, classifier.families[:k])), place).alias("family"),
        best.alias("probability"),
    ).where(F.col("probability") >= classifier.least)
    own_hits = F.filter(F.flatten("_notices"), lambda x: x["family"] == F.col("family"))
    kinds = F.array_distinct(own_hits)
    contained = F.array_max(
        F.transform(kinds, lambda x: F.size(F.filter(own_hits, lambda y: y["notice"] == x["notice"])) / x["n"])
    )
    return named.select(
        *keep,
        "paragraph",
        "family",
        "probability",
        F.coalesce(contained, F.lit(0.0)).alias("containment"),
        F.coalesce(contained >= CONFIRMED, F.lit(False)).alias("confirmed"),
    )

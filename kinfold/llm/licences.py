"""Licence scans: a trained paragraph classifier, made of DataFrame and SQL functions only.

Paragraphs are lines and, so that wrapped notices are seen whole, runs of 2 to
RUN_LINES adjacent lines without a blank one in between, where a licence word
(LICENCE_WORDS) occurs. Their word unigrams and bigrams are hashed into a sparse
vector, and a multinomial logistic regression tells the licence families, an
`unknown` licence class, and no licence. It is trained on the templates below,
varied by left-out and added words, on licence sentences of no family, and on a
bounded sample of paragraphs of the corpus itself (those of SAMPLE_DOCS
documents) as no licence.

A prediction is confirmed by template comparison: the share of a template's
words that the paragraph holds. A line that resembles no template is an
`unknown` licence if it holds a licence word and the classifier is sure
(UNLISTED). Runs must hold LEAST_OVERLAP of a template. The probability under
which a family becomes `unknown` is calibrated on variants that are kept out of
the training.

Of paragraphs that share lines one is reported: families before `unknown`, then
the larger overlap, then the fewer lines. A run is numbered by its first line.

Edge cases: null or empty texts have no paragraphs that are licences; repeated
rows and paragraphs are reported each; ties in probability go to the smaller
family name; a null doc_id is reported as null; texts are read whole, however
long; an empty table gives no rows. Other columns than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import hash_sample, materialize

NONE, UNKNOWN = "none", "unknown"
SLOTS = 16384
SAMPLE_DOCS = 300
SAMPLE_LINES = 2000
VARIANTS = 24
LEAST_OVERLAP = 0.6
#: What an unknown licence must share with some template.
UNKNOWN_OVERLAP = 0.4
#: The probability of a licence from which a line with a licence word needs no template.
UNLISTED = 0.8
#: Lines of a wrapped notice: the longest template (236 characters) at 40 columns has 6.
RUN_LINES = 8
#: Words that notices have and other prose hardly has. Corpus lines with one are no training examples of no licence.
LICENCE_WORDS = r"(?i)\b(licen[cs]\w*|copyright\w*|(un)?copyrighted|rights|redistribut\w*|permission|permitted|unencumbered|gnu|gpl\w*|cc0|warrant(y|ies))\b|spdx|public domain|\b(source code form|free software)\b"

# Short public notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Distributed under the terms of the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
    UNKNOWN: [
        "Licensed under the terms of the vendor agreement.",
        "This software is licensed, not sold, under the terms of the enclosed agreement.",
        "Use of this material is governed by the community licence, version 7.",
        "Licensed under the Example Public Licence.",
        "Released under a permissive licence; see the file COPYING.",
        "This work is licensed under terms described elsewhere.",
    ],
    NONE: [
        "He renewed his driving license last week and drove home.",
        "The public was released from the building at noon.",
        "Version 2.0 of the report is out, and version 3 is under way.",
        "All seats were reserved, and the rights of guests were read out.",
        "The general store under the bridge sells work clothes.",
        "Copy the file and use the work as a source of notes.",
    ],
}


def _template_words(text: str) -> Column:
    """The distinct words of a template, as a constant of the plan."""
    return F.array(*[F.lit(w) for w in dict.fromkeys(re.split(r"[^0-9a-z.-]+", text.lower())) if w])


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.-]+"), lambda w: w != "")


def grams(w: Column) -> Column:
    """Unigrams and bigrams."""

    def both(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit("$"))))
        return F.concat(w, pairs)

    # Bound by a lambda: a filter on what follows is pushed below the words, which are then split once, not for each use.
    return F.element_at(F.transform(F.array(w), both), 1)


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), para: every line with a letter or digit."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "para"))
    return lines.where(F.col("para").rlike(r"[\p{L}\p{N}]"))


def runs(documents: DataFrame) -> DataFrame:
    """row, doc_id, paragraph, lines, para: every line as in paragraphs(), and the runs of lines that may be a wrapped notice."""
    item = lambda i, n, para: F.struct(i.alias("paragraph"), F.lit(n).alias("lines"), para.alias("para"))

    def every(lines: Column) -> Column:
        single = F.transform(lines, lambda x, i: item(i, 1, x))
        joined = lambda n: F.transform(lines, lambda x, i: item(i, n, F.array_join(F.slice(lines, i + 1, n), "\n")))
        whole = F.concat(*[F.slice(joined(n), 1, F.greatest(F.size(lines) - n + 1, F.lit(0))) for n in range(2, RUN_LINES + 1)])
        wrapped = F.filter(whole, lambda x: x["para"].rlike(LICENCE_WORDS) & ~x["para"].rlike(r"(?:^|\n)[^\p{L}\p{N}\n]*(?:\n|$)"))
        return F.when(F.exists(lines, lambda x: x.rlike(LICENCE_WORDS)), F.concat(single, wrapped)).otherwise(single)

    # Bound by a lambda, so that the text is split once.
    bound = F.element_at(F.transform(F.array(F.split(F.coalesce("text", F.lit("")), "\n")), every), 1)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").select("row", "doc_id", F.inline(bound))
    return rows.where(F.col("para").rlike(r"[\p{L}\p{N}]"))


def _templates(spark: SparkSession) -> DataFrame:
    """class, template, para: one row for each template, from constants of the plan."""
    rows = [(c, k, t) for c, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    all_rows = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(k).alias("template"), F.lit(t).alias("para")) for c, k, t in rows])
    return spark.range(1).select(F.inline(all_rows))


def training_rows(documents: DataFrame) -> DataFrame:
    """class, fold (0: kept out), w: words of the training paragraphs."""
    spark = documents.sparkSession
    varied = _templates(spark).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    keep = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(10)) > 0
    w = words(F.col("para"))
    # Variant 0 is whole; the others lose a tenth of their words, every third one gets strange words around it.
    noise = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.substring(F.md5(F.concat_ws(":", F.col("variant"), i, "para")), 1, 5))
    some = F.when(F.col("variant") == 0, w).when(F.col("variant") % 3 == 1, F.concat(F.slice(noise, 1, 3), w, F.slice(noise, 4, 3))).otherwise(F.filter(w, keep))
    known = varied.select("class", (F.pmod(F.xxhash64("para", "variant"), F.lit(5)) > 0).cast("int").alias("fold"), some.alias("w"))
    # A threshold by the count leaves about 1.5 * SAMPLE_DOCS texts, of which the smallest hashes are taken.
    rows = documents.select("doc_id", "text").where("text IS NOT NULL")
    chosen = hash_sample(rows, rows.count(), SAMPLE_DOCS, "doc_id", "text").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(SAMPLE_DOCS)
    lines = paragraphs(chosen).where(~F.col("para").rlike(LICENCE_WORDS))
    chosen = lines.orderBy(F.xxhash64("doc_id", "paragraph"), "doc_id", "paragraph").limit(SAMPLE_LINES)
    other = materialize(chosen.select(words(F.col("para")).alias("w")), "licence-sample")
    templates = F.array(*[_template_words(t) for c, ts in TEMPLATES.items() if c != NONE for t in ts])
    other = other.where(~F.exists(templates, lambda t: _overlap(F.col("w"), t) >= LEAST_OVERLAP))
    return known.unionByName(other.select(F.lit(NONE).alias("class"), F.lit(1).alias("fold"), "w")).where(F.size("w") > 0)


def _overlap(w: Column, template: Column) -> Column:
    """Share of the template's distinct words that are in `w`."""
    return F.size(F.array_intersect(template, w)) / F.greatest(F.size(F.array_distinct(template)), F.lit(1))


@dataclass
class Scanner:
    hashing: HashingTF
    model: Any
    classes: list[str]
    floor: float

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """`rows` (with w) and p: the probabilities of `classes`."""
        hashed = self.hashing.transform(rows.withColumn("grams", grams(F.col("w"))))
        return self.model.transform(hashed).withColumn("p", vector_to_array("probability")).drop("grams", "features", "rawPrediction", "probability", "prediction")


def train(documents: DataFrame) -> Scanner:
    classes = sorted(TEMPLATES)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=SLOTS, binary=True)
    rows = training_rows(documents).withColumn("grams", grams(F.col("w"))).withColumn("label", number.cast("double"))
    rows = materialize(rows.select("fold", "label", "w", "grams"), "licence-training")
    rows = hashing.transform(rows)
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40)
    # A bounded sample of a few thousand rows; more partitions would only add tasks to each iteration.
    fitted = regression.fit(rows.where("fold = 1").select("label", "features").coalesce(2))
    scanner = Scanner(hashing, fitted, classes, 0.5)
    # Calibration: of the kept-out family variants that are told rightly, all but one in a hundred reach the floor.
    out = scanner.probabilities(rows.where("fold = 0").select("label", "w"))
    right = out.select(F.element_at("p", F.col("label").cast("int") + 1).alias("own"), F.array_max("p").alias("best"), "label").where(F.col("own") == F.col("best"))
    right = right.where(~F.col("label").isin(float(classes.index(NONE)), float(classes.index(UNKNOWN))))
    low = right.agg(F.percentile("own", F.lit(0.01))).first()[0]
    scanner.floor = max(0.3, min(0.9, low if low is not None else 0.5))
    return scanner


def scan(documents: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap of every paragraph that is a licence."""
    scanner = scanner or train(documents)
    classes = scanner.classes
    none, unknown = classes.index(NONE) + 1, classes.index(UNKNOWN) + 1
    rows = scanner.probabilities(runs(documents).withColumn("w", words(F.col("para"))).withColumn("worded", F.col("para").rlike(LICENCE_WORDS)).drop("para"))
    # The few paragraphs that are licences are written out, so that the model runs once on each paragraph.
    found = materialize(rows.where(F.element_at("p", none) < 0.5).select("row", "doc_id", "paragraph", "lines", "worded", "w", "p"), "licences")
    families = [c for c in classes if c not in (NONE, UNKNOWN)]
    each = F.array(*[F.struct(F.element_at("p", classes.index(c) + 1).alias("p"), F.lit(-k).alias("order"), F.lit(c).alias("family"), F.array(*[_template_words(t) for t in TEMPLATES[c]]).alias("templates")) for k, c in enumerate(families)])
    best = found.withColumn("best", F.array_max(F.transform(each, lambda x: F.struct(x["p"].alias("p"), x["order"].alias("order"), x["family"].alias("family"), F.array_max(F.transform(x["templates"], lambda t: _overlap(F.col("w"), t))).alias("overlap")))))
    likeness = F.array(*[_template_words(t) for c, ts in TEMPLATES.items() if c != NONE for t in ts])
    best = best.withColumn("any_overlap", F.array_max(F.transform(likeness, lambda t: _overlap(F.col("w"), t))))
    sure = (F.col("best.p") >= scanner.floor) & (F.col("best.overlap") >= LEAST_OVERLAP) & (F.col("best.p") >= F.element_at("p", unknown))
    line = (F.col("any_overlap") >= UNKNOWN_OVERLAP) | (F.col("worded") & (1 - F.element_at("p", none) >= UNLISTED))
    told = best.where(sure | F.when(F.col("lines") == 1, line).otherwise(F.col("any_overlap") >= LEAST_OVERLAP)).select(
        "row", "doc_id", F.struct(
            (~sure).alias("unsure"), (-F.when(sure, F.col("best.overlap")).otherwise(F.col("any_overlap"))).alias("order"), "lines", F.col("paragraph").cast("int").alias("paragraph"),
            F.when(sure, F.col("best.family")).otherwise(UNKNOWN).alias("family"), F.round(F.when(sure, F.col("best.p")).otherwise(1 - F.element_at("p", none)), 4).alias("probability"), F.round("best.overlap", 4).alias("overlap"),
        ).alias("item"),
    )
    apart = lambda x, y: (x["paragraph"] + x["lines"] <= y["paragraph"]) | (y["paragraph"] + y["lines"] <= x["paragraph"])
    items = told.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("item")).alias("items"))
    # A line that is sure by itself needs no run around it.
    alone = F.filter("items", lambda x: (x["lines"] == 1) & ~x["unsure"])
    items = items.withColumn("alone", alone).withColumn("items", F.filter("items", lambda x: (x["lines"] == 1) | ~F.exists("alone", lambda y: (y["family"] == x["family"]) & ~apart(x, y))))
    none_yet = F.filter("items", lambda x: F.lit(False))
    taken = F.aggregate("items", none_yet, lambda seen, x: F.when(F.exists(seen, lambda y: ~apart(x, y)), seen).otherwise(F.concat(seen, F.array(x))))
    return items.select("doc_id", F.inline(taken)).select("doc_id", "paragraph", "family", "probability", "overlap")

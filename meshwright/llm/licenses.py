"""Licence scans by a trained paragraph classifier, in DataFrame functions and Spark's own estimators only.

A text's paragraphs are its lines, where lines of at most WRAPPED characters that follow each other are one: hard-wrapped notices
are read whole, with or without comment marks, whatever their line ends. The words and word pairs of every paragraph are hashed into a sparse vector, and multinomial logistic regression gives the probabilities of no
licence, a licence of unknown family, or one of the families below. The classifier is trained in the job: on the notices, alone and set into at most MOST_SAMPLES paragraphs
drawn from the corpus, and on drawn paragraphs alone; further wordings of the families, which are no templates, are kept back with
a part of these rows to fit the temperature that calibrates the probabilities. A family that gets less than LEAST_PROBABILITY, or
whose notices share too few word pairs with the paragraph, becomes unknown: the comparison with the templates has to confirm a
prediction, with the words and the version that set a family apart from its siblings. The two BSD licences share most of their text: where a document
has the clause on binary forms, its licence is the one of three clauses only if a paragraph says what the other does not.

Defined cases: a null or empty text has no licence; of several licences in a text the most probable one is given, ties by name;
repeated rows are each scanned; a null identity is kept; a very long line is one paragraph; extra columns are dropped; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty, write_table

#: Notices by which works state their licence, and texts of short licences.
NOTICES = {
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "under the GNU Affero General Public License version 3",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is distributed under the Apache License 2.0.",
        'Unless required by applicable law or agreed to in writing, software distributed under the Apache License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. Version 2.0',
    ),
    "bsd-2-clause": (
        "Released under the BSD 2-Clause License.",
        "This project is licensed under the simplified BSD 2-Clause license.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0 Universal.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "under the GNU General Public License version 2",
        "Licensed under the GPLv2.",
        "Licensed under the GPL v2.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "under the GNU General Public License version 3",
        "Licensed under the GPLv3.",
        "Licensed under the GPL v3.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "under the GNU Lesser General Public License version 3",
    ),
    "mit": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "mpl-2.0": (
        "Released under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unknown": (
        "All rights reserved.",
        "Licensed under the terms of the agreement that accompanies this work.",
        "This software is proprietary and may be used under a commercial license only.",
        "Released under a custom license; see the file LICENSE for its terms.",
        "You may copy and share this work under the conditions of its license.",
        "Licensed under CC BY 3.0.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This program is made available under the terms of the Eclipse Public License 2.0.",
        "This is free and unencumbered software released into the public domain.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under the Artistic License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: A line that names a family by its identifier is a notice too.
for _family in sorted(set(NOTICES) - {"unknown"}):
    NOTICES[_family] += (f"SPDX-License-Identifier: {_family}",)
#: Other wordings of the families, which the classifier is not trained on and nothing is compared with. They fit the temperature.
FURTHER = {
    "agpl-3.0": "Available under the GNU Affero General Public License version 3 or later.",
    "apache-2.0": "This file is made available under version 2.0 of the Apache License.",
    "bsd-2-clause": "Use of this code is governed by the BSD 2-Clause license.",
    "bsd-3-clause": "Use of this source code is governed by the BSD 3-Clause license that can be found in the LICENSE file.",
    "cc-by-4.0": "Text is available under the Creative Commons Attribution 4.0 license.",
    "cc-by-nc-4.0": "Text is available under the Creative Commons Attribution-NonCommercial 4.0 license.",
    "cc-by-sa-4.0": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 license.",
    "cc0-1.0": "The text is dedicated to the public domain under CC0 1.0.",
    "gpl-2.0": "Distributed under the terms of the GNU General Public License version 2.",
    "gpl-3.0": "Distributed under the terms of the GNU General Public License version 3.",
    "isc": "Distributed under the terms of the ISC license.",
    "lgpl-3.0": "Distributed under the terms of the GNU Lesser General Public License version 3.",
    "mit": "Distributed under the terms of the MIT license.",
    "mpl-2.0": "Distributed under the terms of the Mozilla Public License version 2.0.",
    "unknown": "This work is subject to a license agreement.",
}
NONE, UNKNOWN = "none", "unknown"
CLASSES = (NONE, *sorted(NOTICES))
#: Paragraphs of ordinary prose, so that the class of no licence is never empty.
PROSE = ("The morning was clear and the road ran along the river.", "Results of the second series are given below.", "She asked for the version with the red cover.")
#: Characters of a line up to which it may be a part of a hard-wrapped paragraph.
WRAPPED = 100
MOST_SAMPLES = 4000
EVERY = 4
DIMENSIONS = 1 << 15
LEAST_PROBABILITY = 0.5
#: A paragraph with one of these words states an unknown licence if no licence is improbable; one without must be SURE_UNKNOWN.
TOPIC = ("copyright", "licence", "licenced", "licences", "license", "licensed", "licenses", "licensing", "proprietary", "rights")
SURE_UNKNOWN = 0.9
#: A paragraph states a licence if no licence is less probable than this.
MOST_NONE = 0.05
#: Share of a notice's word pairs that a paragraph must hold to confirm it.
LEAST_SHARED = 0.75
#: Word pairs by which a notice differs from those of sibling licences and other versions. A paragraph must hold all that are in the notice.
DISTINCT = frozenset(
    (
        "affero general", "gnu affero", "gnu lesser", "lesser general", "gnu general", "version 2", "version 3", "apache license", "2 0", "v 2", "mozilla public", "4 0", "by 4", "by nc", "nc 4", "by sa", "sa 4",
        "attribution 4", "attribution noncommercial", "noncommercial 4", "attribution sharealike", "sharealike 4", "cc0 1", "bsd 2", "bsd 3", "2 clause", "3 clause", "mit license", "isc license", "the gplv2", "the gplv3", "gpl v2", "gpl v3",
    )
)
#: Word pairs of the clause that both BSD licences have after the one they begin with, and of the one that only the longer has.
BINARY_CLAUSE, ENDORSE_CLAUSE = ("in binary", "binary form", "must reproduce"), ("neither the", "to endorse", "or promote", "promote products")
#: Tasks that the classifier is fitted by: each sends the driver 4 MB of sums for every step, and its rows are bounded.
FIT_TASKS = 2
TEMPERATURES = (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def notice_pairs(notice: str) -> list[str]:
    import re

    found = [w for w in re.split("[^a-z0-9]+", notice.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def paragraphs(text: Column) -> Column:
    """The text's paragraphs: short lines that follow each other joined, comment marks at their starts left out."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?md)^[ \t]*(?:(?:#+|//+|/?\*+/?|;+|--+|>+)[ \t]?)?[ \t]*$|^[ \t]*(?:#+|//+|/?\*+/?|;+|--+|>+)[ \t]?", "")
    joined = F.regexp_replace(plain, rf"(?md)^([^\n]{{1,{WRAPPED}}})\n(?=[^\n]{{1,{WRAPPED}}}$)", "$1 ")
    return F.filter(F.split(joined, "\n"), lambda p: F.length(F.trim(p)) > 0)


def with_grams(paragraphs: DataFrame, text: str = "paragraph") -> DataFrame:
    """paragraphs with the columns pairs and grams (words and word pairs)."""
    worded = paragraphs.withColumn("words", words(F.col(text)))
    return NGram(n=2, inputCol="words", outputCol="pairs").transform(worded).withColumn("grams", F.concat("words", "pairs")).drop("words")


def vectors(grams: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="grams", outputCol="features").transform(grams)


def telling(notice: str) -> list[str]:
    """The pairs of a notice that a paragraph must hold: those that are DISTINCT, or all of an identifier's line."""
    own = notice_pairs(notice)
    return own if "license identifier" in own else sorted(DISTINCT.intersection(own))


def shared_with(family: str, pairs: Column, distinct: bool = False) -> Column:
    """The greatest share of a notice's word pairs that are in pairs, over the family's notices; if distinct, of those whose DISTINCT pairs are all there."""
    shares = []
    for notice in NOTICES[family]:
        own = notice_pairs(notice)
        share = F.size(F.array_intersect(pairs, F.array(*map(F.lit, own)))) / float(len(own))
        for pair in telling(notice) if distinct else ():
            share = F.when(F.array_contains(pairs, pair), share).otherwise(0.0)
        shares.append(share)
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def training_rows(docs: DataFrame, text: str) -> DataFrame:
    """paragraph, label (number of its class), kept_back. At most MOST_SAMPLES paragraphs of the corpus take part."""
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, 4 * MOST_SAMPLES / max(n, 1))
    drawn = docs.select(text_or_empty(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20)))
    lines = drawn.distinct().select(F.explode(paragraphs(F.col("t"))).alias("paragraph")).where("length(paragraph) BETWEEN 1 AND 4000").distinct()
    picked = lines.orderBy(F.xxhash64("paragraph")).limit(MOST_SAMPLES)
    notices = [(CLASSES.index(f), t) for f, ts in sorted(NOTICES.items()) for t in ts]
    further = [(CLASSES.index(f), t) for f, t in sorted(FURTHER.items())]
    stated = spark.createDataFrame([(i, *x, i >= len(notices)) for i, x in enumerate(notices + further)], "k int, label int, notice string, further boolean")
    own = with_grams(picked)
    clean = own.where(F.greatest(*[shared_with(f, F.col("pairs")) for f in sorted(NOTICES)]) < 0.5).select("paragraph")
    # one in EVERY gets a notice before, after or in the middle, the others stay as they are
    dealt = clean.withColumn("k", F.pmod(F.xxhash64(F.lit("deal"), "paragraph"), F.lit(EVERY * (len(notices) + len(further)))).cast("int"))
    mixed = dealt.join(F.broadcast(stated), "k", "left")
    place = F.pmod(F.xxhash64(F.lit("place"), "paragraph"), F.lit(3))
    front, back = F.expr("substring(paragraph, 1, CAST(length(paragraph) / 2 AS INT))"), F.expr("substring(paragraph, CAST(length(paragraph) / 2 AS INT) + 1)")
    joined = F.when(F.col("notice").isNull(), F.col("paragraph")).when(place == 0, F.concat_ws(" ", "notice", "paragraph")).when(place == 1, F.concat_ws(" ", "paragraph", "notice")).otherwise(F.concat_ws(" ", front, "notice", back))
    # further wordings only ever calibrate, notices only ever train; of the paragraphs without either, a quarter calibrates
    held = F.when(F.col("notice").isNull(), F.pmod(F.xxhash64(F.lit("kept"), "paragraph"), F.lit(4)) == 0).otherwise(F.col("further"))
    built = mixed.select(joined.alias("paragraph"), F.coalesce("label", F.lit(0)).alias("label"), held.alias("kept_back"))
    alone = [(t, i, False) for i, t in notices for _ in range(8)] + [(t, 0, False) for t in PROSE] + [(t, i, True) for i, t in further]
    plain = spark.createDataFrame(alone, "paragraph string, label int, kept_back boolean")
    return built.unionByName(plain).withColumn("label", F.col("label").cast("double"))


def softmax(raw: Column, temperature: float) -> Column:
    scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scaled, lambda x: x / total)


def rows_to_fit(rows: DataFrame) -> DataFrame:
    """The rows that are not kept back, in so few tasks that the sums of a step are not shuffled and the driver holds few of them."""
    return rows.where(~F.col("kept_back")).coalesce(FIT_TASKS)


def train(docs: DataFrame, text: str = "text") -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the temperature that fits its probabilities to rows it was not trained on."""
    stated = write_table(training_rows(docs, text), "licence-paragraphs").repartition(4)
    rows = write_table(vectors(with_grams(stated)).select("features", "label", "kept_back"), "licence-training")
    fit = rows_to_fit(rows)
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=3e-5, featuresCol="features", labelCol="label").fit(fit)
    scored = model.transform(rows.where("kept_back")).select(vector_to_array("rawPrediction").alias("raw"), "label")
    losses = scored.agg(*[F.avg(-F.ln(F.greatest(F.element_at(softmax(F.col("raw"), t), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, i))
    return model, TEMPERATURES[best]


def scan(docs: DataFrame, identity: str = "doc_id", text: str = "text", trained: tuple[LogisticRegressionModel, float] | None = None) -> DataFrame:
    """identity, license (a family, unknown or none), probability, confirmed, paragraphs (that state a licence) of each row."""
    model, temperature = trained or train(docs, text)
    names = F.array(*map(F.lit, CLASSES))
    numbered = docs.select(F.col(identity).alias("id"), text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    lines = numbered.select("id", "row", F.explode_outer(paragraphs(F.col("text"))).alias("paragraph")).withColumn("paragraph", F.coalesce("paragraph", F.lit("")))
    raw = model.transform(vectors(with_grams(lines))).select("id", "row", "pairs", "grams", vector_to_array("rawPrediction").alias("raw"))
    guess = F.array_position(F.col("raw"), F.array_max("raw")).cast("int")
    scored = raw.select("id", "row", "pairs", "grams", softmax(F.col("raw"), temperature).alias("p"), guess.alias("guess"))
    family = F.element_at(names, F.col("guess"))
    shared = F.lit(0.0)
    for f in sorted(NOTICES):
        shared = F.when(family == f, shared_with(f, F.col("pairs"), distinct=True)).otherwise(shared)
    unlikely = ~F.arrays_overlap("grams", F.array(*map(F.lit, TOPIC))) & (F.element_at("p", CLASSES.index(UNKNOWN) + 1) < SURE_UNKNOWN)
    holds = lambda pairs: F.forall(F.array(*map(F.lit, pairs)), lambda x: F.array_contains("pairs", x))
    judged = scored.select("id", "row", family.alias("family"), F.element_at("p", F.col("guess")).alias("probability"), shared.alias("shared"), ((F.element_at("p", 1) >= MOST_NONE) | unlikely).alias("nothing"), holds(BINARY_CLAUSE).alias("binary"), (holds(ENDORSE_CLAUSE) | F.array_contains("pairs", "3 clause")).alias("third"))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("shared") >= LEAST_SHARED)
    stated = judged.select("id", "row", F.when((F.col("family") == NONE) | F.col("nothing") & ~sure, None).when(sure, F.col("family")).otherwise(UNKNOWN).alias("license"), F.round("probability", 3).alias("probability"), sure.alias("confirmed"), "binary", "third")
    # the most probable family that is confirmed, else unknown
    rank = F.when(F.col("license").isNotNull(), F.col("confirmed").cast("int") * 2 + F.col("probability"))
    named = stated.withColumn("rank", rank)
    best = named.groupBy("row").agg(
        F.first("id").alias(identity),
        F.coalesce(F.max_by("license", F.struct("rank", "license")), F.lit(NONE)).alias("license"),
        F.coalesce(F.max_by(F.when(F.col("rank").isNotNull(), F.col("probability")), F.struct("rank", "license")), F.lit(1.0)).alias("probability"),
        F.coalesce(F.bool_or(F.when(F.col("rank").isNotNull(), F.col("confirmed"))), F.lit(False)).alias("confirmed"),
        F.count("license").alias("paragraphs"),
        (F.bool_or("binary") & ~F.bool_or("third")).alias("two"),
    )
    license = F.when((F.col("license") == "bsd-3-clause") & F.col("two"), "bsd-2-clause").otherwise(F.col("license"))
    return best.withColumn("license", license).drop("row", "two")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, probability, confirmed, paragraphs of every document."""
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Paragraphs are the lines of a text, and lines that follow each other without a
blank one, joined; long ones in overlapping windows.  A sparse
logistic regression over hashed word unigrams and bigrams tells licence families
from one another and from other text.  It is trained on the templates below, each
with words left out and with other text around it, against a bounded sample of
the corpus's own paragraphs.  The unknown class is calibrated on all windows of
the corpus that no template confirms: a family must be likelier than all but one
in a thousand of them make it.  What passes is compared with the
family's templates, word pair by word pair, and is confirmed if it holds most of
one.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored, text_or_empty

#: Fixed texts by which licences are stated.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    ],
}
#: Sentences that only sound like licences.
DECOYS = [
    "She renewed her driving license at the office last week.", "The restaurant lost its liquor license.", "A licensed electrician must do the work.",
    "Poetic license is permitted here.", "All of the seats were reserved.", "The public library is free and open to any person.",
    "The general was a public figure.", "You can copy the file to another folder.", "Version 2.0 of the program was released in May.",
    "He studied at MIT and worked on software.", "The terms of the sale were published.", "All rights and duties are described in the contract.",
]
FAMILIES = ["unknown", *TEMPLATES]
HASHED, WINDOW, STEP = 8192, 64, 32
#: The share of a template that confirms.
CONFIRM = 0.6


def words(text: Column) -> Column:
    """Lower-case words; hyphens, full stops and pluses within a word belong to it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-.+][\p{L}\p{N}]+)*"), F.lit(0))


def numbers(w: Column) -> Column:
    """Words as 64-bit numbers, which take the place of the words from here on."""
    return F.transform(w, lambda a: F.xxhash64(a))


def pairs(w: Column) -> Column:
    """Each number with the next one, as one number."""
    less = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), less), F.slice(w, F.lit(2), less), lambda a, b: F.xxhash64(a, b))


def template_terms() -> Column:
    """A constant array of (family, terms): the different words and word pairs of each template, which are all in ASCII, as numbers."""
    number = lambda a: F.xxhash64(F.lit(a))
    rows = []
    for i, family in enumerate(FAMILIES):
        for text in TEMPLATES.get(family, []):
            w = re.findall(r"[a-z0-9]+(?:[-.+][a-z0-9]+)*", text.lower())
            both = dict.fromkeys(zip(w, w[1:], strict=False))
            terms = [number(a) for a in dict.fromkeys(w)] + [F.xxhash64(number(a), number(b)) for a, b in both]
            rows.append(F.struct(F.lit(i).alias("family"), F.array(*terms).alias("terms")))
    return F.array(*rows)


def _features(df: DataFrame) -> DataFrame:
    """``df`` (terms: numbers of words and word pairs) with the unit vector of its hashed terms."""
    counted = HashingTF(inputCol="terms", outputCol="counts", numFeatures=HASHED, binary=True).transform(df)
    return Normalizer(inputCol="counts", outputCol="features").transform(counted).drop("counts")


def windows(text: Column, with_pairs: bool = False) -> Column:
    """The windows of all lines of a text, then of all its paragraphs of more lines, as arrays of word numbers; up to WINDOW words are one.

    With ``with_pairs`` the numbers of a window's word pairs follow those of its words.
    A paragraph ends at a line without words, so comment marks don't join what blank comment lines part.
    """

    def cut(parts: Column) -> Column:
        def windows_of(x: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(x.w) - 1 - (WINDOW - STEP), F.lit(0)), F.lit(STEP))
            both = lambda s: F.concat(F.slice(x.w, s + 1, F.lit(WINDOW)), F.slice(x.p, s + 1, F.lit(WINDOW - 1)))
            return F.transform(starts, both if with_pairs else lambda s: F.slice(x.w, s + 1, F.lit(WINDOW)))

        paired = F.transform(parts, lambda w: F.struct(w.alias("w"), (pairs(w) if with_pairs else F.lit(None)).alias("p")))
        return F.flatten(F.transform(paired, windows_of))

    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda y: numbers(words(y))), lambda w: F.size(w) > 0)
    ends = F.regexp_replace(text, r"\r\n?", "\n")
    parts = F.transform(F.split(ends, r"\n[^\p{L}\p{N}]*\n"), lines)
    # words are cut out once, for lines and paragraphs
    found = lambda ps: F.concat(cut(F.flatten(ps)), cut(F.transform(F.filter(ps, lambda ls: F.size(ls) > 1), F.flatten)))
    return F.element_at(F.transform(F.array(parts), found), 1)


def _table(spark, rows: list[tuple[int, str]]) -> DataFrame:
    """Literal rows (label, text) without a detour over Python workers."""
    items = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in rows))
    return spark.range(1).select(F.explode(items).alias("r")).select("r.*")


class LicenceModel:
    """Fitted on the templates and on windows of other text of ``df``, calibrated on all windows of ``df``.

    Other text is a sample of ``sample_texts`` texts, picked by a hash of the id,
    and of each its first ``sample_windows`` windows.  The same table gives the
    same model.
    """

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_texts: int = 400, sample_windows: int = 20):
        spark = df.sparkSession
        id_ = F.col(f"`{id_col}`")
        picked = df.select(id_.alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_texts)
        texts = df.select(id_.alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"))
        other = texts.select(F.explode(F.slice(windows(F.col("text")), 1, sample_windows)).alias("w"))
        known = _table(spark, [(i, t) for i, f in enumerate(FAMILIES) for t in TEMPLATES.get(f, DECOYS)]).select("label", numbers(words(F.col("text"))).alias("w"))
        known = known.where(F.size("w") > 0)
        close = known.where("label > 0").select("w", "label")
        other = stored(other.where(self.confirmed(self.terms(F.col("w"))) < 0.5).select("w"), "licence-other")

        # a template with each word left out, its halves, and with ordinary words before and after it
        n = F.size("w")
        left_out = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, n - i)))
        variants = known.select("label", F.explode(F.concat(F.array("w"), left_out)).alias("w"))
        around = other.select(F.slice("w", 1, 12).alias("around"), F.pmod(F.hash("w"), F.lit(16)).alias("slot"))
        around = around.groupBy("slot").agg(F.min("around").alias("around"))
        slots = close.select("label", "w", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot"))
        within = slots.join(around, "slot").select("label", F.when(F.col("slot") % 2 == 0, F.concat("around", "w")).otherwise(F.concat("w", "around")).alias("w"))
        train = variants.union(within).union(other.select(F.lit(0).alias("label"), "w"))
        train = stored(train.where(F.size("w") > 0), "licence-training")
        share = train.groupBy("label").agg(F.count("*").alias("n"))
        weighed = train.join(share, "label").withColumn("weight", F.when(F.col("label") == 0, F.lit(1.0)).otherwise(F.lit(60.0) / F.col("n")))
        learner = LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", regParam=2e-4, maxIter=60)
        weighed = weighed.withColumn("label", F.col("label").cast("double")).withColumn("terms", self.terms(F.col("w")))
        self.model = learner.fit(_features(weighed))
        self.model.setPredictionCol("").setRawPredictionCol("")  # probabilities alone
        weights, bias = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        #: The most that a hashed term, and that the intercepts, put any family ahead of the unknown class.
        self.ahead, self.start = (weights[1:] - weights[0]).max(axis=0), float((bias[1:] - bias[0]).max())
        self.fitted_on = df, text_col, id_col
        self.told = stored(self._told(df, text_col, id_col), "licence-told")
        ordinary = self.told.where("real and (confirmed is null or confirmed < 0.5)")
        likely = ordinary.agg(F.percentile_approx("likely", F.lit(0.999), F.lit(100_000))).first()[0]
        self.threshold = max(0.5, likely or 0.0)

    def _told(self, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
        """A row a window, and one for a text without: doc_id, row, real, likely, family, and above the least threshold, 0.5, share and confirmed.

        A window below that ranks as ordinary whether a template confirms it or not;
        one that a bound shows to be below is 0 likely, and isn't hashed to a vector.
        """
        docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
        cut = docs.select("doc_id", "row", F.explode_outer(F.transform(windows(F.col("text"), with_pairs=True), self.kept)).alias("found"))
        told = self.classified(cut.select("doc_id", "row", F.col("found").isNotNull().alias("real"), F.coalesce("found", F.array().cast("array<bigint>")).alias("terms")))
        told = told.withColumn("likely", F.when(F.size("terms") > 0, F.col("likely")).otherwise(0.0))
        near = F.col("real") & (F.col("likely") >= 0.5)
        share, confirmed = F.when(near, self.share(F.col("terms"), F.col("family"))), F.when(near, self.confirmed(F.col("terms")))
        return told.select("doc_id", "row", "real", "likely", "family", share.alias("share"), confirmed.alias("confirmed"))

    def kept(self, terms: Column) -> Column:
        """``terms``, or none if no family can be likelier than the unknown class, hence half likely.

        A family's lead is the sum of its terms' leads, by the vector's length, and
        its intercept's; the bound takes the best family for each of them.  Terms
        are hashed as ``HashingTF`` does.
        """
        hashed = F.array_distinct(F.transform(terms, lambda a: F.pmod(F.hash(a), F.lit(HASHED))))
        ahead = F.lit(self.ahead)

        def bound(x):
            return F.aggregate(x, F.lit(0.0), lambda s, i: s + F.get(ahead, i)) / F.sqrt(F.size(x)) + self.start

        # hashed once; the margin is for sums in another order
        low = F.element_at(F.transform(F.array(hashed), bound), 1) < -1e-6
        return F.when(low, F.array().cast("array<bigint>")).otherwise(terms)

    def classified(self, df: DataFrame) -> DataFrame:
        """``df`` (terms) with family (number of the likeliest that isn't unknown) and likely (its probability)."""
        p = vector_to_array(F.col("probability"))
        told = self.model.transform(_features(df)).withColumn("p", F.slice(p, 2, len(FAMILIES) - 1)).drop("features", "probability")
        return told.withColumn("likely", F.array_max("p")).withColumn("family", F.array_position("p", F.col("likely")).cast("int")).drop("p")

    @staticmethod
    def terms(w: Column) -> Column:
        """Numbers of words and word pairs."""
        return F.concat(w, pairs(w))

    @staticmethod
    def confirmed(terms: Column) -> Column:
        """The largest share of a template of any family that ``terms`` holds."""
        return LicenceModel._largest(terms, template_terms())

    @staticmethod
    def share(terms: Column, family: Column) -> Column:
        """The largest share of a template of ``family`` whose words and word pairs are in ``terms``."""
        return LicenceModel._largest(terms, F.filter(template_terms(), lambda t: t.family == family))

    @staticmethod
    def _largest(terms: Column, own: Column) -> Column:
        def held(x):  # of the window, put together once for all templates
            return F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(x, t.terms)) / F.size(t.terms)))

        return F.coalesce(F.element_at(F.transform(F.array(terms), held), 1), F.lit(0.0))

    def scan(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """A row a document: doc_id, licence, likely, n_windows, n_found, families.

        ``licence`` is the family of the likeliest confirmed paragraph, 'none'
        without one; ``families`` are all confirmed families, and ``n_found`` the
        paragraphs that pass the threshold, confirmed or not.  Null and empty
        texts have no paragraph.  Repeated rows are documents of their own.  Other
        columns are left out.  An empty table gives an empty result.
        """
        fitted, *columns = self.fitted_on
        told = self.told if df is fitted and columns == [text_col, id_col] else self._told(df, text_col, id_col)
        passes = F.col("real") & (F.col("likely") >= self.threshold)
        told = told.select("doc_id", "row", "real", passes.alias("passes"), F.when(passes & (F.col("share") >= CONFIRM), F.struct("likely", "family")).alias("hit"))
        per = told.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.count_if("real").alias("n_windows"), F.count_if("passes").alias("n_found"),
            F.max("hit").alias("best"), F.sort_array(F.collect_set(F.col("hit.family"))).alias("all"),
        )
        name = lambda i: F.element_at(F.array(*map(F.lit, FAMILIES)), i + 1)
        return per.select(
            "doc_id", F.when(F.col("best").isNull(), "none").otherwise(name(F.col("best.family"))).alias("licence"), F.col("best.likely").alias("likely"),
            "n_windows", "n_found", F.array_join(F.transform("all", name), ",").alias("families"),
        )

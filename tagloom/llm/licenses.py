"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Two logistic regressions on hashed words and word pairs: one tells licences from plain prose, one the
families of licences. Both learn from the notices below, with words left out at random, the first also from
the corpus's own paragraphs: every different one belongs to the half that teaches or to the half that
calibrates. What looks like a licence but is not as sure as the confidence limit asks, or doesn't contain a
template of its family, is ``unknown``. The limit is calibrated on the prose that the model hasn't seen.
Built-in functions and Spark's own models only: nothing runs in Python.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.arrays import once, unnest
from tagloom.llm.shared import stored

# The notices by which public licences are named and applied.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 license",
        "Apache License Version 2.0, January 2004",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0-1.0": (
        "Released under CC0 1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Released under the GPLv2 license",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPLv3 license",
    ),
    "lgpl-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}

UNKNOWN = "unknown"
FAMILIES = tuple(NOTICES)
#: Hashed features.
FEATURES = 1 << 14
#: Copies of each notice, and the weight of all prose for one of each family.
COPIES, PROSE_WEIGHT = 24, 4.0
#: Part of a template's word pairs that must stand in a paragraph to confirm it.
CONFIRMED = 0.6
#: Share of unseen prose that must stay below the confidence limit, and the least limit.
SURE, LEAST = 0.999, 0.5
#: Lines of a group, and how far apart groups of that size begin: a wrapped notice is in one of them.
GROUPS = {2: 1, 3: 1, 4: 1, 6: 1, 8: 2, 12: 3, 16: 4}
#: Only groups with this part of a word, or with enough words of a notice to confirm it (:func:`marks`), are looked at.
LICENCE_MARK, MARK_LISTS = "licen", 3


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (line number from 0) and line."""
    return unnest(docs, F.split("text", "\n"), ["doc_id"], "line", "paragraph")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with a letter or digit: doc_id, paragraph, words and features (words and pairs of neighbours)."""
    found = once(lines, "words", words_of(F.col("line"))).drop("line").filter(F.size("words") > 0)
    return once(found, "features", _features(F.col("words")))


def marks(notice: str) -> list[list[str]]:
    """Lists of words: a text that holds ``CONFIRMED`` of the notice's word pairs has a word of each list."""
    words = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", notice.lower())
    pairs = set(zip(words, words[1:], strict=False))
    found, own = [], []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        own.append(word)
        if sum(not set(pair) & set(own) for pair in pairs) < CONFIRMED * len(pairs):
            found.append(own)
            own = []
    return found[:MARK_LISTS]


def _marked(words: Column) -> Column:
    """Whether a text with these words can hold enough of a notice, or names a licence at all."""
    notices = [marks(t) for texts in NOTICES.values() for t in texts]
    listed = sorted({w for lists in notices for own in lists for w in own})
    told = F.array_distinct(F.filter(words, lambda w: w.isin(*listed) | F.contains(w, F.lit(LICENCE_MARK))))

    def test(found: Column) -> Column:
        has = lambda own: F.arrays_overlap(found, F.array(*map(F.lit, own)))
        names = F.exists(found, lambda w: F.contains(w, F.lit(LICENCE_MARK)))
        return reduce(or_, [names, *[reduce(and_, map(has, lists)) for lists in notices]])

    # the few words that matter once; most texts have none
    return F.exists(F.array(told), lambda found: F.when(F.size(found) > 0, test(found)).otherwise(False))


def groups_of(docs: DataFrame) -> DataFrame:
    """Groups of two or more lines without a blank one between: doc_id, text_hash, paragraph (number of the first
    line), n_lines and line, the lines joined. They overlap; only those are given that can hold a notice, by :func:`marks`."""

    most = max(GROUPS)
    marked = docs.filter(_marked(words_of(F.col("text")))).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    cut = once(marked, "lines", F.split("text", "\n"))
    ahead = F.transform("lines", lambda x, i: F.slice("lines", i + 1, most))
    starts = unnest(cut, ahead, ["doc_id", "text_hash"], "lines", "paragraph")
    # The lines before the first blank one.
    blank = F.array_position(F.transform("lines", lambda x: ~x.rlike(r"[^\s]")), F.lit(True))
    run = starts.withColumn("run", F.when(blank > 0, blank - 1).otherwise(F.size("lines")).cast("int")).filter("run > 1")
    sizes = F.array_distinct(
        F.array_compact(
            F.array(*[F.when(F.col("paragraph") % step == 0, F.least(F.lit(n), F.col("run"))) for n, step in GROUPS.items()])
        )
    )
    sized = unnest(run, sizes, ["doc_id", "text_hash", "paragraph", "lines"], "n_lines")
    joined = once(sized, "line", F.array_join(F.slice("lines", F.lit(1), F.col("n_lines")), "\n"))
    return joined.select("doc_id", "text_hash", "paragraph", "n_lines", "line").filter(_marked(words_of(F.col("line"))))


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"), F.lit(0))


def pairs_of(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))


def _features(words: Column) -> Column:
    return F.concat(words, pairs_of(words))


def _notices(spark: SparkSession) -> DataFrame:
    """family, notice, words."""
    rows = F.array(*[F.struct(F.lit(k).alias("family"), F.lit(t).alias("notice")) for k, texts in NOTICES.items() for t in texts])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.family", "r.notice").withColumn("words", words_of(F.col("notice")))


def _hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="features", outputCol="vector").transform(rows)


class Models(NamedTuple):
    """What tells licences from prose, and the families of licences."""

    licence: LogisticRegressionModel
    family: LogisticRegressionModel


def _teaches(words: Column) -> Column:
    """Whether prose of these words teaches; else it calibrates."""
    return F.pmod(F.xxhash64(words, F.lit("fit")), F.lit(2)) == 0


def _known(words: Column, known: set[str]) -> Column:
    """Whether a text holds two of the word pairs of templates: then it is no prose."""
    return F.size(F.array_distinct(F.filter(pairs_of(words), lambda p: p.isin(*sorted(known))))) >= 2


def prose(docs: DataFrame) -> DataFrame:
    """Each different line of ``docs`` (equal words are one) that does not share two word pairs with a template: ``teaches``
    and ``vector``, which is empty for those that don't teach."""
    known = _template_pairs(_notices(docs.sparkSession))
    found = once(lines_of(docs), "words", words_of(F.col("line"))).drop("line").filter(F.size("words") > 0)
    # generated, so that words and pairs are not worked out again for each mention
    found = once(found, "teaches", F.when(~_known(F.col("words"), known), _teaches(F.col("words")))).filter("teaches IS NOT NULL")
    # No word holds a space. Of those that only count no words are sent.
    text = F.when(F.col("teaches"), F.array_join("words", " "))
    codes = [F.when(~F.col("teaches"), F.xxhash64(*c)) for c in (["words"], [F.lit("other"), F.col("words")])]
    different = found.select("teaches", text.alias("text"), codes[0].alias("code"), codes[1].alias("code_2")).distinct()
    features = F.when(F.col("teaches"), _features(F.split("text", " "))).otherwise(F.array().cast("array<string>"))
    return stored(_hashed(different.withColumn("features", features)).select("teaches", "vector"), "prose")


def train(docs: DataFrame) -> tuple[Models, int]:
    """Fit on the notices and the lines of ``docs``: the models, and how many lines of prose are left to calibrate with (:func:`limit_of`)."""
    lines = prose(docs)
    counts = {r["teaches"]: r["n"] for r in lines.groupBy("teaches").agg(F.count("*").alias("n")).collect()}
    # Copies with up to three words in ten left out; the first is whole.
    notices = _notices(docs.sparkSession)
    copies = notices.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn(
        "words",
        F.expr("filter(words, (w, i) -> copy = 0 OR pmod(xxhash64(w, i, copy), 1000) >= 300 * copy / %d)" % COPIES),
    )
    per = F.element_at(_by_family({k: 1000.0 / (COPIES * len(texts)) for k, texts in NOTICES.items()}), F.col("family"))
    number = F.element_at(_by_family({k: float(i) for i, k in enumerate(FAMILIES)}), F.col("family"))
    copies = _hashed(copies.withColumn("features", _features(F.col("words"))).coalesce(1)).select(
        "vector", number.alias("number"), per.alias("weight")
    )
    of_prose = F.lit(1000.0 * PROSE_WEIGHT / max(1, counts.get(True, 0)))
    taught = copies.select("vector", F.lit(1.0).alias("label"), "weight").union(
        lines.filter("teaches").select("vector", F.lit(0.0), of_prose)
    )
    fixed = {"featuresCol": "vector", "weightCol": "weight", "maxIter": 40, "regParam": 1e-3, "standardization": False}
    licence = LogisticRegression(labelCol="label", family="binomial", **fixed).fit(taught)
    family = LogisticRegression(labelCol="number", family="multinomial", **fixed).fit(copies)
    return Models(licence, family), counts.get(False, 0)


def _by_family(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _template_pairs(notices: DataFrame) -> set[str]:
    return {r["p"] for r in notices.select(F.explode(pairs_of(F.col("words"))).alias("p")).distinct().collect()}


def limit_of(lines: DataFrame, unseen: int) -> float:
    """The confidence that ``SURE`` of the ``unseen`` lines of prose don't exceed, ``LEAST`` at least.

    ``lines`` has probability and unseen (the words of lines of prose that did not teach, else null) of all lines that are
    likelier a licence than prose: the others are below ``LEAST``.
    """
    above = unseen - math.ceil(SURE * unseen) + 1
    highest = lines.filter("unseen IS NOT NULL").select("unseen", "probability").distinct().orderBy(F.desc("probability")).limit(above)
    found = highest.agg(F.count("*").alias("n"), F.min("probability").alias("least")).first()
    return max(LEAST, found["least"]) if found["n"] == above else LEAST


def _probabilities(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Add the probabilities of all classes as ``_all``."""
    rows = model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c").transform(rows)
    # generated, so that a filter on the result doesn't work the model out again
    return once(rows, "_all", vector_to_array("_p")).drop("_p", "_r", "_c")


def _likely(lines: DataFrame, models: Models) -> DataFrame:
    """Those that are likelier a licence than prose, with family (the likeliest) and its probability."""
    licence = _probabilities(_hashed(lines), models.licence).withColumn("_licence", F.element_at("_all", 2)).drop("_all")
    found = _probabilities(licence.filter("_licence > 0.5"), models.family).drop("vector")
    families = F.array(*[F.lit(k) for k in FAMILIES])
    return (
        found.withColumn("probability", F.col("_licence") * F.array_max("_all"))
        .withColumn("family", F.element_at(families, F.array_position("_all", F.array_max("_all")).cast("int")))
        .drop("_all", "_licence")
    )


def scan(docs: DataFrame) -> DataFrame:
    """Licence paragraphs of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row for each line that is likelier a licence than prose: doc_id, paragraph (line number from
    0), family (or ``unknown``), likeliest (the family the classifier names), probability, similarity (the
    largest part of a template of that family that the line contains), confirmed, and n_lines, 1. Groups of
    neighbouring lines (see :func:`groups_of`) add a row, with the number of the first line and n_lines, for
    each notice that goes over lines: the group that holds most of a template, if it is confirmed and none of its
    lines is for the same family, or is likelier a licence than prose and none of its lines has a row. Null and
    empty texts and lines without letters or digits give no rows; repeated rows are scanned as often as they occur.
    """
    models, unseen = train(docs)
    single = unnest(docs, F.split("text", "\n"), ["doc_id", F.xxhash64("text").alias("text_hash")], "line", "paragraph")
    lines = stored(_compared(single.withColumn("n_lines", F.lit(1)), models), "lines")
    groups = stored(_compared(groups_of(docs), models), "groups")
    limit = limit_of(lines, unseen)
    lines, groups = _judged(lines, limit), _judged(groups, limit)
    own = [c for c in lines.columns if c != "text_hash"]
    return lines.select(*own).union(_over_lines(lines, groups).select(*own))


def _over_lines(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Of groups that overlap the best, without those that lines speak for."""
    # Repeated rows of a document are one here, with their number.
    row = F.struct(
        F.when(F.col("n_lines") == 1, 0).when(F.col("confirmed"), 1).otherwise(2).alias("kind"),
        (-F.col("similarity")).alias("lacks"), "n_lines", (-F.col("probability")).alias("doubt"), "paragraph", "family", "likeliest", "copies",
    )
    keys = ["doc_id", "text_hash"]
    every = lines.join(groups.select(*keys).distinct().hint("merge"), (lines.doc_id.eqNullSafe(groups.doc_id)) & (lines.text_hash == groups.text_hash), "left_semi").union(groups)
    once = every.groupBy(*every.columns).agg(F.count("*").alias("copies"))
    rows = once.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def clash(x: Column, y: Column) -> Column:
        shared = F.least(x.paragraph + x.n_lines, y.paragraph + y.n_lines) - F.greatest(x.paragraph, y.paragraph)
        most = 2 * shared >= F.least(x.n_lines, y.n_lines)
        return (shared > 0) & ((x.family == y.family) | (x.family == UNKNOWN) | ((y.kind == 1) & most))

    taken = F.aggregate(
        "rows",
        F.slice("rows", F.lit(1), F.lit(0)),
        lambda kept, x: F.when((x.kind > 0) & F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.array_append(kept, x)),
    )
    found = rows.select(*keys, F.explode(F.filter(taken, lambda x: x.kind > 0)).alias("r"))
    again = found.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.copies"))))
    return again.select(
        *keys, "r.paragraph", "r.family", "r.likeliest", (-F.col("r.doubt")).alias("probability"),
        (-F.col("r.lacks")).alias("similarity"), (F.col("r.kind") == 1).alias("confirmed"), "r.n_lines",
    )


def _compared(lines: DataFrame, models: Models) -> DataFrame:
    """Lines or groups that are likelier a licence than prose, compared with the templates of their family."""
    notices = _notices(lines.sparkSession)
    templates = notices.groupBy("family").agg(F.collect_list(F.array_distinct(pairs_of(F.col("words")))).alias("templates"))
    words = F.col("words")
    is_unseen = ~_known(words, _template_pairs(notices)) & ~_teaches(words)
    found = _likely(paragraphs(lines), models)
    compared = found.join(F.broadcast(templates), "family").withColumn("_pairs", pairs_of(words)).withColumn(
        "similarity",
        F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect("_pairs", t)) / F.size(t))),
    )
    return compared.select(
        "doc_id",
        "text_hash",
        "paragraph",
        F.col("family").alias("likeliest"),
        "probability",
        "similarity",
        "n_lines",
        F.when(is_unseen, F.array_join(words, " ")).alias("unseen"),
    )


def _judged(compared: DataFrame, limit: float) -> DataFrame:
    """Name the family of those that are sure and hold a template."""
    confirmed = (F.col("probability") >= limit) & (F.col("similarity") >= CONFIRMED)
    return compared.select(
        "doc_id",
        "text_hash",
        "paragraph",
        F.when(confirmed, F.col("likeliest")).otherwise(UNKNOWN).alias("family"),
        "likeliest",
        "probability",
        "similarity",
        confirmed.alias("confirmed"),
        "n_lines",
    )

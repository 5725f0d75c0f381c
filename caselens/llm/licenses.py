"""10. License scans: a trained paragraph classifier and a template comparison. DataFrame functions and Spark ML only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 13
BACKGROUND = 3000  # paragraphs of the corpus that the classifier sees as unknown
WRAPPED = 100  # a line of at most so many characters that doesn't end a sentence goes on in the next one
KEPT_OUT = 5  # one in so many training rows calibrates, and isn't fitted
CONTAINED = 0.7  # share of a template's word pairs that confirms a prediction
UNKNOWN = "unknown"

#: Notices by licence family.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0."),
)


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.array_distinct(F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.element_at(words, i + 2))))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+"), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """(family, text, pairs) of the templates; pairs are the word pairs that paragraphs are compared by."""
    return spark.createDataFrame(TEMPLATES, "family string, text string").withColumn("pairs", _pairs(_words(F.col("text"))))


@dataclass
class LicenseModel:
    features: PipelineModel
    classifier: LogisticRegressionModel
    calibration: LogisticRegressionModel
    families: list[str]


def _featurizer() -> PipelineModel:
    return PipelineModel([
        RegexTokenizer(inputCol="paragraph", outputCol="words", pattern=r"[^\p{L}\p{N}.]+"),
        NGram(n=2, inputCol="words", outputCol="bigrams"),
        HashingTF(numFeatures=BUCKETS, binary=True, inputCol="bigrams", outputCol="features"),
    ])


def paragraphs(docs: DataFrame) -> DataFrame:
    """(key, at, paragraph): the lines of the texts that aren't blank, wrapped lines joined, and their numbers.

    A line is wrapped if it has at most WRAPPED characters, no mark of a sentence's end, and a line that isn't blank below it.
    """
    joined = F.regexp_replace("text", rf"(?md)^([^\n]{{1,{WRAPPED}}})(?<![\s.!?:;])[ \t\r]*\n(?=[ \t]*[^\s])", "$1 ")
    return docs.select("key", F.posexplode(F.split(joined, "\n")).alias("at", "paragraph")).where("paragraph rlike '[^ \\t\\r]'")


def _margin(raw: Column, families: list[str]) -> Column:
    """How far the best family's score is above the unknown class's."""
    return F.array_max(F.slice(raw, 2, len(families) - 1)) - F.element_at(raw, 1)


def train(docs: DataFrame) -> LicenseModel:
    """Fits the classifier on rows made from templates and background, and on rows kept out the probability that a margin means a licence.

    A template stands alone, with a word missing, and before, behind and between background text, and is its family's row;
    the bounded background sample (BACKGROUND paragraphs, those with the least hash, of texts that hold no template) is unknown.
    """
    spark = docs.sparkSession
    held = templates(spark)
    plain = paragraphs(docs).where(~F.lower("paragraph").rlike("licen[sc]e|copyright|creative commons|public domain"))
    sample = plain.select("paragraph").withColumn("h", F.xxhash64("paragraph")).orderBy("h", "paragraph").limit(BACKGROUND)
    # long paragraphs are met in scoring as they are; in training their first words do as filling
    sample = written(sample.select(F.row_number().over(_by("h")).alias("i"), "paragraph", F.concat_ws(" ", F.slice(F.split("paragraph", " "), 1, 60)).alias("filling")), "background")
    per = 24
    made = held.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("i", F.pmod(F.xxhash64("text", "n"), F.lit(BACKGROUND)) + 1)
    made = made.join(sample.select("i", "filling"), "i", "left").withColumn("w", F.split("text", " "))
    gap = F.pmod(F.xxhash64("n", "text"), F.size("w"))
    short = F.concat_ws(" ", F.filter("w", lambda w, k: (k != gap) | (F.size("w") < 8)))
    fill = F.coalesce("filling", F.lit(""))
    kinds = [F.col("text"), F.concat_ws(" ", "text", fill), F.concat_ws(" ", fill, "text"), F.concat_ws(" ", short, fill), short, F.concat_ws(" ", fill, "text", fill)]
    text = kinds[-1]
    for k, t in enumerate(kinds[:-1]):
        text = F.when(F.pmod("n", F.lit(len(kinds))) == k, t).otherwise(text)
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = made.select(text.alias("paragraph"), label.alias("label")).unionByName(sample.select("paragraph", F.lit(0.0).alias("label")))
    features = _featurizer()
    fitted = written(features.transform(rows).select("features", "label", (F.pmod(F.xxhash64("paragraph", "label"), F.lit(KEPT_OUT)) == 0).alias("kept_out")).coalesce(4), "training")
    classifier = LogisticRegression(maxIter=20, regParam=1e-3, elasticNetParam=0.3, family="multinomial").fit(fitted.where("not kept_out"))
    scored = classifier.transform(fitted.where("kept_out")).select(_margin(vector_to_array("rawPrediction"), families).alias("margin"), F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"))
    assembled = VectorAssembler(inputCols=["margin"], outputCol="features").transform(scored)
    calibration = LogisticRegression(maxIter=20, regParam=1e-3).fit(assembled)
    return LicenseModel(features, classifier, calibration, families)


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def scan(docs: DataFrame, model: LicenseModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, license, probability, contained, n_licenses.

    Every paragraph (a line, or wrapped lines) is classified; one with a calibrated licence probability of `least` or more is a
    licence if CONTAINED of the word pairs of a template of the predicted family stand in it. license is the family
    of the document's paragraph with the highest probability (ties: containment, then name), else unknown with nulls; n_licenses
    counts its licence paragraphs. Null and blank texts are unknown. Equal rows share their result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    raw = vector_to_array("rawPrediction")
    scored = model.classifier.transform(model.features.transform(paragraphs(rows.where("text is not null"))))
    slope, shift = float(model.calibration.coefficients[0]), float(model.calibration.intercept)
    best = F.element_at(F.array(*map(F.lit, model.families)), (F.array_position(F.slice("raw", 2, len(model.families) - 1), F.array_max(F.slice("raw", 2, len(model.families) - 1))) + 1).cast("int"))
    likely = scored.select("key", "at", "paragraph", raw.alias("raw")).withColumn("p", 1 / (1 + F.exp(-(F.lit(slope) * _margin(F.col("raw"), model.families) + shift)))).where(F.col("p") >= least)
    likely = likely.select("key", "at", "p", best.alias("family"), _pairs(_words(F.col("paragraph"))).alias("pairs"))
    known = F.broadcast(templates(docs.sparkSession).select("family", F.col("pairs").alias("template")))
    held = likely.join(known, "family").withColumn("contained", F.size(F.array_intersect("pairs", "template")) / F.size("template")).where(F.col("contained") >= CONTAINED)
    # rows of one paragraph: at most the family's templates
    found = held.groupBy("key").agg(F.max(F.struct("p", "contained", "family")).alias("x"), F.countDistinct("at").alias("n_licenses"))
    return rows.select("doc_id", "key").join(found, "key", "left").select("doc_id", F.coalesce("x.family", F.lit(UNKNOWN)).alias("license"), F.col("x.p").alias("probability"), F.col("x.contained").alias("contained"), F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families that every document's paragraphs name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs.select(F.col("doc_id").alias("key"), "text")))


QUERIES = {"op10_licenses": op10_licenses}
ORACLE_SQL: dict[str, str] = {}

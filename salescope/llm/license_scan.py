"""License scans: literal phrases, and templates found by diagonal voting.

Base: places where the words of a phrase stand consecutively.
Templates: all rolling hashes of K words of a text are joined with those of the
templates. A hit at word d of the text and word t of the template votes for the
diagonal d - t. Neighbouring diagonals, as words inserted or lost make them, are
merged, and a merged span is verified: the hits must cover COVERAGE of the
template's words and of the span's own words.

Only DataFrame functions. The templates are the short list below, so their
hashes are broadcast; votes are kept apart by document, and a text is never
shuffled.

Cases: a null text counts as empty: no words, no places, no labels, score 0;
texts shorter than K words have base places only; repeated rows are scanned
each; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from salescope.llm.common import LOWER, SEPARATORS, UPPER
from salescope.operators.joins import splittable_join

K = 4
#: Diagonals at most so far apart are merged.
MAX_SHIFT = 3
COVERAGE = 0.8

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: License notices as their authors publish them, in normalised words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
    ),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    (
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
        "mpl was not distributed with this file you can obtain one at",
    ),
)


def words_of(text: Column) -> Column:
    """The words, by turning every separator into a blank and cutting at blanks."""
    blank = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(blank, " "), "")


def rolling_hashes(df: DataFrame, *keep: str, at: str) -> DataFrame:
    """A row per run of K words of ``words`` (of size ``n``): ``keep``, its first word ``at``, its hash.

    The array is zipped with itself, shifted, so that hashing happens in
    generated code after the explode and not element by element before it.
    """
    shifted = [F.slice("words", F.lit(j + 1), F.greatest(F.col("n"), F.lit(1))).alias(f"w{j}") for j in range(K)]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias(at, "run"))
    parts = [F.col(f"run.w{j}") for j in range(K)]
    return rows.filter(parts[-1].isNotNull()).select(*keep, at, F.xxhash64(*parts).alias("hash"))


def template_hashes(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, n_template, t, hash: one row per rolling hash."""
    rows = [(i, label, text.split()) for i, (label, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, label string, words array<string>")
    df = df.withColumns({"n_template": F.size("words"), "n": F.size("words")})
    return rolling_hashes(df, "template", "label", "n_template", at="t")


_KEY = ("_id", "_t1", "_t2")


def _keyed(docs: DataFrame) -> DataFrame:
    """A document's key: id and text, so that rows may repeat and ids may be null."""
    return docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t1"),
        F.coalesce(F.xxhash64(F.lit(1), F.col("text")), F.lit(0)).alias("_t2"),
    )


def verified_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Document key, template, label, start and length in words, coverage of each verified span."""
    known = F.broadcast(template_hashes(docs.sparkSession, templates))  # a row per word of TEMPLATES
    words = _keyed(docs).withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    votes = (
        rolling_hashes(words, *_KEY, at="d")
        .join(known, "hash")
        .withColumn("diagonal", F.col("d") - F.col("t"))
        .groupBy(*_KEY, "template", "label", "n_template", "diagonal")
        .agg(F.collect_set("t").alias("ts"))
    )
    by_text = Window.partitionBy(*_KEY, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_text) > MAX_SHIFT
    merged = (
        votes.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0)))
        .withColumn("span", F.sum("apart").over(by_text))
        .groupBy(*_KEY, "template", "label", "n_template", "span")
        .agg(
            F.flatten(F.collect_list("ts")).alias("ts"),
            F.flatten(F.collect_list(F.transform("ts", lambda t: t + F.col("diagonal")))).alias("ds"),
        )
    )

    def covered(starts: str) -> Column:
        runs = F.transform(starts, lambda at: F.sequence(at, at + (K - 1)))
        return F.size(F.array_distinct(F.flatten(runs)))

    start = F.array_min("ds")
    length = F.array_max("ds") + K - start
    return (
        merged.withColumns({"start": start, "length": length})
        .withColumn("coverage", covered("ts") / F.col("n_template"))
        .filter((F.col("coverage") >= COVERAGE) & (covered("ds") >= COVERAGE * F.col("length")))
        .select(*_KEY, "template", "label", "start", "length", "coverage")
    )


def _places(phrase: str) -> Column:
    """First words of all places of a phrase; only texts that hold it are walked through."""
    parts = phrase.split()

    def starts(i: Column) -> Column:
        same = F.lit(True)
        for j, w in enumerate(parts):
            same = same & (F.get(F.col("words"), i + F.lit(j)) == F.lit(w))
        return same

    walk = F.filter(F.sequence(F.lit(0), F.col("n") - F.lit(len(parts))), starts)
    return F.when(F.col("joined").contains(f" {phrase} "), walk).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``score`` is 1 for a text with a base place, else the largest coverage of a
    verified span, else 0.
    """
    found = (
        verified_spans(docs, templates)
        .groupBy(*_KEY)
        .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    )
    rows = _keyed(docs).withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    labels = list(PHRASES.values())
    rows = rows.select("doc_id", *_KEY, "n", *(_places(p).alias(f"_p{i}") for i, p in enumerate(PHRASES)))
    places = [F.col(f"_p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(
        F.array(*(F.when(F.size(p) > 0, F.lit(x)) for p, x in zip(places, labels, strict=True)))
    )
    rows = rows.select("doc_id", *_KEY, "n", F.concat(*places).alias("at"), base.alias("base"))
    joined = splittable_join(rows, found, list(_KEY), "left")
    more = F.coalesce(F.col("more"), F.array().cast("array<string>"))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        score.alias("score"),
    )

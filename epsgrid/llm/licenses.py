"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of the texts are joined by hash to the places where they stand in
license templates.  A hit at text place p and template place t votes for the diagonal p - t:
a copy of a template puts all its votes on one diagonal, and a word more or less moves the
rest of them to a neighbouring one.  Diagonals are counted, neighbours merged, and a merged
span is accepted if enough of the template's k-grams are found in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsgrid.llm.common import pick, prepare

SLACK = 3        # words by which the diagonals of one span may differ from one to the next
MIN_SHARE = 0.6  # of a notice's k-grams that a span must hold
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, found word by word, and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Notices of licenses, found also when words are changed, and their labels.
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation either version 2 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def templates(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(key, gram, k, template, t, grams, phrase, label): every k-gram of every template; pairs
    of words for phrases, four words for notices.  A table of fixed size."""
    rows = []
    for i, (label, text) in enumerate([*phrases, *notices]):
        phrase = i < len(phrases)
        k = 2 if phrase else 4
        if len(text.split()) < k:
            raise ValueError(f"template of under {k} words: {text!r}")
        rows.append(F.struct(F.lit(i).alias("template"), F.lit(k).alias("k"), F.lit(phrase).alias("phrase"),
                             F.lit(label).alias("label"), F.split(F.lit(text), " ").alias("w")))
    table = (spark.range(1).select(F.inline(F.array(*rows))).withColumn("grams", F.size("w") - F.col("k") + 1)
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("grams") - 1))))
    gram = F.array_join(F.slice("w", F.col("t") + 1, F.col("k")), " ")
    return table.select(F.xxhash64(gram).alias("key"), gram.alias("gram"), "k", "template", "t", "grams", "phrase", "label")


def hits(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(row, doc_id, n_words, p, template, t, k, grams, phrase, label): every place of a text
    whose k-gram stands in a template, and one row without a template for every text.

    The texts are read once; the templates are broadcast, so only hits travel.
    """
    text = F.coalesce("text", F.lit(""))
    # lower() also changes other letters, which stand in no template; of them only the Kelvin
    # sign would become an ASCII letter
    low = F.when(F.contains(text, F.lit("\u212A")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    rows = (pick(docs, "doc_id", "text")
            .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)).alias("w"))
            .withColumn("n_words", F.size("w").cast("long")))
    rest = F.size("w")
    side = lambda i: F.slice("w", i + 1, F.greatest(rest - i, F.lit(0))).alias(f"w{i}")
    places = (rows.select("row", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip(*[side(i) for i in range(4)])).alias("p", "g"))
              .select("row", "doc_id", "n_words", "p", "g.w0", "g.w1", "g.w2", "g.w3"))
    gram2 = F.when(F.col("w1").isNotNull(), F.concat_ws(" ", "w0", "w1"))
    gram4 = F.when(F.col("w3").isNotNull(), F.concat_ws(" ", "w0", "w1", "w2", "w3"))
    grams = (places.select("row", "doc_id", "n_words", F.coalesce("p", F.lit(0)).alias("p"),
                           F.explode(F.array(gram2, gram4)).alias("gram"))
             .withColumn("hash", F.xxhash64("gram")))
    known = templates(docs.sparkSession, phrases, notices).withColumnRenamed("gram", "own")
    same = (F.col("hash") == F.col("key")) & (F.col("gram") == F.col("own"))
    found = grams.join(F.broadcast(known), same, "left")
    return found.where(F.col("template").isNotNull() | (F.col("p") == 0)).select(
        "row", "doc_id", "n_words", "p", "template", "t", "k", "grams", "phrase", "label")


def find_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, slack: int = SLACK,
               min_share: float = MIN_SHARE) -> DataFrame:
    """(row, doc_id, n_words, phrase, label, start, end, share): the accepted spans in words, end
    exclusive; a text without any has one row without a label.

    A phrase needs all its pairs of words on one diagonal, which is a place where its words
    stand consecutively.  Diagonals of a notice that differ by at most ``slack`` words from
    the next are one span, which must hold ``min_share`` of the notice's k-grams.
    """
    # all that follows groups by row and more: one shuffle, of hits only
    votes = hits(docs, phrases, notices).repartition("row")
    diagonals = (votes.groupBy("row", "doc_id", "n_words", "template", "k", "grams", "phrase", "label",
                               (F.col("p") - F.col("t")).alias("diagonal"))
                 .agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("t").alias("ts")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > slack)
    spans = (diagonals.withColumn("far", F.coalesce(far, F.lit(False)).cast("long"))
             .withColumn("span", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("row", "doc_id", "n_words", "template", "k", "grams", "phrase", "label", "span")
             .agg(F.min("first").alias("start"), (F.max("last") + F.col("k")).alias("end"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("found")))
    share = F.col("found") / F.col("grams")
    length = F.col("grams") + F.col("k") - 1
    good = (F.when(F.col("phrase"), F.col("found") == F.col("grams"))
            .otherwise((share >= min_share) & (F.col("end") - F.col("start") <= 2 * length)))
    good = F.coalesce(good, F.lit(False))
    value = lambda c: F.when(good, F.col(c)).alias(c)
    return spans.select("row", "doc_id", "n_words", value("phrase"), value("label"), value("start"), value("end"),
                        F.when(good, share).alias("share"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, slack: int = SLACK, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per
    input row.

    n_base, first_word and last_word are about phrases, ``labels`` also about notices; score is
    the largest share of a template found in an accepted span, 0 without one.  Null text counts
    as empty (no words, no labels, score 0); null ids, repeated rows and rows that share an id
    stay; other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    spans = find_spans(docs, phrases, notices, slack, min_share)
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    base = F.when(F.col("phrase"), F.col("start")).cast("long")
    out = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(base).alias("n_base"),
        F.min(base).alias("first_word"), F.max(base).alias("last_word"), names(F.col("phrase")).alias("base_labels"),
        names(F.col("phrase").isNotNull()).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.drop("row")

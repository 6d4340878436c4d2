"""Licence scans by diagonal voting, in DataFrame functions alone.

Every two-word gram of a text is hashed, and joined by its hash to the positions of that
gram in a small table of phrases and notices. A hit at text word i and template word j votes for the
diagonal i - j. Votes are added up for each (document, template, diagonal); a diagonal
with all votes of a phrase is a place of it. For longer notices neighbouring diagonals
(a word put in or left out) are merged, and a span counts if enough of the notice's
grams stand in it. Grams are compared as text after the hash has met, so no span rests on
a collision. The template table is a fixed value in this file, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is no word character: ASCII but for digits and letters. Fixed value.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Phrases that must stand word for word, with their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that may stand with small changes, with labels of the method's own.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is dedicated to the public domain": "public-domain",
    "mozilla public license version 2 0": "mpl-2.0",
}


def license_words(text: Column) -> Column:
    """The `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` words of the text, A-Z taken as lower-case letters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), "")


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(template positions by the hash of their two-word gram, the distinct hashes)."""
    rows = []
    for n, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        ws = text.split()
        rows += [(n, label, n < len(phrases), len(ws) - 1, j, a, b) for j, (a, b) in enumerate(zip(ws, ws[1:], strict=False))]
    t = spark.createDataFrame(rows, "template int, label string, exact boolean, grams int, j int, first string, second string")
    t = t.withColumn("gram", F.xxhash64("first", "second"))
    return t, [r["gram"] for r in t.select("gram").distinct().collect()]  # a fixed table of this file


def license_spans(docs: DataFrame, share: float = 0.75, slack: int = 2, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """row and n_words of each row of docs, with label, exact, first_word, last_word and share of each
    verified span (words from 0), or nulls where it has none.

    docs: row (unique), text. Exact phrases give a row for each place; notices give spans whose
    diagonals lie within `slack` words of each other and hold `share` of their grams. Texts are
    split once; of all their rolling grams those leave the scan whose hash a template has. All
    grouping is by row, so it shares one shuffle.
    """
    t, known = _templates(docs.sparkSession, phrases, notices)
    # the templates are ASCII, and lower-casing other letters moves no word's edge
    split = docs.select("row", license_words(F.lower("text")).alias("ws"))
    grams = F.transform("ws", lambda w, i: F.struct(F.xxhash64(w, F.get("ws", i + 1)).alias("gram"), i.alias("i"), w.alias("one"), F.get("ws", i + 1).alias("two")))
    met = F.filter(grams, lambda g: g["gram"].isin(known))
    hits = split.select("row", F.size("ws").cast("long").alias("n_words"), F.explode_outer(met).alias("g")).select("row", "n_words", "g.gram", "g.i", "g.one", "g.two")
    # a hash that meets is verified by the words themselves
    hits = hits.join(F.broadcast(t), (hits["gram"] == t["gram"]) & (hits["one"] == t["first"]) & (hits["two"] == t["second"]), "left").drop(t["gram"]).repartition("row")
    votes = hits.groupBy("row", "n_words", "template", "label", "exact", "grams", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.collect_set("j").alias("js"), F.min("i").alias("lo"), F.max("i").alias("hi")
    )
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    # each diagonal of a phrase is a place of its own; those of a notice join their neighbours
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > slack, F.lit(True))
    spans = (
        votes.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(w))
        .groupBy("row", "n_words", "template", "label", "exact", "grams", "island")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("met"), F.min("lo").alias("first_word"), (F.max("hi") + 1).alias("last_word"))
        .withColumn("share", F.col("met") / F.col("grams"))
    )
    good = F.when(F.col("exact"), F.col("met") == F.col("grams")).otherwise(F.col("share") >= share)
    return spans.select("row", "n_words", *[F.when(good, F.col(c)).alias(c) for c in ("label", "exact", "first_word", "last_word", "share")])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    n_base: places of PHRASES; first_word and last_word: their smallest and largest start.
    labels adds those of NOTICES; both lists are distinct, sorted and comma-joined ('' for
    none). score: the best share of a notice or phrase met, 0 where none is. Null texts
    count as empty. Each row is scanned for itself, repeated rows and null doc_ids too; no
    rows give no rows; other columns are not read.
    """
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("at"), "doc_id").alias("row"), "text")
    base = F.when(F.col("exact"), F.col("first_word"))
    return license_spans(rows).groupBy("row").agg(
        F.first("n_words").alias("n_words"), F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

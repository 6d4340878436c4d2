"""Helpers shared by the corpus operators: text rules, scratch tables, components."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.functions.tables import drop_path, fresh, released, scratch, written

#: The six ASCII white-space characters, and the Java pattern of a run of them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone, leaving every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the `[^\\x20\\x09-\\x0D]+` words of a text; empty for null or blank."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fold_of(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def checkpointed(df: DataFrame) -> DataFrame:
    scratch(df.sparkSession, "x")  # sets a folder where none is set
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): root is the smallest node.

    Alternating large-star and small-star rounds: each is a grouped minimum and an
    equality join, so no component is ever gathered in one place; rounds grow with
    the logarithm of the longest path. Nodes without an edge don't appear.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node of `large` points to smaller ones only
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        e, last = written(small, "edges"), e
        released(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state = now

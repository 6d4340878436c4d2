"""How filters act together: what each removes in every order, and its Shapley share.

Spark reduces the documents to mask cells: a part's count of rows for each set of filters
that they fail, 32 at most, with counts of good and toxic rows. An order's steps follow from
the cells alone, so no order reads documents again. A task holds the cells of some parts as a
matrix and walks through all permutations by single swaps of neighbours: a swap leaves what
every other step removes as it is, so only two steps are summed anew from the cells, and the
Shapley sums grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.llm.common import UPPER, let, words

FILTERS = "ABCDE"
SYMBOLS = "[#$%&*|]"
CELLS = 1 << len(FILTERS)
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D that a text fails: few words, repeated words, capitals, symbols."""
    counts = let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("distinct")))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    few = let(counts, lambda c: F.when(c["n"] < 200, 1).otherwise(0) + F.when(c["distinct"].cast("long") * 100 < c["n"].cast("long") * 50, 2).otherwise(0))
    return few + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * 2, 4).otherwise(0) + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters that they fail.

    Filter E (bit 16) fails rows whose text a row of smaller doc_id has, whatever its part.
    Equal rows are counted before anything is joined, so a text, an id or a part that many
    rows share is a few rows by then. A null text is empty, a null source the part ''. Rows
    without doc_id have no smaller and are no smaller, and have no labels; of several labels
    of one id, any that is 1 counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = plain.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), failures(F.col("text")).alias("mask")).groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    told = rows.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    # rows of one text in one part: how many, and how many of its smallest id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = told.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    passed = alike.withColumn("passed", F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("passed").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    split = passed.select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0")
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def walk(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n items, each a swap of neighbours away from the one before: (order, left place of the swap).

    Each item moves while the item that it faces is smaller; larger items turn round after.
    """
    order, facing = list(range(n)), [-1] * n
    yield list(order), None
    while True:
        moving = [x for i, x in enumerate(order) if 0 <= i + facing[x] < n and order[i + facing[x]] < x]
        if not moving:
            return
        x = max(moving)
        i = order.index(x)
        j = i + facing[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            facing[y] = -facing[y]
        yield list(order), min(i, j)


def _members() -> tuple[np.ndarray, np.ndarray]:
    """fails[f, mask]: whether a mask has filter f; clear[set, mask]: whether it has none of a set of filters."""
    masks = np.arange(CELLS)
    return (masks >> np.arange(len(FILTERS))[:, None] & 1).astype(bool), (masks[:, None] & masks) == 0


def audited(counts: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """(order, removed[step, kind, part]) of all orders, from counts[kind, part, mask]; the array is used again."""
    fails, clear = _members()
    n = len(FILTERS)
    removed = np.zeros((n, *counts.shape[:2]), np.int64)
    for order, at in walk(n):
        for step in range(n) if at is None else (at, at + 1):
            before = sum(1 << f for f in order[:step])
            removed[step] = counts[:, :, fails[order[step]] & clear[before]].sum(axis=2)
        yield order, removed


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, fails = len(FILTERS), _members()[0]
    for b in batches:
        for some in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
            parts, counts = some.column(0), np.zeros((3, some.num_rows, CELLS), np.int64)
            for i, held in enumerate(some.column(1).to_pylist()):
                for c in held:
                    counts[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            total = counts[0].sum(axis=1)
            failing = counts[0] @ fails.T
            alone = counts[0][:, [1 << f for f in range(n)]]
            shapley = np.zeros((n, some.num_rows), np.int64)
            for order, removed in audited(counts):
                for step, f in enumerate(order):
                    shapley[f] += removed[step, 0]
            for order, removed in audited(counts):
                gone = removed[:, 0].cumsum(axis=0)
                for step, f in enumerate(order):
                    values = (total - gone[step], removed[step, 0], failing[:, f] - removed[step, 0], alone[:, f], removed[step, 1], removed[step, 2], shapley[f])
                    name = pa.array(["".join(FILTERS[x] for x in order)] * len(total))
                    yield pa.RecordBatch.from_arrays([parts, name, pa.array(np.full(len(total), step + 1), pa.int32()), *(pa.array(v) for v in values)], [x.split(" ")[0] for x in AUDIT.split(", ")])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with the columns of AUDIT.

    A part is a source (null: ''). kept and removed are rows after and at the step, redundant
    those that fail its filter but went before, unique_fails those that fail it alone,
    good_lost and toxic_lost the removed rows labelled quality 1 or toxic 1, shapley what the
    filter removes summed over all orders. Null texts are empty; equal rows each count; no
    rows give no rows; further columns are not read. See `cells` for null ids and labels.
    """
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(_audit, AUDIT)


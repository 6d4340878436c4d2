"""Embedding near-duplicates on an inverted multi-index.

Each half of the (unit-length) vectors has a codebook of its own, fitted by k-means on a
bounded sample of rows; pairs of codes form a grid of cells, and every vector is indexed
in its cell. A vector visits cells in the order of its summed half distances
(multi-sequence order) - as many as random queries, compared by brute force with all
rows until enough groups of links are found, need for the target recall. Visits meet cells by an equality join on
blocks of bounded size, and cosines are verified in double precision.

A pair counts if either visits the other's cell. A block gives per-vector link counts and
a spanning forest of its links, never all its pairs. Equal vectors are one row in it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm.common import components, released, written

#: Members of a cell and vectors visiting it in a block; codebook sample, and rows of it for each code; recall queries at once.
BLOCK, ASKERS, SAMPLE, EACH, PROBES = 1024, 2048, 20_000, 16, 2048
#: Most codes in a half (33 million vectors; beyond that cells fill up), most cells to visit before all rows become one cell.
MOST_CODES, MOST_VISITS = 2048, 1024
#: Groups of linked recall queries wanted, queries kept of a group, and rows tried as queries before groups are made up.
LINKED, MEMBERS, TRIED = 300, 8, 1 << 15


def unit(rows) -> np.ndarray:
    """Rows as doubles of length one."""
    x = np.array(rows.tolist() if hasattr(rows, "tolist") else rows, np.float64)
    x = x.reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k or fewer centres of the rows of x (Lloyd's rounds from random distinct rows)."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * x[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1) if x.shape[1] else c
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def visits(x: np.ndarray, books, most: int) -> np.ndarray:
    """The `most` nearest cells of each row, nearest first, by summed half distances."""
    h = x.shape[1] // 2
    d = [(b * b).sum(1) - 2 * p @ b.T for p, b in ((x[:, :h], books[0]), (x[:, h:], books[1]))]
    order = [np.argsort(v, 1, kind="stable") for v in d]
    near = [np.take_along_axis(v, o, 1) for v, o in zip(d, order, strict=True)]
    # cell (i, j) of the sorted grid has (i + 1)(j + 1) - 1 nearer ones: the rest can't be among `most`
    ij = np.array([(i, j) for i in range(min(len(books[0]), most)) for j in range(min(len(books[1]), most // (i + 1)))], np.int64)
    total = near[0][:, ij[:, 0]] + near[1][:, ij[:, 1]]
    best = np.argsort(total, 1, kind="stable")[:, :most]
    return order[0][np.arange(len(x))[:, None], ij[best, 0]] * len(books[1]) + order[1][np.arange(len(x))[:, None], ij[best, 1]]


def _usable(e):
    """Whether a vector can link: finite and not all zero."""
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    return F.coalesce((F.size(e) > 0) & fine, F.lit(False))


def fit(reps: DataFrame, n: int, threshold: float, recall: float) -> tuple[tuple, int, float]:
    """(codebooks, cells to visit, recall measured on the probes).

    Recall is the mean over groups of linked probes, so a large group counts once. Where
    links are so rare that TRIED random rows show fewer than LINKED groups, the others are
    made up: a random row, and a vector just at the threshold from it in a random direction.
    The cells are the fewest whose recall is enough at its lower bound - or as it stands,
    once all rows have been probes. If no number of cells is enough, one cell holds all rows.
    The driver holds LINKED * MEMBERS probes and a sample, whatever the table holds.
    """
    codes = int(min(MOST_CODES, max(4, math.sqrt(n / 8))))
    size = max(SAMPLE, EACH * codes)
    by_hash = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(1 << 30)) < F.lit(int(min(1.0, size / max(n, 1)) * (1 << 30)))
    sample = unit(np.array([r["e"] for r in reps.filter(by_hash).orderBy("node").limit(size).select("e").collect()]))
    h = sample.shape[1] // 2
    books = (kmeans(sample[:, :h], codes), kmeans(sample[:, h:], codes))
    probes, group, whole = _linked(reps, n, sample.shape[1], threshold)
    if not len(probes) and whole:  # every row has been compared with all others: only copies on another scale are left,
        return books, min(len(books[0]) * len(books[1]), 4), 1.0  # which may round to either side of a border in each half
    groups = int(group.max()) + 1 if len(group) else 0
    made, near = _made_up(sample, 0 if whole else max(0, LINKED - groups), threshold)
    grid = len(books[0]) * len(books[1])
    most = min(grid, 64)
    while True:
        share = (visits(made, books, most) == visits(near, books, 1)).cumsum(1).astype(float) if len(made) else np.zeros((0, most))
        if len(probes):
            got = _ranks(reps, probes, books, most, threshold)
            each = np.cumsum(got, 1)[:, :most] / got.sum(1, keepdims=True)
            found = np.stack([np.bincount(group, each[:, c]) for c in range(most)], 1) / np.bincount(group)[:, None]
            share = np.concatenate([found, share])
        mean = share.mean(0)
        enough = np.flatnonzero((mean if whole else lower_bound(mean, len(share))) >= recall)
        if len(enough):
            return books, int(enough[0]) + 1, float(mean[enough[0]])
        if most >= min(grid, MOST_VISITS):
            return tuple(b.mean(0, keepdims=True) for b in books), 1, 1.0
        most = min(grid, MOST_VISITS, 4 * most)


def _made_up(sample: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """k rows of the sample, and for each a unit vector at the threshold's cosine from it."""
    g = np.random.default_rng(11)
    x = sample[g.integers(0, len(sample), k)]
    y = g.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)


def lower_bound(mean, k: int, z: float = 1.645):
    """Wilson's one-sided lower bound of a mean of k shares."""
    return (mean + z * z / (2 * k) - z * np.sqrt(mean * (1 - mean) / k + z * z / (4 * k * k))) / (1 + z * z / k)


def _links(q: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x are links of each probe; equal directions, which share a cell, aren't counted."""
    cos = q @ x.T
    return (cos >= threshold) & (cos < 1 - 1e-12)


def _linked(reps: DataFrame, n: int, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(probes with a link, their groups, whether all rows have been probes).

    Random rows are compared with all rows, in blocks, until the linked ones form `LINKED`
    groups or TRIED rows have been probes. Probes that link with each other are one group,
    of which `MEMBERS` are kept as it grows.
    """
    step = max(1, min(PROBES, (1 << 22) // width))
    parts = max(1, math.ceil(n / step))
    at = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts))
    found, group, done = np.zeros((0, width)), np.zeros(0, np.int64), 0
    while done < parts and (done == 0 or done * step < TRIED):
        probes = unit(np.array([r["e"] for r in reps.filter(at == done).select("e").collect()]).reshape(-1, width))
        done += 1
        if len(probes):
            found = np.concatenate([found, probes[_has_link(reps, probes, threshold)]])
        if len(found):
            group = _forest(np.concatenate([found[i : i + 256] @ found.T >= threshold for i in range(0, len(found), 256)]))
            # a large group tells no more by each further member
            order = np.argsort(group, kind="stable")
            place = np.arange(len(group)) - np.searchsorted(group[order], group[order])
            keep = np.sort(order[place < MEMBERS])
            found, group = found[keep], np.unique(group[keep], return_inverse=True)[1]
            if group.max() + 1 >= LINKED:
                break
    return found, group, done >= parts


def _has_link(reps: DataFrame, probes: np.ndarray, threshold: float) -> np.ndarray:
    seen = reps.sparkSession.sparkContext.broadcast(probes)  # destroyed below: its rows are collected here

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = seen.value
        hit = np.zeros(len(q), bool)
        for b in batches:
            for at in range(0, len(b), 512):
                hit |= _links(q, unit(b["e"].iloc[at : at + 512]), threshold).any(1)
        yield pd.DataFrame({"probe": np.flatnonzero(hit)})

    got = [r["probe"] for r in reps.select("e").mapInPandas(run, "probe long").distinct().collect()]
    seen.destroy()
    return np.array(sorted(got), np.int64)


def _ranks(reps: DataFrame, probes: np.ndarray, books, most: int, threshold: float) -> np.ndarray:
    """How many links of each probe lie in its n-th nearest cell, over all rows; beyond `most`: last."""
    seen = reps.sparkSession.sparkContext.broadcast((probes, visits(probes, books, most), books))

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, cells, cb = seen.value
        hits: Counter = Counter()
        for b in batches:
            for at in range(0, len(b), 4096):
                x = unit(b["e"].iloc[at : at + 4096])
                own = visits(x, cb, 1)[:, 0]
                i, j = np.nonzero(_links(q, x, threshold))
                for lo in range(0, len(i), 4096):
                    k, to = i[lo : lo + 4096], j[lo : lo + 4096]
                    met = cells[k] == own[to][:, None]
                    hits.update(zip(k.tolist(), np.where(met.any(1), met.argmax(1), most).tolist(), strict=True))
        yield pd.DataFrame([(*key, v) for key, v in hits.items()], columns=["probe", "rank", "hits"])

    got = np.zeros((len(probes), most + 1), np.int64)
    for r in reps.select("e").mapInPandas(ranks, "probe long, rank int, hits long").groupBy("probe", "rank").agg(F.sum("hits").alias("hits")).collect():
        got[r["probe"], r["rank"]] = r["hits"]
    seen.destroy()
    return got


def _forest(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest index in its component."""
    label = np.arange(len(close))
    while True:
        new = np.where(close, label[None, :], len(close)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _labels(close: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one in its component; close links nodes rows[i] and columns[j]."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, np.where(close, label[columns][None, :], n).min(1))
        np.minimum.at(new, columns, np.where(close, label[rows][:, None], n).min(0))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked_pairs(reps: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """(a, b, n) for the nodes of n distinct vectors of one width that have a link.

    n: other vectors linked, copies counted; b: a node linked to a over some links of its block.
    """
    books, cells, _ = fit(reps, n, threshold, recall)
    spark = reps.sparkSession
    share = spark.sparkContext.broadcast((books, cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cb, most = share.value
        for b in batches:
            for at in range(0, len(b), 2048):
                c = b.iloc[at : at + 2048].copy()
                c["visited"] = list(visits(unit(c["e"]), cb, most))
                yield c

    table = written(reps.select("e", "node", "times").mapInPandas(place, "e array<double>, node long, times long, visited array<int>"), "cells")
    home = F.get("visited", F.lit(0))
    members = table.select(home.alias("to"), "e", "node", "times", home.alias("cell"), "visited")
    asks = table.select(F.explode("visited").alias("to"), "e", "node", "times", home.alias("cell"), F.lit(None).cast("array<int>").alias("visited"))
    # a block: one part of a cell's members, and one part of the vectors that visit the cell
    sizes = members.groupBy("to").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sizes = sizes.join(asks.groupBy("to").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("ask_parts")), "to")

    def dealt(rows: DataFrame, mine: str, of: str, other: str, others: str) -> DataFrame:
        """Each row in a part of its own, once for each part of the other side."""
        return rows.join(sizes, "to").select(
            "to", F.pmod(F.xxhash64("node"), F.col(of)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other), "e", "node", "times", "cell", "visited"
        )

    both = dealt(members, "part", "parts", "ask_part", "ask_parts").unionByName(dealt(asks, "ask_part", "ask_parts", "part", "parts"))

    def block(b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "n": []})
        asking = b["visited"].isna()
        q, m = b[asking], b[~asking]
        if q.empty or m.empty:
            return none
        x, y = unit(q["e"]), unit(m["e"])
        close = np.concatenate([x[i : i + 256] @ y.T >= threshold for i in range(0, len(x), 256)])
        a, c = q["node"].to_numpy(), m["node"].to_numpy()
        order = np.argsort(c)
        at = order[np.searchsorted(c[order], a).clip(max=len(c) - 1)]
        close[np.arange(len(a)), at] &= c[at] != a
        some, others = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
        if not len(some):
            return none
        close, a, c = close[np.ix_(some, others)], a[some], c[others]
        # a vector that visits back counts the pair in its own block
        homes, of = np.unique(q["cell"].to_numpy()[some], return_inverse=True)
        back = np.stack([np.isin(homes, v) for v in m["visited"].iloc[others]], 1)[of]
        ids = np.unique(np.concatenate([a, c]))
        ia, ic = np.searchsorted(ids, a), np.searchsorted(ids, c)
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, ia, (close @ m["times"].to_numpy(float)[others]).astype(np.int64))
        np.add.at(count, ic, (q["times"].to_numpy(float)[some] @ (close & ~back)).astype(np.int64))
        return pd.DataFrame({"a": ids, "b": ids[_labels(close, ia, ic, len(ids))], "n": count})

    # blocks are small in bytes and long in work, so they aren't merged into few tasks
    tasks = max(2 * spark.sparkContext.defaultParallelism, n * cells // 4096)
    found = both.repartition(tasks, "to", "part", "ask_part").groupBy("to", "part", "ask_part").applyInPandas(block, "a long, b long, n long")
    found = written(found, "links")
    released(table)
    return found


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings.

    Links: other vectors of the same width with cosine >= threshold, in double precision,
    found through an index for each width (no pair below it). Null, zero and non-finite
    vectors, and rows without a vec_id, link with nothing: their component is their own id.
    Rows that repeat a vec_id are vectors of their own with links of their own; component_id
    is the smallest vec_id reachable. No rows give no rows. A table has few widths: each
    costs jobs of its own.
    """
    marked = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).withColumn("usable", F.col("vec_id").isNotNull() & _usable(F.col("e")))
    alone = marked.filter(~F.coalesce("usable", F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = written(marked.filter("usable").select("vec_id", "e"), "vectors")
    reps = written(rows.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    for width, n in reps.groupBy(F.size("e").alias("width")).count().orderBy("width").collect():
        found = found.unionByName(_linked_pairs(reps.filter(F.size("e") == width), n, threshold, recall))
    roots = components(found.select("a", "b"))
    n_links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    per = reps.join(n_links, "node", "left").join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("root", F.coalesce("root", "node"))
    least = per.groupBy("root").agg(F.min("rep").alias("component_id"))
    per = per.join(least, "root").select("e", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = rows.join(per, "e").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

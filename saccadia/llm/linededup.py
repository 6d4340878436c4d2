"""Dropping lines that an earlier document holds already.

Line keys are hashed to 128 bits, range-partitioned on (key, document, position) and
sorted the same way inside each partition. One pass over a partition streams the first
document of each key and gives out the positions to drop. The document is part of the
range, so a line that a third of all rows hold spreads over many partitions; a key that
runs on over a partition's edge is settled from one small row per partition. What comes
back is a compressed keep bitmap for each document, never its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm.common import BLANKS, fresh, let, written

_KEYS = "h1 long, h2 long, doc_id long, row long, pos int"
_SEEN = "kind string, " + _KEYS


def line_key(line: str) -> str:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """A row for each line whose key has `least` code points or more.

    `row` is a hash of the text, so rows that share a doc_id but not a text stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if doc is None:
                    continue
                for pos, line in enumerate((text or "").split("\n")):
                    key = line.strip(BLANKS)
                    if len(key) >= least:
                        raw = key.encode("utf-8", "surrogatepass").lower()
                        out.append((_signed(xxhash.xxh64_intdigest(raw, 1)), _signed(xxhash.xxh64_intdigest(raw, 2)), doc, row, pos))
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string")).mapInArrow(run, _KEYS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64()] * 4 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h1", "h2", "doc_id", "row", "pos"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, document and position: which lines go.

    drop: an earlier row of this partition has the key in a smaller document.
    edge: a line of the partition's first key in its first document here; it goes if
    an earlier partition holds the key in a smaller document.
    last: the partition's last key, with its first document here.
    """
    key = first_key = None
    doc = None
    for b in batches:
        h1, h2, ids = (b.column(i).to_numpy() for i in range(3))
        if not len(h1):
            continue
        new = np.empty(len(h1), bool)
        new[0] = key != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if first_key is None:
            first_key = (h1[0], h2[0])
        starts = np.flatnonzero(new)
        firsts = np.concatenate(([doc if doc is not None else ids[0]], ids[starts]))[np.cumsum(new)]
        drop = ids != firsts
        edge = ~drop & (h1 == first_key[0]) & (h2 == first_key[1])
        for kind, mask in (("drop", drop), ("edge", edge)):
            if mask.any():
                kept = b.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * kept.num_rows), *kept.columns], ["kind", *b.schema.names])
        key, doc = (h1[-1], h2[-1]), firsts[-1]
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array(["last"]), pa.array([key[0]]), pa.array([key[1]]), pa.array([doc]), pa.array([0]), pa.array([0], pa.int32())], ["kind", "h1", "h2", "doc_id", "row", "pos"])


def dropped_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, row, positions): the line positions to drop, for documents that lose any."""
    order = ["h1", "h2", "doc_id", "row", "pos"]
    keys = written(line_keys(docs, least), "line-keys")
    seen = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _SEEN), "line-firsts")
    # a first key that an earlier partition ended with: one row for each partition at most
    ends = seen.filter("kind = 'last'").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    edge = seen.filter("kind = 'edge'").join(ends, ["h1", "h2"]).filter(F.col("doc_id") > F.col("first"))
    gone = seen.filter("kind = 'drop'").select("doc_id", "row", "pos").unionByName(edge.select("doc_id", "row", "pos"))
    return gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("positions"))


def _bitmap(n: int, positions) -> np.ndarray:
    keep = np.ones(n, bool)
    if positions is not None:
        keep[np.asarray(positions, np.int64)] = False
    return keep


def _with_positions(docs: DataFrame, least: int) -> tuple[DataFrame, str]:
    """docs with the positions to drop, null where none, in a column of the name returned."""
    kid, row, gone = fresh(docs, "line_id", "line_row", "line_gone")
    found = dropped_lines(docs, least).withColumnsRenamed({"doc_id": kid, "row": row, "positions": gone})
    same = (docs["doc_id"].cast("long") == F.col(kid)) & (F.xxhash64(docs["text"]) == F.col(row))
    return docs.join(found, same, "left").drop(kid, row), gone


def line_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (zlib-compressed bits, first line first) and kept_sha256.

    A text is split at \\n; null or empty is one empty line. A key (blanks off both ends,
    A-Z lower-cased) of `least` code points or more that two documents hold loses all its
    lines but those in the smallest doc_id holding it. Rows of one doc_id count as one
    document, and each repeated row gives a row. Rows with a null doc_id keep all lines
    and hold none against others. No rows give no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone = b.column(1).to_pylist(), b.column(4).to_pylist()
            bits = [zlib.compress(np.packbits(_bitmap(n, g)).tobytes()) for n, g in zip(sizes, gone, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits, pa.binary()), b.column(3)], ["doc_id", "n_lines", "n_dropped", "keep", "kept_sha256"])

    # texts are hashed where they are: only positions go to Python
    rows, gone = _with_positions(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), least)
    marked = rows.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_kept_text(gone), F.lit("")), 256).alias("kept_sha256"), gone,
    )
    return marked.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep binary, kept_sha256 string")


def _kept_text(gone: str):
    """`text` without the lines at the positions in `gone`: the stretches between them, joined."""
    bounds = F.concat(F.array(F.lit(-1)), F.sort_array(gone), F.array(F.lit(1 << 30)))

    def stretches(lines, cuts):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda k: F.slice(lines, F.get(cuts, k) + 2, F.get(cuts, k + 1) - F.get(cuts, k) - 1)))

    rest = let(F.split("text", "\n", -1), lambda lines: let(bounds, lambda cuts: F.array_join(stretches(lines, cuts), "\n")))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """documents with the kept lines alone as text; every row stays, n_chars follows the text.

    A null text stays null; rows with a null doc_id keep all lines; repeated rows are cut
    alike; no rows give no rows; other columns pass through.
    """
    rows, gone = _with_positions(docs, least)
    out = rows.withColumn("text", _kept_text(gone)).drop(gone)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

"""Packing tokenised documents into windows by non-negative least squares.

Documents are tokenised once into a written table. Pieces of a full window stand alone;
what is left of each document is a length below the window. Combinations of two or three
lengths that fill a window exactly are enumerated, repeat counts are fitted to the length
histogram by non-negative least squares, rounded, and held to what is there. The rest is
packed greedily: largest first on the histogram where a window fills exactly, else end to
end with cuts at window edges. The plan depends on the histogram (at most `window` bins),
so the driver never holds anything for each document; each document finds its place by
its rank among documents of its length, from counts per part and length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.llm.common import written

WINDOW = 2048
END = 1
#: Pieces of a longer text that are tokenised at a time stay whole; only memory depends on it.
BATCH = 256
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A function from text to token ids of the tokenizers file at `path`.

    The same byte-level BPE is run by tiktoken, which is several times faster; it is built
    from the file's own vocabulary and merges. A text that holds a special token's string
    goes to tokenizers itself, which treats it in its own way.
    """
    if path not in _ENCODERS:
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        model = json.loads(exact.to_str())
        special = [t["content"] for t in model["added_tokens"]]
        # byte-level alphabet: printable bytes stand for themselves, others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=())

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row for each document: part, rank, full_rank, rem, n, doc_id and ids.

    ids: little-endian unsigned 32-bit, the end id last; n their number, rem = n mod window.
    rank counts the documents of the same rem before it in its part (a task of this job),
    full_rank their full windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        ranks, fulls = Counter(), Counter()
        names = ["part", "rem", "rank", "full_rank", "n", "doc_id", "ids"]
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                cut, out = b.slice(at, BATCH), []
                for doc, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), END).astype("<u4")
                    rem = len(ids) % window
                    out.append((part, rem, ranks[rem], fulls[rem], len(ids), doc, ids.tobytes()))
                    ranks[rem] += 1
                    fulls[rem] += len(ids) // window
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "part int, rem int, rank long, full_rank long, n long, doc_id long, ids binary"
    )


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of lengths in `present`, a <= b <= c, that add up to the window; a may be 0."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    rows = []
    for a in [0, *present.tolist()]:
        b = present[(present >= max(a, 1)) & (2 * present <= window - a)]
        c = window - a - b
        ok = (c < window) & (c >= b) & has[c]
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def repeat_counts(combos: np.ndarray, hist: np.ndarray, steps: int = 150) -> np.ndarray:
    """Least-squares repeat counts x >= 0 of the combinations against the histogram.

    Accelerated projected gradient on a sparse 0-3 matrix: each step is one gather and one
    bincount over three entries a combination.
    """
    if not len(combos):
        return np.zeros(0)
    flat, size = combos.ravel(), len(hist)
    used = flat > 0

    def forward(x):
        return np.bincount(flat[used], np.repeat(x, 3)[used], size)

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(12):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - hist) / top)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / ahead * (new - x), ahead
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """([(lengths, repeats), ...], rest): windows that fill exactly, and the lengths left over."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[list[int], int]] = []
    combos = combinations(np.flatnonzero(left), window)
    x = np.rint(repeat_counts(combos, left.astype(float))).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        if not x[k]:
            break
        lengths = [int(v) for v in combos[k] if v]
        n = min(int(x[k]), *(int(left[v]) // lengths.count(v) for v in set(lengths)))
        if n > 0:
            made.append((lengths, n))
            for v in lengths:
                left[v] -= n
    rest = np.zeros_like(left)
    while (there := np.flatnonzero(left)).size:
        lengths, gap = [int(there[-1])], window - int(there[-1])
        while gap and (fit := there[there <= gap]).size:
            fits = next((int(v) for v in fit[::-1] if left[v] > lengths.count(v)), 0)
            if not fits:
                break
            lengths.append(fits)
            gap -= fits
        if gap:
            rest[there[-1]] = left[there[-1]]
            left[there[-1]] = 0
            continue
        n = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        made.append((lengths, n))
        for v in lengths:
            left[v] -= n
    return made, rest


def _slots(made, rest, hist, window):
    """Where the r-th document of a length goes: sorted starts over length * 2**40 + rank."""
    rows, base, used = [], 0, np.zeros(len(hist), np.int64)
    for lengths, n in made:
        offset, seen = 0, Counter()
        for v in lengths:
            rows.append((v, int(used[v]) + seen[v] * n, base, offset, 0))
            seen[v] += 1
            offset += v
        for v, m in seen.items():
            used[v] += m * n
        base += n
    tokens = 0
    for v in np.flatnonzero(rest).tolist()[::-1]:
        rows.append((v, int(used[v]), base, tokens, 1))
        tokens += v * int(rest[v])
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    base += -(-tokens // window)
    return (a[:, 0] << 40) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4], base


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in one piece. All sequences but the last of the rest
    are full. Null and empty texts are the end id alone; repeated rows are packed each for
    itself and a null doc_id stays null; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    tokens = written(tokenize(docs, tokenizer, window), "tokens")
    counts = written(tokens.groupBy("rem", "part").agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {window}")).alias("fulls")), "lengths")
    hist, fulls = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in counts.groupBy("rem").agg(F.sum("docs").alias("docs"), F.sum("fulls").alias("fulls")).collect():  # `window` rows at most
        hist[r["rem"]], fulls[r["rem"]] = r["docs"], r["fulls"]
    made, rest = plan(hist, window)
    *table, base = _slots(made, rest, hist, window)
    share = spark.sparkContext.broadcast((table, base + np.concatenate(([0], np.cumsum(fulls)[:-1]))))
    before = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rem", "part", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("f0"))
    placed = tokens.join(starts, ["rem", "part"]).select("doc_id", "n", "rem", (F.col("d0") + F.col("rank")).alias("r"), (F.col("f0") + F.col("full_rank")).alias("f"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (key, first, seq, offset, loose), full_at = share.value
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        for b in batches:
            out = []
            for doc, n, rem, r, f, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pieces = [(k * window, window, int(full_at[rem]) + f + k, 0) for k in range(n // window)]
                if rem:
                    k = int(np.searchsorted(key, (rem << 40) + r, "right")) - 1
                    at = r - int(first[k])
                    if not loose[k]:
                        pieces.append((n - rem, rem, int(seq[k]) + at, int(offset[k])))
                    else:
                        whole, here = divmod(int(offset[k]) + at * rem, window)
                        cut = min(rem, window - here)
                        pieces.append((n - rem, cut, int(seq[k]) + whole, here))
                        if cut < rem:
                            pieces.append((n - rem + cut, rem - cut, int(seq[k]) + whole + 1, 0))
                for start, length, s, o in pieces:
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, part, zlib.crc32(part), n, s, o))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

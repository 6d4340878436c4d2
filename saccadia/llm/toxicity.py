"""Toxicity by FTRL-proximal logistic regression on hashed n-grams and skip-grams.

Features of a text: its lower-cased words, neighbouring pairs and pairs with one word
between, each hashed to one of 2**`bits` slots and counted once. The weights are learned
from a bounded sample of labelled rows (`sample` rows, all of them where there are fewer)
by FTRL-proximal steps with rates for each coordinate; L1 leaves few weights, which are
broadcast as (slot, weight) pairs (2**bits at most) to score every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm.common import fold

BITS, SAMPLE, EPOCHS = 22, 20_000, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 0.5
#: Training texts that a feature must stand in; rarer ones say nothing about other texts.
LEAST = 4


class Hasher:
    """Slots of a text's features; words seen before come from a bounded memo."""

    def __init__(self, bits: int, memo: int = 400_000):
        self.mask, self.memo, self.most = np.uint64((1 << bits) - 1), {}, memo

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode("utf-8", "surrogatepass").lower().translate(None, b".,;:!?\"()[]").split()
        if not ws:
            return np.zeros(0, np.int64)
        memo, digest = self.memo, xxhash.xxh64_intdigest
        if len(memo) > self.most:
            memo.clear()
        h = []
        for w in ws:
            v = memo.get(w)
            if v is None:
                v = memo[w] = digest(w)
            h.append(v)
        h = np.array(h, np.uint64)
        near = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1)
        f = np.concatenate([h, near, skip])
        f ^= f >> np.uint64(29)
        return np.unique(f & self.mask).astype(np.int64)


def learn(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over (slots, label) rows; the last one is the bias."""
    size = (1 << bits) + 1
    held = np.bincount(np.concatenate([i for i, _ in rows]), minlength=size)
    rows = [(i[held[i] >= LEAST], y) for i, y in rows]
    z, n, rng = np.zeros(size), np.zeros(size), np.random.default_rng(7)
    positive = sum(y for _, y in rows)
    # both labels weigh the same in sum
    weigh = {1: len(rows) / max(2 * positive, 1), 0: len(rows) / max(2 * (len(rows) - positive), 1)}

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, y = rows[k]
            i = np.append(i, size - 1)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - y) * weigh[y]
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - rate * w
            n[i] += g * g
    return weight(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights other than 0) from `sample` labelled texts at most, those of the smallest text hashes."""
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").cast("int")).filter("toxic in (0, 1)"), "doc_id").select(F.xxhash64("text", "doc_id").alias("h"), "text", "toxic")
    share = F.lit(1.0)
    n = rows.count()
    if n > sample:
        share = F.lit(sample / n)
    some = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30)).orderBy("h").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, data = Hasher(bits), []
        for b in batches:
            data += [(slots(t), int(y)) for t, y in zip(b["text"], b["toxic"], strict=True)]
        w = learn(data, bits) if data else np.zeros((1 << bits) + 1)
        used = np.flatnonzero(w)
        yield pd.DataFrame({"slot": used, "weight": w[used]})

    got = some.coalesce(1).mapInPandas(run, "slot long, weight double").orderBy("slot").collect()  # what L1 leaves, 2**bits rows at most
    return np.array([r["slot"] for r in got], np.int64), np.array([r["weight"] for r in got], np.float32)


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = 0.7, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each row of documents.

    Learns from labelled rows outside the held-out fold (crc32 of the id as text modulo
    `mod` is `held`); null labels are left out, and without any label every score is 0.5.
    Null and empty texts get the bias alone; repeated rows give repeated rows; columns
    besides doc_id and text are not read.
    """
    weights = train(docs.filter(fold(F.col("doc_id"), mod) != held), labels, bits, sample)
    share = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, w = Hasher(bits), np.zeros((1 << bits) + 1, np.float32)
        w[share.value[0]] = share.value[1]
        for b in batches:
            s = np.array([w[slots(t)].sum(dtype=np.float64) for t in b.column(1).to_pylist()]) + float(w[-1])
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), "score", "predicted")

"""Troughs and their prominence in recordings of any length.

Equal neighbours are one run (a scan over parts). A trough is a run between higher ones; its
prominence is how far the signal rises, on the side where it rises less, before it falls
below the trough. That is a search for the nearest smaller value, done by blocks of runs:
most are settled within a block; for the others the blocks' minima name the block where the
nearest smaller value lies, and that block is asked. A task holds a block and one row for
each other block of its recording, never the recording.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.tables import written
from saccadia.operators.blocks import in_order, scan

#: Runs in a block.
BLOCK = 1 << 18


def value_runs(df: DataFrame, signal: str, parts: int | None = None) -> DataFrame:
    """recording_id, k (from 0), first, last, v: stretches of equal values in order; missing samples are passed over."""
    rows = in_order(df.filter(F.col(signal).isNotNull()).select("recording_id", F.col("i").cast("long").alias("i"), F.col(signal).cast("double").alias("v")), ["recording_id", "i"], parts)
    new = scan(rows, ["recording_id"], was=("lag", F.col("v"))).withColumn("new", F.coalesce(F.col("v") != F.col("was"), F.lit(True)).cast("int"))
    at = scan(new, ["recording_id"], k=("sum", F.col("new")))
    return at.groupBy("recording_id", (F.col("k") - 1).alias("k")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.first("v").alias("v"))


def smaller_before(v: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places of v: the last place before with a smaller value (-1: none), and the largest value in between.

    All places step back at once, by powers of two from large to small, wherever none of the
    values stepped over is smaller.
    """
    low, high = [v], [v]
    while 2 << (len(low) - 1) <= len(v):
        half = 1 << (len(low) - 1)
        low.append(np.concatenate((low[-1][:half], np.minimum(low[-1][half:], low[-1][:-half]))))
        high.append(np.concatenate((high[-1][:half], np.maximum(high[-1][half:], high[-1][:-half]))))
    at, top, x = ask - 1, np.full(len(ask), -np.inf), v[ask]
    for p in reversed(range(len(low))):
        over = at + 1 >= 1 << p
        over[over] = low[p][at[over]] >= x[over]
        top[over] = np.maximum(top[over], high[p][at[over]])
        at = at - (over.astype(np.int64) << p)
    return at, top


def troughs(df: DataFrame, signal: str, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """recording_id, i (the middle of a plateau), value, prominence of the signal's troughs.

    Missing samples are passed over; the first and last value are no troughs. Each block is
    sent the outline of its recording, so these rows grow with the square of the number of
    blocks: a recording of 10^10 samples has 38,147 blocks of four numbers each.
    """
    runs = written(value_runs(df, signal, parts).withColumn("block", F.floor(F.col("k") / block).cast("long")), "value-runs")
    kind = dict(runs.dtypes)["recording_id"]
    # each block with the runs at its edges, which say whether its own first and last are troughs
    minima = runs.groupBy("recording_id", "block").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min_by("v", "k").alias("head"), F.max_by("v", "k").alias("tail"))
    outline = minima.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("block", "low", "high", "head", "tail"))).alias("outline")).withColumnRenamed("recording_id", "of")
    schema = f"recording_id {kind}, k long, i long, v double, side int, top double, block long"

    def within(key: tuple, p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        v, k = p["v"].to_numpy(), p["k"].to_numpy()
        blocks = o["outline"].iloc[0]
        low, high = (np.array([b[x] for b in blocks]) for x in ("low", "high"))
        own = int(key[1])
        before = np.concatenate(([blocks[own - 1]["tail"] if own else -np.inf], v[:-1]))
        after = np.concatenate((v[1:], [blocks[own + 1]["head"] if own + 1 < len(blocks) else -np.inf]))
        ask = np.flatnonzero((before > v) & (v < after))
        out = []
        for side in (0, 1):
            w, places = (v, ask) if not side else (v[::-1], len(v) - 1 - ask)
            at, top = smaller_before(w, places)
            target = np.full(len(ask), -1)
            # beyond the block: its blocks one by one on this side, nearest first
            lows, highs = (low[:own][::-1], high[:own][::-1]) if not side else (low[own + 1 :], high[own + 1 :])
            open_ = np.flatnonzero(at < 0)
            if len(open_):
                reach, peak = np.minimum.accumulate(lows), np.maximum.accumulate(highs)
                x = v[ask[open_]]
                hit = np.searchsorted(-reach, -x, "right") if len(reach) else np.zeros(len(x), int)
                passed = np.where(hit > 0, peak[np.maximum(hit - 1, 0)], -np.inf) if len(peak) else np.full(len(x), -np.inf)
                top[open_] = np.maximum(top[open_], passed)
                found = hit < len(reach)
                target[open_[found]] = (own - 1 - hit[found]) if not side else (own + 1 + hit[found])
            mid = (p["first"].to_numpy()[ask] + p["last"].to_numpy()[ask]) // 2
            out.append(pd.DataFrame({"recording_id": [key[0]] * len(ask), "k": k[ask], "i": mid, "v": v[ask], "side": side, "top": top, "block": target}))
        return pd.concat(out)

    # a recording's outline meets each of its blocks
    wide = runs.select(F.col("recording_id").alias("whole"), F.col("block").alias("own")).distinct().join(outline, F.col("whole") == F.col("of")).drop("of")
    asked = written(runs.groupBy("recording_id", "block").cogroup(wide.groupBy("whole", "own")).applyInPandas(within, schema), "troughs")

    def beyond(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Asked from one side, a block answers with the largest value up to its nearest smaller one."""
        p = p.sort_values("k", ascending=bool(key[3])) if len(p) else p
        if not len(q):
            return q
        v = p["v"].to_numpy()
        reach, peak = np.minimum.accumulate(v), np.maximum.accumulate(v)
        hit = np.searchsorted(-reach, -q["v"].to_numpy(), "right")
        q["top"] = np.maximum(q["top"].to_numpy(), np.where(hit > 0, peak[np.maximum(hit - 1, 0)], -np.inf))
        return q

    # many blocks may ask one: its askers are dealt out by their own block, and it is copied for those alone
    far = asked.filter("block >= 0").withColumn("deal", F.floor(F.col("k") / (block * 16)).cast("long"))
    called = far.select(F.col("recording_id").alias("whole"), F.col("block").alias("asked"), F.col("deal").alias("askers"), F.col("side").alias("from")).distinct()
    copies = called.join(runs.select("recording_id", "block", "k", "v"), (F.col("whole") == F.col("recording_id")) & (F.col("asked") == F.col("block"))).drop("recording_id", "block")
    answered = copies.groupBy("whole", "asked", "askers", "from").cogroup(far.groupBy("recording_id", "block", "deal", "side")).applyInPandas(beyond, schema + ", deal long").drop("deal")
    sides = asked.filter("block < 0").unionByName(answered)
    # a side without a higher value would not be a side of a trough
    return sides.groupBy("recording_id", "k").agg(F.first("i").alias("i"), F.first("v").alias("value"), (F.min("top") - F.first("v")).alias("prominence")).drop("k")

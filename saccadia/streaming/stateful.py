"""Streams with state: filters that look back, repeated rows, sliding windows.

Rows of a recording may come late and in any order up to the watermark. They wait in the state
until the watermark has passed them and then go on in order, so the result is that of the
same rows in a table, however they were cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saccadia.functions import kernels as K


class _Causal(StatefulProcessor):
    """Holds a recording's waiting rows and the filter's memory between batches."""

    def __init__(self, b: list[float], a: list[float]):
        self.b, self.a = b, a

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, i long, v double")
        self.memory = handle.getValueState("memory", "z array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for p in rows:
            if len(p):
                self.waiting.appendList([(t.to_pydatetime(), int(i), None if pd.isna(v) else float(v)) for t, i, v in zip(p["ts"], p["i"], p["v"], strict=True)])
                # a row is due once the watermark is at its time
                for ms in {int(t.timestamp() * 1000) + 1 for t in p["ts"]} - known:
                    self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(((t, i, v) for t, i, v in self.waiting.get()), key=lambda r: (r[0], r[1]))
        due = [r for r in rows if pd.Timestamp(r[0]).timestamp() * 1000 < now]
        if not due:
            return
        if rest := rows[len(due) :]:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        z = np.array(self.memory.get()[0]) if self.memory.exists() else np.zeros(len(self.b) - 1)
        out = []
        for _, _, v in due:
            if v is None:
                out.append(None)
                continue
            # a missing sample leaves the memory as it is
            y = self.b[0] * v + z[0]
            z = np.append(z[1:], 0.0) + np.array(self.b[1:]) * v - np.array(self.a[1:]) * y
            out.append(y)
        self.memory.update((z.tolist(),))
        yield pd.DataFrame({"recording_id": [key[0]] * len(due), "ts": [r[0] for r in due], "i": [r[1] for r in due], "filtered": pd.array(out, dtype="Float64").to_numpy(dtype=float, na_value=np.nan)})

    def close(self) -> None:
        pass


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 seconds") -> DataFrame:
    """The first row of each key; repeats that come within `late` of it go, and the state ends with the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def causal_lowpass(stream: DataFrame, signal: str, cutoff: float, fs: float, order: int = 2, late: str = "10 seconds") -> DataFrame:
    """recording_id, ts, i, filtered: one pass of a Butterworth low-pass, in order of time.

    A filter that looks ahead has no stream form; this one looks back alone. A row comes out
    when the watermark has passed it; rows later than that are dropped. A missing sample
    stays missing. Needs the RocksDB state store.
    """
    b, a = (np.asarray(x, float).tolist() for x in K.butterworth(order, cutoff, fs))
    kind = dict(stream.dtypes)["recording_id"]
    rows = stream.withWatermark("ts", late).select("recording_id", "ts", F.col("i").cast("long").alias("i"), F.col(signal).cast("double").alias("v"))
    out = rows.groupBy("recording_id").transformWithStateInPandas(_Causal(b, a), f"recording_id {kind}, ts timestamp, i long, filtered double", "Append", "EventTime")
    return out.withColumn("filtered", F.nanvl("filtered", F.lit(None)))


def sliding_means(stream: DataFrame, signal: str, width: str = "1 second", step: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """recording_id, start, end, mean, n over overlapping windows; missing samples don't count."""
    w = F.window("ts", width, step)
    out = stream.withWatermark("ts", late).groupBy("recording_id", w.alias("w")).agg(F.avg(signal).alias("mean"), F.count(signal).alias("n"))
    return out.select("recording_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


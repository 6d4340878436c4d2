"""Operators on recordings and intervals that are longer than a task.

Each gives the rows of its namesake in `samples` or `intervals`, whose windows hold a whole
recording in one task. Here rows are put in order over the whole table once and scanned in
parts (see `blocks`): a recording with most of the rows is as many tasks as any other rows.
The order is a written table, so these cost a write and a range shuffle more; they are for
recordings that one task shouldn't hold. `parts` sets the number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.operators.blocks import in_order, scan

OF = ["recording_id"]


def _ordered(df: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    clash = {"at", "part"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken by the order")
    return in_order(df, [*OF, *keys], parts)


def indexed(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df with the sample index i from 0 in the given order."""
    return scan(_ordered(df.drop("i"), list(order), parts), OF, i=("sum", F.lit(1))).withColumn("i", (F.col("i") - 1).cast("long")).drop("at", "part")


def steps(df: DataFrame, time: str = "t_ms", parts: int | None = None) -> DataFrame:
    """df with `step`: the time since the sample before, null for the first."""
    return scan(_ordered(df, ["i"], parts), OF, was=("lag", F.col(time))).withColumn("step", F.col(time) - F.col("was")).drop("was", "at", "part")


def nearest_index(events: DataFrame, samples: DataFrame, parts: int | None = None) -> DataFrame:
    """events with i of the nearest sample in time: the earlier one on a tie, the first of samples at one time."""
    marks = samples.groupBy("recording_id", "t_ms").agg(F.min("i").cast("long").alias("si")).withColumn("event_id", F.lit(None).cast("long"))
    asks = events.select("recording_id", "t_ms", F.lit(None).cast("long").alias("si"), F.col("event_id").cast("long").alias("event_id"))
    rows = _ordered(marks.unionByName(asks), ["t_ms", "event_id"], parts)
    sample = F.when(F.col("si").isNotNull(), F.struct("si", "t_ms"))
    both = scan(rows, OF, back=("last", sample), ahead=("next", sample)).filter("event_id is not null")
    before, after = F.col("t_ms") - F.col("back.t_ms"), F.col("ahead.t_ms") - F.col("t_ms")
    near = F.when(F.col("ahead").isNull() | (before <= after), F.col("back.si")).otherwise(F.col("ahead.si"))
    return both.select("recording_id", "event_id", "t_ms", near.alias("i"))


def merge(iv: DataFrame, distance: float = 0.0, parts: int | None = None) -> DataFrame:
    """Joins intervals that overlap, touch or lie within `distance`; counts what went in as `parts`."""
    rows = _ordered(iv.select("recording_id", "start", "end"), ["start", "end"], parts)
    reached = scan(rows, OF, reach=("max_before", F.col("end")))
    new = reached.withColumn("new", F.coalesce(F.col("start") > F.col("reach") + distance, F.lit(True)).cast("int"))
    groups = scan(new, OF, island=("sum", F.col("new")))
    return groups.groupBy("recording_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("island")


def runs(samples: DataFrame, flag: Column, parts: int | None = None) -> DataFrame:
    """[start, end) index runs of the samples where flag holds."""
    hit = _ordered(samples.filter(flag).select("recording_id", "i"), ["i"], parts)
    islands = scan(hit, OF, k=("sum", F.lit(1))).withColumn("island", F.col("i") - F.col("k"))
    return islands.groupBy("recording_id", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).drop("island")


def filled_linear(df: DataFrame, signal: str, out: str, parts: int | None = None) -> DataFrame:
    """Linear interpolation over missing values by index; ends take the nearest value."""
    v = F.col(signal)
    there = F.when(v.isNotNull(), F.struct(F.col("i").alias("i"), v.alias("v")))
    rows = scan(_ordered(df, ["i"], parts), OF, _back=("last", there), _ahead=("next", there))
    i0, v0, i1, v1 = (F.col(f"{side}.{x}") for side in ("_back", "_ahead") for x in "iv")
    line = v0 + (v1 - v0) * (F.col("i") - i0) / (i1 - i0)
    value = F.when(v.isNotNull(), v).when(F.col("_back").isNull(), v1).when(F.col("_ahead").isNull(), v0).otherwise(line)
    return rows.withColumn(out, value).drop("_back", "_ahead", "at", "part")


def covered(samples: DataFrame, iv: DataFrame, at: str = "i", out: str = "hit", parts: int | None = None) -> DataFrame:
    """samples with whether they lie in an interval: starts and ends join the stream as +1 and -1."""
    d = iv.filter("end > start")
    marks = d.select("recording_id", F.col("start").alias(at), F.lit(1).alias("_d")).unionByName(d.select("recording_id", F.col("end").alias(at), F.lit(-1).alias("_d")))
    # an end or start comes before the sample at its place
    both = samples.withColumn("_d", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True).withColumn("_late", F.col("_d").isNull())
    rows = scan(_ordered(both, [at, "_late"], parts), OF, _open=("sum", F.col("_d")))
    return rows.withColumn(out, F.coalesce(F.col("_open"), F.lit(0)) > 0).filter("_late").drop("_d", "_late", "_open", "at", "part")

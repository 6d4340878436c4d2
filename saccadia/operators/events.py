"""Operators on events: (recording_id, event_id, label, t_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.units import from_unit, normalize_unit, to_unit


def _ordered():
    return Window.partitionBy("recording_id").orderBy("t_ms", "event_id")


def numbered(events: DataFrame) -> DataFrame:
    """events with k, their place in the recording from 0."""
    return events.withColumn("k", (F.row_number().over(_ordered()) - 1).cast("long"))


def take(events: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Every `step`-th event of each recording from place `start` up to, not including, `stop`; negative places count from the end."""
    if step < 1:
        raise ValueError("the step is positive")
    n = F.count("*").over(Window.partitionBy("recording_id"))

    def place(at):
        return n + at if at < 0 else F.lit(at)

    lo, k = F.greatest(F.lit(0), place(start)), F.col("k")
    out = numbered(events).filter((k >= 0)).withColumn("_lo", lo).withColumn("_hi", n if stop is None else place(stop))
    return out.filter((k >= F.col("_lo")) & (k < F.col("_hi")) & ((k - F.col("_lo")) % step == 0)).drop("k", "_lo", "_hi")


def pick(events: DataFrame, places: list[int]) -> DataFrame:
    """The events at the given places of each recording."""
    return numbered(events).filter(F.col("k").isin(places)).drop("k")


def in_unit(events: DataFrame, unit: str, out: str = "t") -> DataFrame:
    """events with their time in `unit` as `out`; sample indices aren't a unit of events."""
    if normalize_unit(unit) is None:
        raise ValueError("events have no times in samples")
    return events.withColumn(out, to_unit(F.col("t_ms"), unit))


def select(events: DataFrame, contains: str | None = None, time_range: tuple[float, float] | None = None, unit: str = "ms", where: Column | None = None) -> DataFrame:
    """Events whose label holds a text (letter case counts), within a time range (both ends included), that meet a predicate."""
    if contains is not None:
        events = events.filter(F.col("label").contains(contains))
    if time_range is not None:
        lo, hi = time_range
        if not lo < hi:
            raise ValueError("a time range begins before it ends")
        events = events.filter(to_unit(F.col("t_ms"), unit).between(lo, hi))
    return events if where is None else events.filter(where)


def count(events: DataFrame) -> DataFrame:
    """recording_id, n_events."""
    return events.groupBy("recording_id").agg(F.count("*").alias("n_events"))


def outside(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Events whose time lies outside their recording, or whose recording has no samples."""
    span = samples.groupBy("recording_id").agg(F.min("t_ms").alias("_t0"), F.max("t_ms").alias("_t1"))
    joined = events.join(span, "recording_id", "left")
    return joined.filter(F.col("_t0").isNull() | (F.col("t_ms") < F.col("_t0")) | (F.col("t_ms") > F.col("_t1"))).drop("_t0", "_t1")


def replaced(new: DataFrame, samples: DataFrame, unit: str = "ms", time: str = "t") -> DataFrame:
    """Events of recordings from rows (recording_id, label, `time` in `unit`): ids by time, checked against the samples.

    A row outside its recording, or one without a label or a time, is an error when the result is read.
    """
    w = Window.partitionBy("recording_id").orderBy("t_ms", "label")
    rows = new.select("recording_id", "label", from_unit(F.col(time), unit).alias("t_ms"))
    span = samples.groupBy("recording_id").agg(F.min("t_ms").alias("_t0"), F.max("t_ms").alias("_t1"))
    bad = F.col("label").isNull() | F.col("t_ms").isNull() | F.col("_t0").isNull() | (F.col("t_ms") < F.col("_t0")) | (F.col("t_ms") > F.col("_t1"))
    checked = rows.join(span, "recording_id", "left").withColumn("t_ms", F.when(~F.coalesce(bad, F.lit(True)), F.col("t_ms")).otherwise(F.raise_error(F.lit("an event outside its recording")).cast("double")))
    return checked.select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("event_id"), "label", "t_ms")

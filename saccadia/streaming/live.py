"""Streaming forms of the operators that need no future samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, signal: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Mean of a signal per recording and tumbling window, late rows up to `late`."""
    return stream.withWatermark("ts", late).groupBy("recording_id", F.window("ts", width)).agg(F.avg(signal).alias(signal), F.count("*").alias("n"))


def missing_sessions(stream: DataFrame, signal: str, gap: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Stretches of missing samples, joined where they lie within `gap`."""
    hit = stream.withWatermark("ts", late).filter(F.col(signal).isNull())
    s = hit.groupBy("recording_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("recording_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")

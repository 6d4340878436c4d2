"""Event-related epochs in long form: (recording_id, event_id, k, v[, masked]), k samples from the onset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.operators.intervals import nearest_index, statistic
from saccadia.operators.samples import mask_of


def cut(samples: DataFrame, events: DataFrame, signal: str, before: int, after: int, outside: bool = False) -> DataFrame:
    """Samples from `before` ahead of each onset to `after` behind it, by an equality join on the index.

    events: (recording_id, event_id) with `i`, the onset's sample, or else with t_ms, of which the
    nearest sample is taken. Places outside the recording are left out, or null and masked.
    """
    if "i" not in events.columns:
        events = nearest_index(events, samples)
    o = events.select("recording_id", "event_id", "i").withColumn("k", F.explode(F.sequence(F.lit(-before).cast("long"), F.lit(after).cast("long"))))
    o = o.select("recording_id", "event_id", "k", (F.col("i") + F.col("k")).alias("i"))
    m = mask_of(signal)
    s = samples.select("recording_id", "i", F.col(signal).alias("v"), (F.col(m) if m in samples.columns else F.col(signal).isNull()).alias("masked"))
    out = o.join(s, ["recording_id", "i"], "left" if outside else "inner").drop("i")
    return out.withColumn("masked", F.coalesce("masked", F.lit(True))) if outside else out


def baseline_correct(ep: DataFrame, window: tuple[int, int] | int | None = None) -> DataFrame:
    """Epochs less the mean over k in [window[0], window[1]), or less the value at one k; by default all k < 0."""
    k = F.col("k")
    at = k < 0 if window is None else k == window if isinstance(window, int) else (k >= window[0]) & (k < window[1])
    return ep.withColumn("v", F.col("v") - F.avg(F.when(at, F.col("v"))).over(Window.partitionBy("recording_id", "event_id")))


def mean_sem(ep: DataFrame, by: tuple[str, ...] = ("k",), missing: str = "v") -> DataFrame:
    """mean, sem (sample sd) and percentage missing over the epochs at each k."""
    return ep.groupBy(*by).agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"), (100 * F.avg(F.col(missing).isNull().cast("double"))).alias("missing"))


def curve(ep: DataFrame, centre: str | Callable[[Column], Column] = "mean", spread: str | Callable[[Column], Column] = "sem") -> DataFrame:
    """k, centre, spread by any statistics of `statistic`."""
    return ep.groupBy("k").agg(statistic(centre, F.col("v")).alias("centre"), statistic(spread, F.col("v")).alias("spread"))


def group(ep: DataFrame, centre: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """k, mean, sem and n over recordings of each recording's `centre` at k."""
    sub = ep.groupBy("recording_id", "k").agg(statistic(centre, F.col("v")).alias("m"))
    return sub.groupBy("k").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n"))


def summary(ep: DataFrame) -> DataFrame:
    """recording_id, n_epochs, n_points, k_min, k_max, missing (percentage)."""
    return ep.groupBy("recording_id").agg(
        F.count_distinct("event_id").alias("n_epochs"), F.count_distinct("k").alias("n_points"), F.min("k").alias("k_min"), F.max("k").alias("k_max"),
        (100 * F.avg(F.col("v").isNull().cast("double"))).alias("missing"),
    )

"""Operators on samples: (recording_id, i, t_ms, signals, masks `<signal>__m`).

Missing values are null. All windows share one partitioning and order, so several of them
cost one shuffle and sort. Masks travel with their signal unless an operator says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.kernels import smoothing_weights
from saccadia.functions.units import to_unit


def by():
    return Window.partitionBy("recording_id")


def ordered():
    return by().orderBy("i")


def mask_of(signal: str) -> str:
    return f"{signal}__m"


def visible(signal: str) -> Column:
    """The signal where it isn't masked."""
    return F.when(~F.col(mask_of(signal)), F.col(signal))


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """Adds the sample index i from 0 in the given order."""
    return df.withColumn("i", (F.row_number().over(by().orderBy(*order)) - 1).cast("long"))


def ingest(df: DataFrame, signals: list[str]) -> DataFrame:
    """NaN to null, pupil zeros to null, and a mask where a value is missing."""
    out = {}
    for s in signals:
        v = F.nanvl(F.col(s).cast("double"), F.lit(None))
        out[s] = F.when(v != 0, v) if "pupil" in s else v
    df = df.withColumns(out)
    return df.withColumns({mask_of(s): F.col(s).isNull() for s in signals})


def sub_slice(df: DataFrame, start: float, end: float, factor: float = 1.0) -> DataFrame:
    """Samples with start <= t <= end in a unit of `factor` per ms; i starts at 0 again."""
    t = F.col("t_ms") * factor
    return df.filter((t >= start) & (t <= end)).withColumn("i", (F.row_number().over(ordered()) - 1).cast("long"))


def slice_with(df: DataFrame, events: DataFrame, store: DataFrame | None, start: float, end: float, factor: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """sub_slice() of the samples, the events within the same times, and stored intervals on the new sample index.

    Intervals (in sample indices) are cut at the slice's ends; those that lie outside go. A
    recording without a sample left loses its events and intervals too.
    """
    t = F.col("t_ms") * factor
    kept = df.filter((t >= start) & (t <= end))
    edges = kept.groupBy("recording_id").agg(F.min("i").alias("_first"), F.count("*").alias("_n"))
    inside = events.filter((t >= start) & (t <= end)).join(edges.select("recording_id"), "recording_id", "left_semi")
    if store is not None:
        cut = store.join(edges, "recording_id").withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - F.col("_first")), "end": F.least(F.col("_n").cast("double"), F.col("end") - F.col("_first"))})
        store = cut.filter("end > start").select(store.columns)
    return sub_slice(df, start, end, factor), inside, store


def reset_time(df: DataFrame, t0: float | None = None) -> DataFrame:
    return df.withColumn("t_ms", F.col("t_ms") - (F.min("t_ms").over(by()) if t0 is None else t0))


def reset_time_with(df: DataFrame, events: DataFrame, t0: float | None = None) -> tuple[DataFrame, DataFrame]:
    """samples and events moved alike: by t0, or so that each recording's first sample is at 0."""
    if t0 is not None:
        return reset_time(df, t0), reset_time(events, t0)
    start = df.groupBy("recording_id").agg(F.min("t_ms").alias("_t0"))
    return reset_time(df), events.join(start, "recording_id").withColumn("t_ms", F.col("t_ms") - F.col("_t0")).drop("_t0")


def duration(df: DataFrame, unit: str = "min") -> DataFrame:
    """recording_id, step_ms (the median time step), duration: samples times the step."""
    step = df.withColumn("step", F.col("t_ms") - F.lag("t_ms").over(ordered()))
    a = step.groupBy("recording_id").agg(F.median("step").alias("step_ms"), F.count("*").alias("n"))
    return a.select("recording_id", "step_ms", to_unit(F.col("n") * F.col("step_ms"), unit).alias("duration"))


def sampling_rate(df: DataFrame) -> DataFrame:
    """recording_id, fs: 1000 over the median time step, rounded."""
    step = df.withColumn("step", F.col("t_ms") - F.lag("t_ms").over(ordered()))
    return step.groupBy("recording_id").agg(F.round(1000 / F.median("step")).alias("fs"))


def summary(df: DataFrame, signals: list[str]) -> DataFrame:
    per = [F.sum(F.col(mask_of(s)).cast("long")).alias(f"{s}_masked") for s in signals]
    return df.groupBy("recording_id").agg(F.count("*").alias("n"), F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"), *per)


def scale_params(df: DataFrame, signals: list[str]) -> DataFrame:
    """Mean and population sd of each signal, masked samples included."""
    aggs = [f(s).alias(f"{s}_{n}") for s in signals for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return df.groupBy("recording_id").agg(*aggs)


def scale(df: DataFrame, signals: list[str], mean: float | None = None, sd: float | None = None) -> DataFrame:
    def one(s):
        m = F.avg(s).over(by()) if mean is None else F.lit(mean)
        d = F.stddev_pop(s).over(by()) if sd is None else F.lit(sd)
        return F.when(d != 0, (F.col(s) - m) / d)

    return df.withColumns({s: one(s) for s in signals})


def unscale(df: DataFrame, params: DataFrame, signals: list[str]) -> DataFrame:
    joined = df.join(params, "recording_id")
    return joined.withColumns({s: F.col(s) * F.col(f"{s}_sd") + F.col(f"{s}_mean") for s in signals}).select(df.columns)


def downsample(df: DataFrame, signals: list[str], by: int) -> DataFrame:
    """Means over blocks of `by` samples, the last one short; a block's mask is any of its masks."""
    block = F.floor(F.col("i") / by)
    aggs = [F.avg("t_ms").alias("t_ms"), *[F.avg(s).alias(s) for s in signals], *[F.bool_or(mask_of(s)).alias(mask_of(s)) for s in signals]]
    return df.groupBy("recording_id", block.alias("i")).agg(*aggs)


def downsample_to(df: DataFrame, signals: list[str], fs: float, target: float) -> DataFrame:
    """downsample() by the whole part of fs over the target rate."""
    if target > fs:
        raise ValueError("the target rate is over the recording's")
    return downsample(df, signals, int(fs / target))


def merge_eyes(df: DataFrame, left: str, right: str, out: str, keep: bool = True) -> DataFrame:
    """Mean of the unmasked eyes; masked only where both are. `keep` keeps the eyes."""
    a, b = visible(left), visible(right)
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    mean = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / n
    done = df.withColumns({out: F.when(n > 0, mean), mask_of(out): n == 0})
    return done if keep else done.drop(left, right, mask_of(left), mask_of(right))


def merge_masks(df: DataFrame, signals: list[str]) -> DataFrame:
    any_of = reduce(lambda x, y: x | y, [F.col(mask_of(s)) for s in signals])
    return df.withColumns({mask_of(s): any_of for s in signals})


def fill_gaps(df: DataFrame, signals: list[str], wide: float = 2.0) -> DataFrame:
    """Adds masked rows on the median step's grid where a step is over `wide` medians."""
    steps = df.withColumn("before", F.lag("t_ms").over(ordered())).withColumn("step", F.col("t_ms") - F.col("before"))
    median = steps.groupBy("recording_id").agg(F.median("step").alias("usual"))
    gaps = steps.join(median, "recording_id").filter((F.col("usual") > 0) & (F.col("step") > wide * F.col("usual")))
    n = F.ceil(F.col("step") / F.col("usual") - 1e-9).cast("long") - 1
    rows = gaps.select("recording_id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k"), "before", "usual").select(
        "recording_id", (F.col("before") + F.col("k") * F.col("usual")).alias("t_ms"), *[F.lit(None).cast("double").alias(s) for s in signals], *[F.lit(True).alias(mask_of(s)) for s in signals]
    )
    keep = df.select("recording_id", "t_ms", *signals, *[mask_of(s) for s in signals])
    return indexed(keep.unionByName(rows), "t_ms")


def fir(signal: str, weights: list[float], first: int) -> Column:
    """Sum of weights[k] * sample[i + first + k]; beyond the ends the edge sample. Null where a sample in the window is null."""
    n = F.count("*").over(by())
    whole = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head, tail = F.first(signal).over(whole), F.last(signal).over(whole)

    def at(k):
        v = F.lead(signal, k).over(ordered()) if k >= 0 else F.lag(signal, -k).over(ordered())
        return F.when(F.col("i") + k < 0, head).when(F.col("i") + k > n - 1, tail).otherwise(v)

    return reduce(lambda x, y: x + y, [w * at(first + k) for k, w in enumerate(weights)])


def mirrored_fir(df: DataFrame, signal: str, weights: list[float], out: str) -> DataFrame:
    """Centred weights over the samples and their mirror image beyond both ends: the few rows that the
    windows at the ends reach are added once, then each weight is one lag or lead."""
    reach, i = len(weights) // 2, F.col("i")
    n = F.count("*").over(by())
    places = F.array_compact(F.array(i, F.when((i >= 1) & (i <= reach), -i), F.when((i <= F.col("_n") - 2) & (i >= F.col("_n") - 1 - reach), 2 * (F.col("_n") - 1) - i)))
    rows = df.withColumn("_n", n).withColumn("_j", F.explode(places))
    w = by().orderBy("_j")
    at = lambda k: F.lead(signal, k).over(w) if k >= 0 else F.lag(signal, -k).over(w)
    value = reduce(lambda x, y: x + y, [c * at(k - reach) for k, c in enumerate(weights)])
    return rows.withColumn("_value", value).filter("_j = i").withColumn(out, F.col("_value")).drop("_n", "_j", "_value")


def smooth(df: DataFrame, signal: str, length: int, shape: str = "hanning", direction: str = "center", strict: bool = True) -> DataFrame:
    """Smoothing by a normalised window: centred with mirrored ends, or over the past or future with the edge repeated.

    A centred window of even length leans to the past. Windows under 3 change nothing. A missing sample, or a
    recording shorter than the window, is an error when the result is read; unless `strict`, a window with a
    missing sample gives null.
    """
    if direction not in ("center", "backward", "forward"):
        raise ValueError("direction is 'center', 'backward' or 'forward'")
    if length < 3:
        return df
    w = smoothing_weights(shape, length)
    if strict:
        short = F.count("*").over(by()) < length
        bad = F.when(F.col(signal).isNull(), F.lit("a missing sample")).when(short, F.lit("a recording shorter than the window"))
        df = df.withColumn(signal, F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(F.col(signal)))
    if direction == "center":
        return mirrored_fir(df, signal, w if length % 2 else [*w, 0.0], signal)
    return df.withColumn(signal, fir(signal, w, -(length - 1) if direction == "backward" else 0))


def smooth_ms(df: DataFrame, signal: str, fs: float, width_ms: float = 11, shape: str = "hanning", direction: str = "center") -> DataFrame:
    """smooth() with a window in milliseconds, rounded up to samples; the mask stays."""
    return smooth(df, signal, -int(-width_ms / 1000 * fs // 1), shape, direction)


def filled_linear(df: DataFrame, signal: str, out: str) -> DataFrame:
    """Linear interpolation over missing values by index; ends take the nearest value."""
    before, after = ordered().rowsBetween(Window.unboundedPreceding, 0), ordered().rowsBetween(0, Window.unboundedFollowing)
    there = F.when(F.col(signal).isNotNull(), F.col("i"))
    df = df.withColumns({
        "_i0": F.last(there, True).over(before), "_v0": F.last(signal, True).over(before),
        "_i1": F.first(there, True).over(after), "_v1": F.first(signal, True).over(after),
    })
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    value = F.when(F.col(signal).isNotNull(), F.col(signal)).when(F.col("_i0").isNull(), F.col("_v1")).when(F.col("_i1").isNull(), F.col("_v0")).otherwise(line)
    return df.withColumn(out, value).drop("_i0", "_v0", "_i1", "_v1")

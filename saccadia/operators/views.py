"""The data behind charts of recordings: bins, paths, segments, levels of detail, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.functions.tables import written
from saccadia.functions.units import to_unit
from saccadia.operators import columns
from saccadia.operators import intervals as iv
from saccadia.operators.samples import by, mask_of


def bins(df: DataFrame, x: Column, y: Column, low: float, high: float, n: int, value: Column | None = None, least: int = 1) -> DataFrame:
    """bx, by, n and the mean of `value` in n x n bins of [low, high]; the last bin is closed; bins of under `least` samples are left out."""
    width = (high - low) / n
    at = lambda c: F.least(F.floor((c - low) / width), F.lit(n - 1)).cast("long")
    inside = df.filter(x.between(low, high) & y.between(low, high))
    aggs = [F.count("*").alias("n")] + ([F.avg(value).alias("mean")] if value is not None else [])
    return inside.groupBy(at(x).alias("bx"), at(y).alias("by")).agg(*aggs).filter(F.col("n") >= least)


def progress(df: DataFrame) -> Column:
    """How far a sample is through its recording, 0 to 1."""
    lo, hi = F.min("t_ms").over(by()), F.max("t_ms").over(by())
    return (F.col("t_ms") - lo) / F.when(hi != lo, hi - lo)


def segments(df: DataFrame, length: float, unit: str = "min") -> DataFrame:
    """Adds segment: the number of the stretch of `length` that a sample lies in, from the recording's first one."""
    t = to_unit(F.col("t_ms") - F.min("t_ms").over(by()), unit)
    return df.withColumn("segment", F.floor(t / length).cast("long"))


def labels_at_samples(events: DataFrame, samples: DataFrame, start: float, end: float) -> DataFrame:
    """Events within [start, end) ms with i of their nearest sample and what it holds."""
    there = iv.nearest_index(events.filter((F.col("t_ms") >= start) & (F.col("t_ms") < end)), samples)
    return there.select("recording_id", "event_id", "i").join(events.select("recording_id", "event_id", "label"), ["recording_id", "event_id"]).join(samples.drop("t_ms", "label", "event_id"), ["recording_id", "i"])


def in_plot_range(df: DataFrame, start: float, end: float, unit: str = "ms") -> DataFrame:
    """recording_id and whether the range overlaps the recording; a range that ends before it starts is an error."""
    if not start < end:
        raise ValueError("a range begins before it ends")
    lo, hi = to_unit(F.min("t_ms"), unit), to_unit(F.max("t_ms"), unit)
    return df.groupBy("recording_id").agg(((lo <= end) & (hi >= start)).alias("overlaps"))


def levels(df: DataFrame, signal: str, factors: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """recording_id, factor, chunk, pos (0, 1), t_ms, value, masked: the smallest and the largest sample of each
    whole chunk of `factor` samples, in the order of time; the first chunk is always there. A chunk without a
    value gives its ends, null."""
    m = mask_of(signal)
    n = df.groupBy("recording_id").agg(F.count("*").alias("_n"))
    rows = df.select("recording_id", "i", "t_ms", F.col(signal).alias("v"), F.col(m).alias("m")).join(n, "recording_id")
    rows = rows.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors]))).withColumn("chunk", F.floor(F.col("i") / F.col("factor")).cast("long"))
    rows = rows.filter(F.col("chunk") < F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("factor"))))
    one = F.struct("i", "t_ms", F.col("v").alias("value"), F.col("m").alias("masked"))
    there = F.when(F.col("v").isNotNull(), F.struct("v", F.negative("i").alias("late")))
    # of equal values the first counts on both sides
    low = F.coalesce(F.min_by(one, F.when(F.col("v").isNotNull(), F.struct("v", "i"))), F.min_by(one, "i"))
    high = F.coalesce(F.max_by(one, there), F.max_by(one, "i"))
    ends = rows.groupBy("recording_id", "factor", "chunk").agg(F.sort_array(F.array(low, high)).alias("two"))
    return ends.select("recording_id", "factor", "chunk", F.posexplode("two").alias("pos", "s")).select("recording_id", "factor", "chunk", F.col("pos").cast("long").alias("pos"), F.col("s.t_ms").alias("t_ms"), F.col("s.value").alias("value"), F.col("s.masked").alias("masked"))


def pyramid(df: DataFrame, signal: str, factors: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """recording_id, factor, chunk, pos (0, 1), t_ms, normal, masked: levels() as two lines, of samples that aren't masked and that are.

    Each factor is a multiple of the one before, and each level is made from the one below
    it, so samples are read once: a level has a row for each of its chunks.
    """
    if not factors or any(b % a or b == a for a, b in zip(factors, factors[1:], strict=False)):
        raise ValueError("each factor is a multiple of the one before")
    m, ends = mask_of(signal), df.groupBy("recording_id").agg(F.count("*").alias("_n"))
    v, here = F.col(signal), F.struct("i", "t_ms", F.col(signal).alias("value"), F.col(m).alias("masked"))
    # least and largest with the first of equal values, first and last for chunks without a value
    least, most = F.struct(v.alias("v"), F.col("i").alias("i")), F.struct(v.alias("v"), F.negative("i").alias("i"))
    there = lambda x: F.when(v.isNotNull(), x)
    level = df.groupBy("recording_id", F.floor(F.col("i") / factors[0]).cast("long").alias("chunk")).agg(
        F.min(there(F.struct(least.alias("k"), here.alias("s")))).alias("low"), F.max(there(F.struct(most.alias("k"), here.alias("s")))).alias("high"), F.min(here).alias("first"), F.max(here).alias("last")
    )
    out = None
    for k, factor in enumerate(factors):
        if k:
            level = below.groupBy("recording_id", F.floor(F.col("chunk") / (factor // factors[k - 1])).cast("long").alias("chunk")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"))
        below = written(level, f"level-{factor}")
        whole = below.join(ends, "recording_id").filter(F.col("chunk") < F.greatest(F.lit(1), F.floor(F.col("_n") / factor)))
        two = F.sort_array(F.array(F.coalesce("low.s", "first"), F.coalesce("high.s", "last")))
        rows = whole.select("recording_id", F.lit(factor).alias("factor"), "chunk", F.posexplode(two).alias("pos", "s"))
        line = rows.select("recording_id", "factor", "chunk", F.col("pos").cast("long").alias("pos"), "s.t_ms", F.when(~F.col("s.masked"), F.col("s.value")).alias("normal"), F.when(F.col("s.masked"), F.col("s.value")).alias("masked"))
        out = line if out is None else out.unionByName(line)
    return out


def mask_timelines(df: DataFrame, merge: bool = False) -> DataFrame:
    """[start, end) index runs of masked samples of every signal as `key`, or of any signal."""
    if merge:
        return iv.runs(df, columns.mask(df)).select("recording_id", F.lit("any").alias("key"), "start", "end")
    out = None
    for s in columns.signals(df):
        one = iv.runs(df, F.col(mask_of(s))).select("recording_id", F.lit(s).alias("key"), "start", "end")
        out = one if out is None else out.unionByName(one)
    return out


def blink_windows(store: DataFrame, samples: DataFrame, before: float, after: float) -> DataFrame:
    """Stored intervals of all signals, padded by samples and held to the recording."""
    n = samples.groupBy("recording_id").agg(F.count("*").cast("double").alias("_n"))
    return iv.pad(store.join(n, "recording_id"), before, after, F.lit(0.0), F.col("_n")).drop("_n")

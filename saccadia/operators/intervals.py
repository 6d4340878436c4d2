"""Interval algebra: (recording_id, start, end[, label]), half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.units import from_unit, normalize_unit, to_unit


def by():
    return Window.partitionBy("recording_id")


def around_events(events: DataFrame, before: float, after: float) -> DataFrame:
    """[t + before, t + after) for each event."""
    if before >= after:
        raise ValueError("the interval ends before it starts")
    return events.select("recording_id", "event_id", "label", F.col("t_ms").alias("onset"), (F.col("t_ms") + before).alias("start"), (F.col("t_ms") + after).alias("end"))


def nearest_index(events: DataFrame, samples: DataFrame) -> DataFrame:
    """events with i of the nearest sample in time: the earlier one on a tie, the first of samples at one time.

    Both sides in one sorted stream per recording, no pairs.
    """
    marks = samples.groupBy("recording_id", "t_ms").agg(F.min("i").cast("long").alias("si")).withColumn("event_id", F.lit(None).cast("long"))
    asks = events.select("recording_id", "t_ms", F.lit(None).cast("long").alias("si"), F.col("event_id").cast("long").alias("event_id"))
    w = by().orderBy("t_ms", F.col("event_id").asc_nulls_first())
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = F.when(F.col("si").isNotNull(), F.col("t_ms"))
    both = marks.unionByName(asks).withColumns({
        "i0": F.last("si", True).over(back), "t0": F.last(t, True).over(back), "i1": F.first("si", True).over(ahead), "t1": F.first(t, True).over(ahead),
    }).filter("event_id is not null")
    near = F.when(F.col("i1").isNull() | (F.col("t_ms") - F.col("t0") <= F.col("t1") - F.col("t_ms")), F.col("i0")).otherwise(F.col("i1"))
    return both.select("recording_id", "event_id", "t_ms", near.alias("i"))


def around_samples(events: DataFrame, samples: DataFrame, before: int, after: int) -> DataFrame:
    """[i + before, i + after) around the nearest sample of each event, held to [0, n]."""
    if before >= after:
        raise ValueError("the interval ends before it starts")
    n = samples.groupBy("recording_id").agg(F.count("*").alias("_n"))
    at = nearest_index(events, samples).join(n, "recording_id")
    return at.select("recording_id", "event_id", F.col("i").alias("onset"), F.greatest(F.lit(0), F.col("i") + before).alias("start"), F.least(F.col("_n"), F.col("i") + after).alias("end"))


def between_events(starts: DataFrame, ends: DataFrame, strict: bool = True) -> DataFrame:
    """The k-th start with the k-th end of each recording.

    Unequal numbers are an error when the result is read, or what is left over goes unpaired.
    """
    def rank(df, name):
        w = by().orderBy("t_ms", "event_id")
        return df.select("recording_id", F.row_number().over(w).alias("k"), F.col("t_ms").alias(name))

    if not strict:
        return rank(starts, "start").join(rank(ends, "end"), ["recording_id", "k"])
    both = rank(starts, "start").join(rank(ends, "end"), ["recording_id", "k"], "full")
    odd = F.col("start").isNull() | F.col("end").isNull()
    return both.filter(F.when(odd, F.raise_error(F.lit("unequal numbers of starts and ends")).cast("boolean")).otherwise(F.lit(True)))


def in_unit(iv: DataFrame, unit: str | None, to: str | None, fs: Column | float, t0: Column | float = 0.0) -> DataFrame:
    """Intervals from one unit to another; None is the sample index at `fs` samples a second, of which t0 (ms) is the first.

    Times become indices by rounding half to even.
    """
    unit, to = normalize_unit(unit), normalize_unit(to)
    fs, t0 = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (fs, t0))

    def one(c):
        if unit == to:
            return F.col(c)
        ms = F.col(c) * 1000 / fs + t0 if unit is None else from_unit(F.col(c), unit)
        return F.bround((ms - t0) * fs / 1000).cast("long") if to is None else to_unit(ms, to)

    return iv.withColumns({"start": one("start"), "end": one("end")})


def concatenated(*sets: DataFrame, label: str | None = None) -> DataFrame:
    """All intervals of several sets in one unit; columns that a set lacks are null; `label` names them all."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out if label is None else out.withColumn("label", F.lit(label))


def added(a: DataFrame, b: DataFrame, unit: str, unit_b: str) -> DataFrame:
    """a, in `unit`, with the intervals of b, in `unit_b`; times and indices don't add."""
    if (normalize_unit(unit) is None) != (normalize_unit(unit_b) is None):
        raise ValueError("times and sample indices don't add")
    return concatenated(a, b if normalize_unit(unit) == normalize_unit(unit_b) else in_unit(b, unit_b, unit, 1000.0))


def nth(iv: DataFrame, k: int) -> DataFrame:
    """The interval at place k (from 0) of each recording, in order of start and end."""
    return iv.withColumn("_k", F.row_number().over(by().orderBy("start", "end")) - 1).filter(F.col("_k") == k).drop("_k")


def as_table(iv: DataFrame, unit: str | None) -> DataFrame:
    """Intervals with their duration and the name of their unit."""
    return iv.withColumns({"duration": F.col("end") - F.col("start"), "units": F.lit(normalize_unit(unit) or "indices")})


STATISTICS = {
    "mean": F.avg, "median": F.median, "sd": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max, "sum": F.sum, "n": F.count,
    "sem": lambda v: F.stddev_samp(v) / F.sqrt(F.count(v)),
}


def statistic(stat, value: Column) -> Column:
    """An aggregate by its name in STATISTICS, or by a function of a column (also a grouped-agg pandas UDF)."""
    if callable(stat):
        return stat(value)
    if stat not in STATISTICS:
        raise ValueError(f"no statistic {stat!r}; there are {', '.join(STATISTICS)}")
    return STATISTICS[stat](value)


def stat_per_event(samples: DataFrame, iv: DataFrame, signals: list[str], stat="mean", honour_mask: bool = False) -> DataFrame:
    """recording_id, event_id and a statistic of each signal over [start, end) in ms.

    The bounds are the samples nearest to start and end; an interval that shrinks to nothing takes
    one sample. Missing values don't count. Samples meet intervals in buckets of their index.
    """
    first = nearest_index(iv.select("recording_id", "event_id", F.col("start").alias("t_ms")), samples).select("recording_id", "event_id", F.col("i").alias("start"))
    last = nearest_index(iv.select("recording_id", "event_id", F.col("end").alias("t_ms")), samples).select("recording_id", "event_id", F.col("i").alias("end"))
    spans = first.join(last, ["recording_id", "event_id"]).withColumn("end", F.when(F.col("end") == F.col("start"), F.col("end") + 1).otherwise(F.col("end")))
    value = lambda s: F.when(~F.col(f"{s}__m"), F.col(s)) if honour_mask else F.col(s)
    rows = samples.select("recording_id", "i", *[value(s).alias(s) for s in signals])
    return samples_in(rows, spans, "i", 256).groupBy("recording_id", "event_id").agg(*[statistic(stat, F.col(s)).alias(s) for s in signals])


def subtotals(df: DataFrame, keys: list[str], value: str, stats: tuple[str, ...] = ("n", "mean", "min", "max"), cross: bool = False) -> DataFrame:
    """Statistics of a value by all keys, by fewer of them from the right (or, with `cross`, by any of them) and over all.

    One pass over the rows for all of these. `grouping` has a bit for each key, the first one
    highest: 1 where the row is over all values of that key, which is null there.
    """
    groups = df.cube(*keys) if cross else df.rollup(*keys)
    return groups.agg(F.grouping_id().alias("grouping"), *[statistic(s, F.col(value)).alias(s) for s in stats])


def masked(samples: DataFrame, iv: DataFrame, signals: list[str], at: str = "i") -> DataFrame:
    """samples with the masks of the signals set inside the intervals."""
    hit = covered(samples, iv, at, "_hit")
    return hit.withColumns({f"{s}__m": F.col(f"{s}__m") | F.col("_hit") for s in signals}).drop("_hit").select(samples.columns)


def merge(iv: DataFrame, distance: float = 0.0) -> DataFrame:
    """Joins intervals that overlap, touch or lie within `distance`; counts what went in."""
    w = by().orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach + distance, F.lit(True)).cast("int")
    return (
        iv.withColumn("new", new).withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("recording_id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("group")
    )


def merge_labels(iv: DataFrame, distance: float = 0.0, sep: str = "_") -> DataFrame:
    """merge() with the labels joined in order of start."""
    w = by().orderBy("start", "end", "label")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach + distance, F.lit(True)).cast("int")
    one = F.struct("start", "end", "label")
    return (
        iv.withColumn("new", new).withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("recording_id", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["label"]), sep).alias("label"))
        .drop("group")
    )


def sweep(a: DataFrame, b: DataFrame, keep: str) -> DataFrame:
    """Stretches where in_a and in_b meet the condition `keep`, joined where they touch.

    An endpoint sweep: +1 and -1 rows of both sets, running sums, no expansion to samples.
    """
    def ends(df, side):
        d = df.filter("end > start")
        up = [d.select("recording_id", F.col(x).alias("t"), F.lit(s if side == "a" else 0).alias("da"), F.lit(s if side == "b" else 0).alias("db")) for x, s in (("start", 1), ("end", -1))]
        return up[0].unionByName(up[1])

    deltas = ends(a, "a").unionByName(ends(b, "b")).groupBy("recording_id", "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = by().orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = deltas.select("recording_id", F.col("t").alias("start"), F.lead("t").over(w).alias("end"), (F.sum("da").over(upto) > 0).alias("in_a"), (F.sum("db").over(upto) > 0).alias("in_b"))
    return merge(pieces.filter(F.expr(keep) & F.col("end").isNotNull()).select("recording_id", "start", "end")).drop("parts")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, "in_a and not in_b")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, "in_a and in_b")


def pad(iv: DataFrame, left: float, right: float, lo: Column, hi: Column) -> DataFrame:
    return iv.withColumns({"start": F.greatest(lo, F.col("start") - left), "end": F.least(hi, F.col("end") + right)})


def select(iv: DataFrame, min_duration=None, max_duration=None, time_range=None, where: Column | None = None) -> DataFrame:
    """Durations within bounds (inclusive), strict overlap with time_range, and a predicate."""
    d = F.col("end") - F.col("start")
    if min_duration is not None:
        iv = iv.filter(d >= min_duration)
    if max_duration is not None:
        iv = iv.filter(d <= max_duration)
    if time_range is not None:
        iv = iv.filter((F.col("end") > time_range[0]) & (F.col("start") < time_range[1]))
    return iv if where is None else iv.filter(where)


def stats(iv: DataFrame) -> DataFrame:
    d = F.col("end") - F.col("start")
    return iv.groupBy("recording_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.min(d).alias("min"), F.max(d).alias("max"), F.sum(d).alias("total"))


def runs(samples: DataFrame, flag: Column, time: str = "i") -> DataFrame:
    """[start, end) index runs of the samples where flag holds (gaps and islands)."""
    hit = samples.filter(flag).withColumn("island", F.col("i") - F.row_number().over(by().orderBy("i")))
    return hit.groupBy("recording_id", "island").agg(F.min(time).alias("start"), (F.max(time) + 1).alias("end")).drop("island")


def covered(samples: DataFrame, iv: DataFrame, at: str = "i", out: str = "hit") -> DataFrame:
    """samples with whether they lie in an interval: starts and ends join the sorted stream as +1 and -1."""
    d = iv.filter("end > start")
    marks = d.select("recording_id", F.col("start").alias(at), F.lit(1).alias("_d")).unionByName(d.select("recording_id", F.col("end").alias(at), F.lit(-1).alias("_d")))
    both = samples.withColumn("_d", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    w = by().orderBy(F.col(at), F.col("_d").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.coalesce(F.sum("_d").over(w), F.lit(0)) > 0
    return both.withColumn(out, open_).filter("_d is null").drop("_d")


def samples_in(samples: DataFrame, iv: DataFrame, at: str = "t_ms", bucket: float = 1.0) -> DataFrame:
    """samples joined to the intervals that hold them: buckets of `bucket` make it an equality join."""
    wide = iv.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    s = samples.withColumn("_b", F.floor(F.col(at) / bucket))
    return s.join(wide, ["recording_id", "_b"]).filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_b")

"""Blinks: detection, merging and reconstruction. Intervals are half-open sample indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.kernels import slope_weights
from saccadia.operators import intervals as iv
from saccadia.operators.samples import by, filled_linear, fir, mask_of, ordered


def zero_blinks(df: DataFrame, signal: str, shortest: int) -> DataFrame:
    """[start, end) runs of missing or zero samples of at least `shortest` + 1; a run at the end is open and dropped."""
    n = df.groupBy("recording_id").agg(F.count("*").alias("n"))
    found = iv.runs(df, F.col(signal).isNull() | (F.col(signal) == 0))
    return found.join(n, "recording_id").filter((F.col("end") < F.col("n")) & (F.col("end") - 1 - F.col("start") >= shortest)).drop("n")


def velocity(df: DataFrame, signal: str, length: int, at: int = 0, out: str = "velocity") -> DataFrame:
    """Quadratic least-squares slope in a centred window, taken `at` samples from its centre; edges repeat."""
    return df.withColumn(out, fir(signal, slope_weights(length, at), -(length // 2)))


def slopes(df: DataFrame, signal: str, length: int) -> DataFrame:
    """Adds _back and _fore: the slope at the last and at the first sample of the centred window."""
    return velocity(velocity(df, signal, length, length // 2, "_back"), signal, length, -(length // 2), "_fore")


def thresholds(df: DataFrame, signal: str, fs: float, length: int, on: float | str, off: float | str) -> DataFrame:
    """df with on_v and off_v in units a sample: from units a millisecond, or for 'p%' the percentile of the
    centred slope over the recording's valid samples, missing ones filled by lines."""
    def one(v, name):
        if isinstance(v, str) and v.strip().endswith("%"):
            return F.percentile(F.when(valid, F.col("_v")), float(v.strip()[:-1]) / 100).alias(name)
        return F.lit(float(v) * 1000 / fs).alias(name)

    valid = F.col(signal).isNotNull() & (F.col(signal) != 0)
    if not any(isinstance(v, str) for v in (on, off)):
        return df.withColumns({"on_v": F.lit(float(on) * 1000 / fs), "off_v": F.lit(float(off) * 1000 / fs)})
    filled = filled_linear(df.withColumn("_s", F.when(valid, F.col(signal))), "_s", "_f")
    per = velocity(filled, "_f", length, 0, "_v").groupBy("recording_id").agg(F.count("*"), one(on, "on_v"), one(off, "off_v"))
    return df.join(per.select("recording_id", "on_v", "off_v"), "recording_id")


def _column(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def velocity_blinks(df: DataFrame, signal: str, length: int, on: float | Column, off: float | Column, shortest_on: int = 1, shortest_off: int = 1) -> DataFrame:
    """From the onset of a fast fall to the first offset of a fast rise after it, then from the next onset beyond that.

    Onsets are the first samples of runs, longer than `shortest_on`, of slopes <= on (`_back`); offsets the
    first ones of runs, longer than `shortest_off`, of slopes >= off (`_fore`). Missing and zero samples are
    filled by lines and have no slope of their own. Without a later offset a blink ends with the recording;
    a recording without any offset has none. Ends that lie in missing samples grow to the next valid one.
    """
    bad = F.col(signal).isNull() | (F.col(signal) == 0)
    filled = filled_linear(df.withColumn("_s", F.when(~bad, F.col(signal))), "_s", "_f")
    v = slopes(filled, "_f", length)
    zero = F.when(F.col("_s").isNull(), F.lit(0.0))
    a = iv.runs(v, F.coalesce(zero, F.col("_back")) <= _column(on)).filter(F.col("end") - F.col("start") > shortest_on)
    b = iv.runs(v, F.coalesce(zero, F.col("_fore")) >= _column(off)).filter(F.col("end") - F.col("start") > shortest_off)
    sized = v.groupBy("recording_id").agg(F.count("*").alias("n"))
    marks = a.select("recording_id", F.col("start").alias("i"), F.lit(True).alias("on")).unionByName(b.select("recording_id", F.col("start").alias("i"), F.lit(False).alias("on")))
    later = by().orderBy("i").rangeBetween(1, Window.unboundedFollowing)
    some = F.max(~F.col("on")).over(by())
    onsets = marks.withColumns({"off": F.min(F.when(~F.col("on"), F.col("i"))).over(later), "some": some}).filter("on and some").join(sized, "recording_id")
    onsets = onsets.withColumn("off", F.coalesce("off", "n"))
    # of the onsets with one offset the first counts - unless it stands on the offset of the group before, and that is taken
    following = F.lead("i").over(Window.partitionBy("recording_id", "off").orderBy("i"))
    groups = onsets.withColumn("next", following).groupBy("recording_id", "n", "off").agg(F.min("i").alias("first"), F.min_by("next", "i").alias("second"))
    w = by().orderBy("off")
    groups = groups.withColumn("shared", F.coalesce(F.col("first") == F.lag("off").over(w), F.lit(False))).withColumn("only", F.col("shared") & F.col("second").isNull())
    # onsets that are alone on a shared sample alternate: each counts if the one before it doesn't
    run = groups.withColumn("k", F.row_number().over(w)).withColumn("since", F.col("k") - F.max(F.when(~F.col("only"), F.col("k"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    taken = run.withColumn("taken", F.col("since") % 2 == 0)
    before = F.coalesce(F.lag("taken").over(w), F.lit(False))
    found = taken.withColumn("start", F.when(F.col("shared") & before & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("first"))).filter("taken")
    return grown(found.select("recording_id", "start", F.col("off").alias("end")), df, bad)


def grown(blinks: DataFrame, df: DataFrame, bad: Column) -> DataFrame:
    """Starts moved back and ends moved on to a sample that isn't `bad`, within the recording."""
    s = df.select("recording_id", "i", bad.alias("bad"))
    back, ahead = ordered().rowsBetween(Window.unboundedPreceding, 0), ordered().rowsBetween(0, Window.unboundedFollowing)
    good = F.when(~F.col("bad"), F.col("i"))
    s = s.withColumns({"lo": F.coalesce(F.max(good).over(back), F.lit(0)), "hi": F.coalesce(F.min(good).over(ahead), F.max("i").over(by()))})
    at = blinks.join(s.select("recording_id", F.col("i").alias("start"), "lo"), ["recording_id", "start"]).join(s.select("recording_id", F.col("i").alias("end"), "hi"), ["recording_id", "end"], "left")
    return at.select("recording_id", F.col("lo").alias("start"), F.coalesce("hi", "end").alias("end"))


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Onsets and offsets of two sets sorted apart, paired by rank, and joined where they touch."""
    both = a.select("recording_id", "start", "end").unionByName(b.select("recording_id", "start", "end"))
    on = both.select("recording_id", "start", F.row_number().over(by().orderBy("start")).alias("k"))
    off = both.select("recording_id", "end", F.row_number().over(by().orderBy("end")).alias("k"))
    return iv.merge(on.join(off, ["recording_id", "k"]).drop("k")).drop("parts")


def detect(
    df: DataFrame, signal: str, fs: float, min_duration: float = 20, winsize: float = 11, on: float | str = -5.0, off: float | str = 5.0,
    on_duration: float = 5, off_duration: float = 5, strategies: tuple[str, ...] = ("zero", "velocity"), honour_mask: bool = True,
) -> DataFrame:
    """Blinks by runs of missing samples, by slopes or by both, of at least `min_duration`; durations in ms.

    Slopes are given in units a millisecond or as percentiles ('5%'). Masked samples count as
    missing unless `honour_mask` is false.
    """
    if odd := set(strategies) - {"zero", "velocity"}:
        raise ValueError(f"unknown strategies: {sorted(odd)}")
    if honour_mask:
        df = df.withColumn(signal, F.when(~F.col(mask_of(signal)), F.col(signal)))
    samples = lambda ms: int(ms / 1000 * fs)
    length = max(3, samples(winsize) | 1)
    found = None
    if "velocity" in strategies:
        limited = thresholds(df, signal, fs, length, on, off)
        found = velocity_blinks(limited, signal, length, F.col("on_v"), F.col("off_v"), max(1, samples(on_duration)), max(1, samples(off_duration)))
    if "zero" in strategies:
        zero = zero_blinks(df, signal, 1)
        found = zero if found is None else merge_sorted(found, zero)
    return found.filter(F.col("end") - F.col("start") >= samples(min_duration))


def refine(df: DataFrame, blinks: DataFrame, signal: str, length: int, on: float | Column, off: float | Column, margin=(1, 1), window: int = 10) -> DataFrame:
    """Blink edges moved to the slopes around them, as (start, end, onset, offset); a blink without both is left out.

    The onset is the start of the last run of slopes <= on that reaches into [start - window, start], less a
    margin; the offset the end of the first run of slopes >= off from the blink's end on within the window,
    plus a margin; both stay in the window. (A window that the recording's start cuts looks for the offset as
    much later as it is cut.) Runs and blinks meet in sorted streams, without pairs.
    """
    v = slopes(df, signal, length)
    n = df.groupBy("recording_id").agg(F.count("*").alias("n"))
    a = iv.runs(v, F.col("_back") <= _column(on)).select("recording_id", F.col("start").alias("r0"), (F.col("end") - 1).alias("r1"))
    b = iv.runs(v, F.col("_fore") >= _column(off)).select("recording_id", F.col("start").alias("r0"), (F.col("end") - 1).alias("r1"))
    bl = blinks.join(n, "recording_id").select("recording_id", "start", "end", F.greatest(F.lit(0), F.col("start") - window).alias("w0"), F.least(F.col("end") + window, "n").alias("w1"))
    bl = bl.withColumn("from", F.when(F.col("start") > window, F.col("end")).otherwise(F.col("end") + window - F.col("start")))

    def met(runs, at, key, frame):
        """bl with r0, r1 of the nearest run on one side of `at`."""
        none = [F.lit(None).cast("long").alias(c) for c in ("start", "end", "w0", "w1", "from")]
        rows = runs.select("recording_id", F.col(key).alias("at"), "r0", "r1", *none).unionByName(bl.select("recording_id", F.col(at).alias("at"), F.lit(None).cast("long").alias("r0"), F.lit(None).cast("long").alias("r1"), "start", "end", "w0", "w1", "from"))
        pick = F.last if frame == "before" else F.first
        w = by().orderBy("at", F.col("start").isNotNull() if frame == "before" else F.col("start").isNull())
        w = w.rowsBetween(Window.unboundedPreceding, 0) if frame == "before" else w.rowsBetween(0, Window.unboundedFollowing)
        one = pick(F.when(F.col("r0").isNotNull(), F.struct("r0", "r1")), True).over(w)
        return rows.withColumn("run", one).filter("start is not null and run is not null")

    left = met(a, "start", "r0", "before").withColumns({"lo": F.col("run.r0"), "hi": F.least("run.r1", "start")}).filter("hi >= w0")
    left = left.select("recording_id", "start", "end", F.greatest("w0", F.greatest("w0", "lo") - margin[0]).alias("onset"))
    right = met(b, "from", "r1", "after").withColumns({"lo": F.greatest("run.r0", "from"), "hi": F.least(F.col("run.r1"), F.col("w1") - 1)}).filter("lo < w1")
    right = right.select("recording_id", "start", "end", F.least(F.col("w1") - 1, F.col("hi") + margin[1]).alias("offset"))
    return left.join(right, ["recording_id", "start", "end"])


METHODS = ("linear", "slinear", "nearest", "previous", "zero", "next", "quadratic", "cubic")


def interpolate(df: DataFrame, spans: DataFrame, signal: str, method: str = "linear", out: str | None = None) -> DataFrame:
    """[start, end) replaced from the samples just outside, over time, and masked; as `out` if that is named.

    linear: the line between both; nearest: the nearer one, the earlier at the middle; previous (zero), next:
    that one. Two points make quadratic and cubic a line too. Intervals are held to the recording, whose first
    and last sample then stand for what lies outside; one with a missing bound is left as it is. Spans of one
    recording don't overlap (merge them first).
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    out, m = out or signal, mask_of(signal)
    last = df.groupBy("recording_id").agg(F.max("i").alias("_last"))
    at = spans.select("recording_id", F.greatest(F.lit(0), F.col("start").cast("long")).alias("start"), F.col("end").cast("long").alias("end")).join(last, "recording_id")
    at = at.withColumn("end", F.least(F.col("end"), F.col("_last") + 1)).filter("end > start").withColumns({"p0": F.greatest(F.lit(0), F.col("start") - 1), "p1": F.least("_last", "end")})
    points = df.select("recording_id", F.col("i").alias("p"), F.col("t_ms").alias("t"), F.col(signal).alias("v")).filter("v is not null")
    for k in ("0", "1"):
        at = at.join(points.withColumnsRenamed({"p": f"p{k}", "t": f"t{k}", "v": f"v{k}"}), ["recording_id", f"p{k}"])
    x = (F.col("t_ms") - F.col("t0")) / F.when(F.col("t1") != F.col("t0"), F.col("t1") - F.col("t0"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * x
    value = {"nearest": F.when(x <= 0.5, F.col("v0")).otherwise(F.col("v1")), "previous": F.col("v0"), "zero": F.col("v0"), "next": F.col("v1")}.get(method, line)
    inside = iv.samples_in(df.select("recording_id", "i", "t_ms"), at.select("recording_id", "start", "end", "t0", "t1", "v0", "v1"), "i", 64)
    new = inside.select("recording_id", "i", F.coalesce(value, "v0").alias("_new")).groupBy("recording_id", "i").agg(F.min("_new").alias("_new"))
    joined = df.join(new, ["recording_id", "i"], "left")
    cols = {out: F.coalesce("_new", signal)}
    if m in df.columns:
        cols[mask_of(out)] = F.col("_new").isNotNull() | F.col(m)
    return joined.withColumns(cols).drop("_new")


def interpolate_linear(df: DataFrame, blinks: DataFrame, signal: str, out: str) -> DataFrame:
    """[start, end) replaced by the line, over time, between the samples outside, where both are there."""
    return interpolate(df, blinks, signal, "linear", out)


def four_points(refined: DataFrame, df: DataFrame) -> DataFrame:
    """(t1, t2, t3, t4): onset, offset and the points as far outside again, held to the recording, where they are in order; onset, offset."""
    n = df.groupBy("recording_id").agg(F.count("*").alias("n"))
    p = refined.join(n, "recording_id").withColumns({"t1": F.greatest(F.lit(0), 2 * F.col("onset") - F.col("offset")), "t4": F.least(F.col("n") - 1, 2 * F.col("offset") - F.col("onset"))})
    p = p.withColumns({"t2": F.when(F.col("t1") == F.col("onset"), F.col("onset") + 1).otherwise(F.col("onset")), "t3": F.when(F.col("t4") == F.col("offset"), F.col("offset") - 1).otherwise(F.col("offset"))})
    return p.filter("t1 < t2 and t2 < t3 and t3 < t4").select("recording_id", "t1", "t2", "t3", "t4", "onset", "offset")


def interpolate_cubic(df: DataFrame, refined: DataFrame, signal: str, out: str) -> DataFrame:
    """[onset, offset) replaced by the cubic, over time, through four points around a blink, and masked.

    A blink with a missing point keeps its samples but is masked too; of overlapping ones the last counts,
    by t2, t3, onset and offset: blinks held to the recording's ends can share t2 and t3.
    """
    pts = four_points(refined, df)
    for k in (1, 2, 3, 4):
        at = df.select("recording_id", F.col("i").alias(f"t{k}"), F.col("t_ms").alias(f"x{k}"), F.col(signal).alias(f"v{k}"))
        pts = pts.join(at, ["recording_id", f"t{k}"])
    spans = pts.withColumnsRenamed({"t2": "start", "t3": "end"})
    x = F.col("t_ms")

    def term(k):
        value = F.col(f"v{k}")
        for m in (1, 2, 3, 4):
            if m != k:
                value = value * (x - F.col(f"x{m}")) / F.when(F.col(f"x{k}") != F.col(f"x{m}"), F.col(f"x{k}") - F.col(f"x{m}"))
        return value

    inside = iv.samples_in(df.select("recording_id", "i", "t_ms"), spans, "i", 64).withColumn("curve", term(1) + term(2) + term(3) + term(4))
    new = inside.groupBy("recording_id", "i").agg(F.max_by("curve", F.struct("start", "end", "onset", "offset")).alias("_new"), F.lit(True).alias("_hit"))
    cols = {out: F.coalesce("_new", signal)}
    if mask_of(signal) in df.columns:
        cols[mask_of(out)] = F.col("_hit").isNotNull() | F.col(mask_of(signal))
    return df.join(new, ["recording_id", "i"], "left").withColumns(cols).drop("_new", "_hit")


def reconstruct(
    df: DataFrame, blinks: DataFrame, signal: str, fs: float, winsize: float = 25, on: float | str = -5.0, off: float | str = 5.0,
    margin: tuple[float, float] = (10, 30), window: float = 500, out: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(samples with blinks refined and replaced by cubics, the intervals replaced); settings in ms and units a ms."""
    up = lambda ms: -int(-ms / 1000 * fs // 1)
    length = max(3, up(winsize) | 1)
    limited = thresholds(df, signal, fs, length, on, off)
    fine = refine(limited, blinks, signal, length, F.col("on_v"), F.col("off_v"), (up(margin[0]), up(margin[1])), int(window / 1000 * fs))
    done = four_points(fine, df).select("recording_id", F.col("t2").alias("start"), F.col("t3").alias("end"))
    return interpolate_cubic(df, fine, signal, out or signal), done

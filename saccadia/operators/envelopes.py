"""Baselines through troughs and response weights, for recordings of any length.

Samples stay in Spark: troughs come by blocks, curves between knots are scans that bring each
sample the knots around it, and responses are sums over samples by pairs of events that
overlap. What is solved in a task is what remains of a recording: its knots, or its events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.functions.densities import response_kernel
from saccadia.functions.tables import written
from saccadia.operators import extrema, selection
from saccadia.operators import intervals as iv
from saccadia.operators.blocks import in_order, scan
from saccadia.operators.models import lowpass


def through(df: DataFrame, knots: DataFrame, method: str = "cubic", parts: int | None = None) -> DataFrame:
    """recording_id, i, curve: lines or a cubic spline through knots (recording_id, i, v) at every sample; held beyond the ends."""
    def moments(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        c = K.cubic_moments(p["i"], p["v"]) if method == "cubic" else np.zeros(len(p))
        return p.assign(c=c)[["recording_id", "i", "v", "c"]]

    if method not in ("linear", "cubic"):
        raise ValueError("method is 'linear' or 'cubic'")
    kind = dict(df.dtypes)["recording_id"]
    bent = knots.select("recording_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")).groupBy("recording_id").applyInPandas(moments, f"recording_id {kind}, i long, v double, c double")
    rows = df.select("recording_id", F.col("i").cast("long").alias("i")).join(bent, ["recording_id", "i"], "left")
    knot = F.when(F.col("v").isNotNull(), F.struct("i", "v", "c"))
    near = scan(in_order(rows, ["recording_id", "i"], parts), ["recording_id"], back=("last", knot), ahead=("next", knot))
    h = (F.col("ahead.i") - F.col("back.i")).cast("double")
    a, b = (F.col("ahead.i") - F.col("i")) / h, (F.col("i") - F.col("back.i")) / h
    curve = a * F.col("back.v") + b * F.col("ahead.v") + ((a * a * a - a) * F.col("back.c") + (b * b * b - b) * F.col("ahead.c")) * h * h / 6
    value = F.when(F.col("back").isNull(), F.col("ahead.v")).when(F.col("ahead").isNull() | (h == 0), F.col("back.v")).otherwise(curve)
    return near.select("recording_id", "i", value.alias("curve"))


def trough_baseline(df: DataFrame, signal: str, fs: float, cutoff: float = 2.0, percentile: float = 80.0, method: str = "cubic", parts: int | None = None) -> DataFrame:
    """recording_id, i, baseline: a curve through both ends and the troughs of the low-passed signal whose
    prominence is over a percentile of its recording's. A recording without a sample has a null baseline."""
    low = written(lowpass(df, signal, min(cutoff, 0.45 * fs), fs), "lowpass")
    found = written(extrema.troughs(low, "filtered", parts=parts), "troughs")
    limit = selection.percentiles(found, ["recording_id"], "prominence", [percentile / 100]).select("recording_id", F.col("value").alias("limit"))
    kept = found.join(limit, "recording_id").filter("prominence > limit").select("recording_id", "i")
    both = low.filter("filtered is not null").groupBy("recording_id").agg(F.array(F.min("i"), F.max("i")).alias("ends")).select("recording_id", F.explode("ends").alias("i"))
    knots = kept.unionByName(both).distinct().join(low.select("recording_id", "i", F.col("filtered").alias("v")), ["recording_id", "i"])
    return through(low, knots, method, parts).withColumnRenamed("curve", "baseline")


def _fits(rows: DataFrame, events: DataFrame, tried: DataFrame) -> DataFrame:
    """recording_id, c, rss, onsets, coef of each tried (recording_id, c, npar, tmax)."""
    longest = tried.agg(F.max("tmax"), F.min("npar")).first()
    if longest[0] is None:
        last = 1.0
    else:
        last = K.kernel_duration(max(float(longest[1]), 1.0), float(longest[0]))
    spans = events.withColumns({"start": F.col("o"), "end": F.col("o") + last})
    met = iv.samples_in(rows, spans.select("recording_id", "e", "o", "start", "end"), "t_ms", max(last / 4, 1e-3)).select("recording_id", "i", "e", "o", "t_ms", "y")
    h = response_kernel(F.col("t_ms") - F.col("o"), F.col("npar"), F.col("tmax"))
    x = written(met.join(tried, "recording_id").select("recording_id", "c", "i", "e", "y", h.alias("h")).filter("h > 1e-9"), "responses")
    other = x.select("recording_id", "c", "i", F.col("e").alias("f"), F.col("h").alias("g"))
    gram = x.join(other, ["recording_id", "c", "i"]).filter("e <= f").groupBy("recording_id", "c", "e", "f").agg(F.sum(F.col("h") * F.col("g")).alias("s"))
    right = x.groupBy("recording_id", "c", "e").agg(F.sum(F.col("h") * F.col("y")).alias("s")).withColumn("f", F.lit(-1).cast("long"))
    kind = dict(rows.dtypes)["recording_id"]

    def solve(key: tuple, p: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        every = every.sort_values("e")
        place = {e: k for k, e in enumerate(every["e"])}
        lines, b = [{} for _ in place], np.zeros(len(place))
        for e, f, s in zip(p["e"], p["f"], p["s"], strict=True):
            if f < 0:
                b[place[e]] = s
            else:
                lines[place[e]][place[f]] = lines[place[f]][place[e]] = float(s)
        a = K.nonnegative_gram(lines, b)
        fitted = sum(a[k] * a[m] * v for k, line in enumerate(lines) for m, v in line.items()) - 2 * float(a @ b)
        return pd.DataFrame({"recording_id": every["recording_id"].iloc[:1], "c": key[1], "gain": fitted, "onsets": [every["o"].tolist()], "coef": [a.tolist()]})

    each = events.withColumnRenamed("recording_id", "whole").join(tried.select("recording_id", "c"), F.col("whole") == F.col("recording_id")).drop("whole").select(F.col("recording_id"), F.col("c").alias("k"), "e", "o")
    out = gram.unionByName(right.select(gram.columns)).groupBy("recording_id", "c").cogroup(each.groupBy("recording_id", "k")).applyInPandas(solve, f"recording_id {kind}, c long, gain double, onsets array<double>, coef array<double>")
    squares = rows.groupBy("recording_id").agg(F.sum(F.col("y") * F.col("y")).alias("yy"))
    return out.join(squares, "recording_id").select("recording_id", "c", F.greatest(F.lit(0.0), F.col("yy") + F.col("gain")).alias("rss"), "onsets", "coef")


def response_weights(df: DataFrame, signal: str, npar: float | None = 10.1, tmax: float | None = 930.0, baseline: str | None = None, bounds=((1, 20), (100, 2000)), rounds: int = 4) -> DataFrame:
    """recording_id, npar, tmax, n_events, rss, onsets, coef: non-negative response weights of a recording's events.

    df has a column `event`. The signal is taken less `baseline`, or less its smallest value.
    npar or tmax of None are sought within `bounds` by `rounds` grids of five values each,
    every recording around its own best: all of a grid is one pass over the samples. Missing
    samples don't count; a recording without samples or events has no row.
    """
    value = F.col(signal).cast("double")
    base = df.groupBy("recording_id").agg(F.min(value).alias("_low"))
    less: Column = F.col(baseline) if baseline else F.col("_low")
    rows = written(df.join(base, "recording_id").select("recording_id", "i", "t_ms", "event", (value - less).alias("y")).filter("y is not null"), "signal")
    events = written(rows.filter("event").select("recording_id", F.col("i").cast("long").alias("e"), F.col("t_ms").cast("double").alias("o")), "onsets")
    rows = rows.select("recording_id", "i", "t_ms", "y")
    free = [v is None for v in (npar, tmax)]
    lo, hi = zip(*[(float(v), float(v)) if v is not None else tuple(map(float, b)) for v, b in zip((npar, tmax), bounds, strict=True)], strict=True)
    box = events.select("recording_id").distinct().select("recording_id", *[F.lit(v).alias(k) for k, v in zip(("n0", "n1", "t0", "t1"), (lo[0], hi[0], lo[1], hi[1]), strict=True)])
    steps = lambda a, b, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col(a) + (F.col(b) - F.col(a)) * k / max(n - 1, 1))
    best = None
    for _ in range(rounds if any(free) else 1):
        grid = box.withColumn("npar", F.explode(steps("n0", "n1", 5 if free[0] else 1))).withColumn("tmax", F.explode(steps("t0", "t1", 5 if free[1] else 1)))
        tried = written(grid.withColumn("c", F.xxhash64("npar", "tmax")), "tried")
        fits = _fits(rows, events, tried.select("recording_id", "c", "npar", "tmax")).join(tried, ["recording_id", "c"])
        one = F.struct("rss", "npar", "tmax", "onsets", "coef", "n0", "n1", "t0", "t1")
        best = written(fits.groupBy("recording_id").agg(F.min(one).alias("b")).select("recording_id", "b.*"), "best")
        half = lambda a, b: (F.col(b) - F.col(a)) / 6
        box = best.select(
            "recording_id", F.greatest(F.lit(lo[0]), F.col("npar") - half("n0", "n1")).alias("n0"), F.least(F.lit(hi[0]), F.col("npar") + half("n0", "n1")).alias("n1"),
            F.greatest(F.lit(lo[1]), F.col("tmax") - half("t0", "t1")).alias("t0"), F.least(F.lit(hi[1]), F.col("tmax") + half("t0", "t1")).alias("t1"),
        )
    return best.select("recording_id", "npar", "tmax", F.size("onsets").cast("long").alias("n_events"), "rss", "onsets", "coef")

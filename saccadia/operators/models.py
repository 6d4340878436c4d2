"""Model fits and filters. Filters run in blocks of a recording with halos; sums, windows and joins are Spark's;
what iterates (splines, response weights, camera angles) works on one recording's reduced rows in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.functions.densities import response_kernel
from saccadia.functions.geometry import Setup
from saccadia.operators import intervals as iv
from saccadia.operators.samples import by, downsample, mask_of, ordered

#: Samples of a filter block; one task holds a block and its halos, however long the recording is.
BLOCK = 1 << 17
#: Coefficients of a spline up to which one recording's normal matrix is solved whole.
FEW = 64


def per_recording(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(pandas rows of one recording in order of i) for each recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("i", kind="stable"))

    return df.groupBy("recording_id").applyInPandas(run, schema)


def many_groups(df: DataFrame, keys: list[str], fn, out: str, spread: bool = False) -> DataFrame:
    """recording_id and the columns `out`: fn(columns, starts) over sorted streams, for all groups of a batch at once.

    Keys begin with recording_id; rows come in order of the keys and i. columns has arrays by name, which hold whole
    groups that begin at `starts`; fn gives the number of rows of each group and their columns. A task holds a batch
    and one group; small groups cost no batch of their own. `spread`: few bytes are much work, so Spark merges no parts.
    """
    order = [*keys, "i"] if "i" in df.columns else keys
    parts = [max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)] if spread else []
    rows = df.repartition(*parts, *keys).sortWithinPartitions(*order)

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            a, b = c[1:], c[:-1]
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        return np.flatnonzero(new)

    def done(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        n, cols = fn({c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in t.column_names if c != "recording_id"}, starts)
        ids = t.column("recording_id").combine_chunks().take(pa.array(np.repeat(starts, n)))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(v, from_pandas=True) for v in cols.values()]], ["recording_id", *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            edge = pa.Table.from_batches(([held[-1].slice(held[-1].num_rows - 1)] if held else []) + [b])
            if held and len(begins(edge)) == 1:
                held.append(b)
                continue
            t = pa.Table.from_batches([*held, b])
            starts = begins(t)
            if len(starts) > 1:
                yield done(t.slice(0, int(starts[-1])), starts[:-1])
            held = t.slice(int(starts[-1])).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held), np.zeros(1, int))

    return rows.mapInArrow(run, f"recording_id {dict(df.dtypes)['recording_id']}, {out}")


def each_group(fn):
    """fn(columns of one group) for many_groups: arrays, or lists of one array a row, by name."""

    def run(cols: dict, starts: np.ndarray):
        ends = np.append(starts[1:], len(next(iter(cols.values()))))
        made = [fn({k: v[a:b] for k, v in cols.items()}) for a, b in zip(starts, ends, strict=True)]
        first = {k: [m[k] for m in made] for k in made[0]}
        return [len(next(iter(m.values()))) for m in made], {k: [x for m in v for x in m] if isinstance(v[0], list) else np.concatenate(v) for k, v in first.items()}

    return run


def lowpass(df: DataFrame, signal: str, cutoff: float, fs: float, order: int = 2, block: int = BLOCK, rounds: int = 5) -> DataFrame:
    """recording_id, i, filtered: zero-phase Butterworth low-pass.

    Missing samples start at the recording's mean and are refilled `rounds` times from the last result; a
    recording without a sample stays null. Blocks overlap by as many samples as the filter remembers, once
    for each round.
    """
    b, a = K.butterworth(order, cutoff, fs)
    halo = K.decay(a, 1e-10) * (rounds + 1)
    mean = df.groupBy("recording_id").agg(F.avg(signal).alias("_mean"))
    at = F.floor(F.col("i") / block).cast("long")
    near = F.sequence(F.floor(F.greatest(F.lit(0), F.col("i") - halo) / block).cast("long"), F.floor((F.col("i") + halo) / block).cast("long"))
    rows = df.select("recording_id", "i", F.col(signal).cast("double").alias("v")).join(mean, "recording_id").withColumn("own", at).withColumn("block", F.explode(near))

    def fn(p: dict) -> dict:
        own = p["own"] == p["block"]
        if not own.any():
            return {"i": np.zeros(0, np.int64), "filtered": np.zeros(0)}
        x, m = p["v"], p["_mean"][0]
        return {"i": p["i"][own], "filtered": (x if np.isnan(m) else K.lowpass_gaps(x, cutoff, fs, order, rounds, m))[own]}

    out = many_groups(rows, ["recording_id", "block"], each_group(fn), "i long, filtered double")
    return out.withColumn("filtered", F.nanvl("filtered", F.lit(None)))


def moving_mean(value, n: int):
    """Mean over n samples around a row, the odd one before it for an even n; beyond the ends the edge sample."""
    before, after = n // 2, n - 1 - n // 2
    i, last = F.col("i"), F.max("i").over(by())
    whole = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.sum(value).over(ordered().rowsBetween(-before, after))
    head = F.greatest(F.lit(0), before - i) * F.first(value).over(whole)
    tail = F.greatest(F.lit(0), i + after - last) * F.last(value).over(whole)
    return (inside + head + tail) / n


def quality(df: DataFrame, signal: str, fs: float, cutoff: float = 4.0, window_ms: float = 500) -> DataFrame:
    """recording_id, i, noise_power, snr, snr_db, noise_cv and the signal's mask.

    Signal is the low-passed series, noise the rest (0 where masked or missing); powers are means over a
    sliding window.
    """
    m = mask_of(signal)
    bad = F.col(signal).isNull() | (F.col(m) if m in df.columns else F.lit(False))
    raw = df.select("recording_id", "i", F.when(~bad, F.col(signal)).alias("_x"))
    s = F.col("filtered")
    joined = raw.join(lowpass(raw, "_x", cutoff, fs), ["recording_id", "i"]).withColumns({"_s2": s * s, "_n2": F.coalesce((F.col("_x") - s) * (F.col("_x") - s), F.lit(0.0))})
    n = max(3, int(window_ms / 1000 * fs))
    out = joined.withColumns({"signal_power": moving_mean("_s2", n), "noise_power": moving_mean("_n2", n)})
    snr = F.col("signal_power") / (F.col("noise_power") + 1e-10)
    cv = F.sqrt(F.greatest(F.col("noise_power"), F.lit(0.0))) / (F.abs(s) + 1e-10)
    return out.select("recording_id", "i", "noise_power", snr.alias("snr"), (10 * F.log10(snr + 1e-10)).alias("snr_db"), cv.alias("noise_cv"), F.col("_x").isNull().alias("masked"))


def response(df: DataFrame, signal: str, npar: float | None = 10.1, tmax: float | None = 930.0, baseline: str | None = None, bounds=((1, 20), (100, 2000))) -> DataFrame:
    """recording_id, npar, tmax, n_events, rss, onsets, coef: non-negative response weights of a recording's events.

    df has a column `event`. The signal is taken less `baseline`, or less its smallest value. npar or tmax of
    None are sought within `bounds`, both together. A recording without samples or events has no weights.
    """
    base = F.col(baseline) if baseline else F.min(signal).over(by())
    rows = df.withColumn("_y", F.col(signal) - base).filter("_y is not null").select("recording_id", "i", "t_ms", "_y", "event")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        t, y, onsets = p["t_ms"].to_numpy(float), p["_y"].to_numpy(float), p.loc[p["event"].astype(bool), "t_ms"].to_numpy(float)

        def loss(a, b):
            return float(((y - K.response_fit(t, y, onsets, a, b)[1]) ** 2).sum())

        lo, hi = zip(*[(v, v) if v is not None else b for v, b in zip((npar, tmax), bounds, strict=True)], strict=True)
        a, b = K.shrinking_grid(loss, lo, hi, (5, 5), 4) if len(onsets) and None in (npar, tmax) else [v if v is not None else d for v, d in zip((npar, tmax), (10.0, 900.0), strict=True)]
        c, pred = K.response_fit(t, y, onsets, a, b)
        return pd.DataFrame({"recording_id": p["recording_id"].iloc[:1], "npar": float(a), "tmax": float(b), "n_events": len(onsets), "rss": float(((y - pred) ** 2).sum()), "onsets": [onsets.tolist()], "coef": [c.tolist()]})

    kind = dict(df.dtypes)["recording_id"]
    return per_recording(rows, fn, f"recording_id {kind}, npar double, tmax double, n_events long, rss double, onsets array<double>, coef array<double>")


def predicted(df: DataFrame, fits: DataFrame, out: str = "response") -> DataFrame:
    """samples with the sum of the fitted responses, in buckets of time; 0 away from all."""
    each = fits.select("recording_id", "npar", "tmax", F.explode(F.arrays_zip("onsets", "coef")).alias("e")).filter("e.coef > 0")
    last = F.col("tmax") * 6  # under 1e-8 of the peak for npar of 5 and more
    spans = each.select("recording_id", "npar", "tmax", F.col("e.coef").alias("w"), F.col("e.onsets").alias("start"), (F.col("e.onsets") + last).alias("end"))
    met = iv.samples_in(df.select("recording_id", "i", "t_ms"), spans, "t_ms", 1000.0)
    h = F.col("w") * response_kernel(F.col("t_ms") - F.col("start"), F.col("npar"), F.col("tmax"))
    return df.join(met.groupBy("recording_id", "i").agg(F.sum(h).alias(out)), ["recording_id", "i"], "left").fillna(0.0, [out])


def design_matrix(samples: DataFrame, events: DataFrame, fs: float, npar: float = 10.1, tmax: float = 930.0, duration: float | None = None) -> DataFrame:
    """recording_id, event_id, i, h: each event's response on the samples from the nearest one on, in long form."""
    lasting = K.kernel_duration(npar, tmax) if duration is None else duration
    n = max(1, int(np.ceil(lasting * fs / 1000)))
    o = iv.nearest_index(events, samples).select("recording_id", "event_id", "i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    h = response_kernel(F.col("k") * (1000 / fs), F.lit(float(npar)), F.lit(float(tmax)))
    x = o.select("recording_id", "event_id", (F.col("i") + F.col("k")).alias("i"), h.alias("h"))
    return x.join(samples.select("recording_id", "i"), ["recording_id", "i"])


def response_baseline(df: DataFrame, events: DataFrame, signal: str, fs: float, lp1: float = 2.0, lp2: float = 0.2) -> DataFrame:
    """recording_id, i, baseline: the low-passed signal less one summed response, low-passed again.

    Weight and constant are non-negative least squares from the moments of both series.
    """
    y = lowpass(df, signal, lp1, fs)
    x = design_matrix(df, events, fs, 10.1, 930.0, 4000.0).groupBy("recording_id", "i").agg(F.sum("h").alias("x"))
    both = y.join(x, ["recording_id", "i"], "left").fillna(0.0, ["x"])
    m = both.groupBy("recording_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("filtered").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("filtered")).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    w = F.when(det > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(0.0)
    c = (F.col("sy") - F.col("w") * F.col("sx")) / F.col("n")
    m = m.withColumn("w", w).withColumn("c", c)
    # where one is negative the other is fitted alone
    weight = F.when(F.col("w") < 0, 0.0).when((F.col("c") < 0) & (F.col("sxx") > 0), F.greatest(F.lit(0.0), F.col("sxy") / F.col("sxx"))).otherwise(F.col("w"))
    rest = both.join(m.select("recording_id", weight.alias("weight")), "recording_id").withColumn("rest", F.col("filtered") - F.col("weight") * F.col("x"))
    return lowpass(rest, "rest", lp2, fs).withColumnRenamed("filtered", "baseline")


def baseline(df: DataFrame, signal: str, fs: float, cutoff: float = 2.0, percentile: float = 80.0, method: str = "cubic") -> DataFrame:
    """recording_id, i, baseline: a curve through both ends and the troughs of the low-passed signal whose
    prominence is over a percentile; 'linear', or 'cubic' through them."""
    if method not in ("linear", "cubic"):
        raise ValueError("method is 'linear' or 'cubic'")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        y = p["filtered"].to_numpy(float)
        at, prom = K.troughs(y)
        keep = at[prom > np.percentile(prom, percentile)] if len(at) else at
        k = np.unique(np.concatenate([[0], keep, [len(y) - 1]])).astype(int)
        grid = np.arange(len(y))
        base = np.interp(grid, k, y[k]) if method == "linear" else K.cubic_spline(k, y[k], grid)
        return pd.DataFrame({"recording_id": p["recording_id"], "i": p["i"], "baseline": base})

    kind = dict(df.dtypes)["recording_id"]
    out = per_recording(lowpass(df, signal, min(cutoff, 0.45 * fs), fs), fn, f"recording_id {kind}, i long, baseline double")
    return out.withColumn("baseline", F.nanvl("baseline", F.lit(None)))


def _spline_below(z: np.ndarray, knots: np.ndarray, weight: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """MAP spline of an asymmetric-Laplace residual (`share` of it below zero's side) with N(0, 5) coefficients."""
    first, v = K.local_basis(np.arange(len(z), dtype=float), knots)
    n, ok = len(knots) - 4, ~np.isnan(z)
    y, base = np.where(ok, z, 0), np.zeros(len(z))
    # few coefficients: the whole matrix is quicker than its diagonals
    full = K.bspline_basis(np.arange(len(z), dtype=float), knots) if n <= FEW else None
    for _ in range(rounds):
        r = y - base
        w = np.where(ok, weight * np.where(r > 0, share, 1 - share) / np.maximum(np.abs(r), 1e-3), 0)
        if full is not None:
            weighed = full.T * w
            base = full @ np.linalg.solve(weighed @ full + np.eye(n) / 25, weighed @ y)
            continue
        band, rhs = K.banded_normal(first, v, w, y, n)
        band[0] += 1 / 25
        base = K.banded_mean(first, v, K.banded_solve(band, rhs))
    return base


def asymmetric_baseline(df: DataFrame, signal: str, knots: int = 6, share: float = 0.05) -> DataFrame:
    """B-spline baseline below about 1 - `share` of the signal, on evenly spaced knots."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        y = p[signal].to_numpy(float)
        ok = ~np.isnan(y)
        base = np.full(len(y), np.nan)
        if ok.any():
            m, s, end = np.nanmean(y), np.nanstd(y) or 1.0, max(len(y) - 1, 1)
            base = _spline_below((y - m) / s, np.concatenate([[0.0] * 3, np.linspace(0, end, knots), [end] * 3]), np.ones(len(y)), share) * s + m
        return pd.DataFrame({"recording_id": p["recording_id"], "i": p["i"], "baseline": base})

    kind = dict(df.dtypes)["recording_id"]
    return per_recording(df.select("recording_id", "i", signal), fn, f"recording_id {kind}, i long, baseline double").withColumn("baseline", F.nanvl("baseline", F.lit(None)))


def _trough_baseline(z: np.ndarray, lowest: float, highest: float, share: float) -> np.ndarray:
    """A spline below z with knots at its troughs, which weigh by their prominence."""
    at, prom = K.troughs(z)
    weight = np.ones(len(z))
    if len(at):
        wide = prom.max() - prom.min()
        weight[at] = lowest + (prom - prom.min()) / (wide or 1.0) * (highest - lowest)
    inner = np.unique(np.concatenate([[0], at, [len(z) - 1]])).astype(float)
    return _spline_below(z, np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3]), weight, share)


def iterated_baseline(df: DataFrame, signal: str, fs: float, target: float = 10.0, cutoff: float = 2.0, lowest: float = 1.0, highest: float = 100.0, share: float = 0.05) -> DataFrame:
    """recording_id, i, base1, base2: baselines before and after the responses to events are taken out.

    df has a column `event`. The signal is low-passed and brought to `target` samples a second; a spline is laid
    under it with knots at its troughs; the responses fitted to the rest are subtracted, and the spline is laid
    under what is left. Both are brought back to all samples by lines.
    """
    step = max(1, int(fs / target))
    slow = lowpass(df, signal, min(cutoff, 0.45 * fs), fs).join(df.select("recording_id", "i", "t_ms", "event"), ["recording_id", "i"])
    block = F.floor(F.col("i") / step).cast("long")
    few = slow.groupBy("recording_id", block.alias("i")).agg(F.avg("t_ms").alias("t_ms"), F.avg("filtered").alias("y"), F.collect_list(F.when(F.col("event"), F.col("t_ms"))).alias("events"))

    def fn(p: dict) -> dict:
        y, t = p["y"], p["t_ms"]
        base1 = base2 = np.full(len(y), np.nan)
        if not np.isnan(y).any():
            m, s = y.mean(), y.std() or 1.0
            z, onsets = (y - m) / s, np.sort(np.concatenate(p["events"]).astype(float))
            low = _trough_baseline(z, lowest, highest, share)
            rest = z - K.response_fit(t, z - low, onsets, 10.0, 917.0)[1] if len(onsets) else z
            base1, base2 = low * s + m, _trough_baseline(rest, lowest, highest, share) * s + m
        return {"i": p["i"], "t": t, "b1": base1, "b2": base2}

    fitted = many_groups(few, ["recording_id"], each_group(fn), "i long, t double, b1 double, b2 double", spread=True)
    w = Window.partitionBy("recording_id").orderBy("i")
    pairs = fitted.withColumns({f"{c}n": F.lead(c).over(w) for c in ("t", "b1", "b2")} | {f"{c}p": F.lag(c).over(w) for c in ("t", "b1", "b2")})
    near = df.select("recording_id", "i", "t_ms").withColumn("_b", F.floor(F.col("i") / step).cast("long")).join(pairs.withColumnRenamed("i", "_b"), ["recording_id", "_b"])

    def line(c):
        after = F.col("t_ms") >= F.col("t")
        other, at = F.when(after, F.col(f"{c}n")).otherwise(F.col(f"{c}p")), F.when(after, F.col("tn")).otherwise(F.col("tp"))
        return F.coalesce(F.col(c) + (other - F.col(c)) * (F.col("t_ms") - F.col("t")) / (at - F.col("t")), F.col(c))

    return near.select("recording_id", "i", F.nanvl(line("b1"), F.lit(None)).alias("base1"), F.nanvl(line("b2"), F.lit(None)).alias("base2"))


def foreshortening_rows(df: DataFrame, eye: str, setup: Setup, fs: float, spans: DataFrame | None = None, target: float = 50.0, cutoff: float = 4.0, least: int = 100) -> DataFrame:
    """recording_id, i, t_ms, x, y (mm), pupil, ready for the fit.

    Visible samples with a positive pupil, within the intervals (recording_id, start, end in ms, both ends
    included) if given; low-passed by an order-3 filter and brought to `target` samples a second. A recording
    with fewer than `least` such samples is left out.
    """
    if cutoff >= fs / 2:
        raise ValueError("the low-pass lies below half the sampling rate")
    vis = lambda s: F.when(~F.col(mask_of(s)), F.col(s)) if mask_of(s) in df.columns else F.col(s)
    x, y = setup.pixels_to_mm(vis(f"{eye}_x"), vis(f"{eye}_y"))
    rows = df.select("recording_id", "i", "t_ms", x.alias("x"), y.alias("y"), vis(f"{eye}_pupil").alias("pupil")).filter("x is not null and y is not null and pupil > 0")
    if spans is not None:
        # closed at both ends: a sample at an interval's end is inside
        rows = iv.covered(rows, spans.select("recording_id", "start", (F.col("end") + 1e-9).alias("end")), "t_ms", "_in").filter("_in").drop("_in")
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy("recording_id").orderBy("i")) - 1).cast("long"))
    rows = rows.withColumn("_n", F.count("*").over(by())).filter(F.col("_n") >= least).drop("_n")
    smooth = lowpass(rows, "pupil", cutoff, fs, 3).withColumnRenamed("filtered", "pupil")
    rows = rows.drop("pupil").join(smooth, ["recording_id", "i"])
    factor = round(fs / target)
    if fs <= target or factor < 2:
        return rows
    return downsample(rows.withColumns({mask_of(s): F.lit(False) for s in ("x", "y", "pupil")}), ["x", "y", "pupil"], factor).select("recording_id", "i", "t_ms", "x", "y", "pupil")


def foreshortening(df: DataFrame, r: float, d: float, knots_per_second: float = 1.0, smooth: float = 1.0) -> DataFrame:
    """recording_id, theta, phi, r2, rmse, n, loss, knots, coef from x, y (mm) and pupil.

    The least sum of squares of pupil - size * cos(alpha), and `smooth` times those of the size's coefficients'
    steps. For given angles the size is a banded solve, so only (theta, phi) are sought, theta within 0 to a
    right angle, on a grid that shrinks; coefficients are held within 0.1 to 10 times the mean. A recording
    without a usable row has no fit. The cosine is linear in the camera's direction, so the sums over samples
    are taken once a recording and all of a grid is solved from them.
    """
    if r <= 0 or d <= 0:
        raise ValueError("distances are positive")

    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]

    def toward(theta, phi):
        return np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta) + 0 * phi], -1)

    def fn(p: dict) -> dict:
        x, y, a, t = p["x"], p["y"], p["pupil"], p["t_ms"]
        knots = K.clamped_knots(t[0], t[-1], knots_per_second) if t[-1] > t[0] else np.concatenate([[t[0]] * 4, [t[0] + 1] * 4])
        first, v = K.local_basis(t, knots)
        n = len(knots) - 4
        g = np.stack([x, y, np.full(len(x), float(d))]) / np.sqrt(x * x + y * y + d * d)
        rough = np.zeros((4, n))
        rough[0] = smooth * np.concatenate([[1], np.full(n - 2, 2), [1]]) + 1e-9
        rough[1][:-1] -= smooth
        squares = np.stack([K.banded_normal(first, v, g[k] * g[m] * (1 if k == m else 2), a, n)[0] for k, m in pairs])
        right = np.stack([K.banded_normal(first, v, w, a, n)[1] for w in g])
        lowest, highest, whole = 0.1 * a.mean(), 10 * a.mean(), float(a @ a)

        def solve(points):
            at = toward(points[:, 0], points[:, 1])
            band = np.einsum("qk,kdn->qdn", np.stack([at[:, k] * at[:, m] for k, m in pairs], -1), squares)
            rhs = at @ right
            c = np.clip(K.banded_solve_many(band + rough, rhs), lowest, highest)
            fit = (band[:, 0] * c * c).sum(1) + 2 * sum((band[:, k, : n - k] * c[:, k:] * c[:, : n - k]).sum(1) for k in range(1, 4))
            return c, whole - 2 * (rhs * c).sum(1) + fit + smooth * (np.diff(c, axis=1) ** 2).sum(1)

        theta, phi = K.shrinking_grid(lambda points: solve(points)[1], (0.0, -np.pi), (np.pi / 2, np.pi), (9, 13), at_once=True)
        c = solve(np.array([[theta, phi]]))[0][0]
        e = a - K.banded_mean(first, v, c) * (toward(theta, phi) @ g)
        r2 = 1 - float(e @ e) / max(float(((a - a.mean()) ** 2).sum()), 1e-12)
        loss = float(e @ e + smooth * (np.diff(c) ** 2).sum())
        one = {"theta": theta, "phi": phi, "r2": r2, "rmse": float(np.sqrt((e * e).mean())), "n": len(a), "loss": loss}
        return {k: np.array([u]) for k, u in one.items()} | {"knots": [knots], "coef": [c]}

    usable = df.select("recording_id", "i", "t_ms", "x", "y", "pupil").filter("x is not null and y is not null and pupil is not null")
    usable = usable.withColumns({c: F.col(c).cast("double") for c in ("t_ms", "x", "y", "pupil")})
    return many_groups(usable, ["recording_id"], each_group(fn), "theta double, phi double, r2 double, rmse double, n long, loss double, knots array<double>, coef array<double>", spread=True)


def fitted_size(df: DataFrame, fits: DataFrame, out: str = "size") -> DataFrame:
    """samples with the fitted pupil size at their time: the spline of their recording's fit, held at its ends."""
    w = Window.partitionBy("recording_id").orderBy("k")
    cells = fits.select("recording_id", "coef", F.col("knots").alias("kn"), F.posexplode("knots").alias("k", "lo"))
    cells = cells.withColumn("hi", F.lead("lo").over(w)).filter("hi > lo").withColumns({"first": F.col("lo") == F.min("lo").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "last": F.col("hi") == F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # each cell has its six knots and four coefficients
    at = cells.select("recording_id", "lo", "hi", *[F.get("kn", F.col("k") + m).alias(f"k{m + 2}") for m in range(-2, 4)], *[F.get("coef", F.col("k") - 3 + m).alias(f"c{m}") for m in range(4)], *[F.when(F.col(f), F.lit(True)).otherwise(F.lit(False)).alias(f) for f in ("first", "last")])
    # a sample finds its cell as the last one that begins at or before it
    marks = at.select("recording_id", F.col("lo").alias("t_ms"), F.struct(*[c for c in at.columns if c != "recording_id"]).alias("cell"))
    both = df.withColumn("cell", F.lit(None).cast(dict(marks.dtypes)["cell"])).withColumn("_s", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    seek = Window.partitionBy("recording_id").orderBy("t_ms", F.col("_s").asc_nulls_first())
    cell = F.coalesce(F.last("cell", True).over(seek.rowsBetween(Window.unboundedPreceding, 0)), F.first("cell", True).over(seek.rowsBetween(0, Window.unboundedFollowing)))
    both = both.withColumn("_c", cell).filter("_s = 1")
    t = F.greatest(F.col("_c.lo"), F.least(F.col("_c.hi"), F.col("t_ms")))
    d = [F.col(f"_c.c{m}") for m in range(4)]
    for level in range(1, 4):
        for m in range(3, level - 1, -1):
            # de Boor's triangle: knots k-3+m .. k+1+m-level of the cell k
            lo, hi = F.col(f"_c.k{m - 1}") if m >= 1 else None, F.col(f"_c.k{m + 3 - level}")
            x = (t - lo) / (hi - lo)
            d[m] = (1 - x) * d[m - 1] + x * d[m]
    return both.withColumn(out, d[3]).drop("cell", "_s", "_c")


def residuals(df: DataFrame, fits: DataFrame, r: float, d: float) -> DataFrame:
    """recording_id, n, rss, rmse, r2 of pupil against fitted size times cosine, worked out over all rows."""
    sized = fitted_size(df, fits).join(fits.select("recording_id", "theta", "phi"), "recording_id")
    cx, cy, cz = r * F.sin("theta") * F.cos("phi"), r * F.sin("theta") * F.sin("phi"), r * F.cos("theta")
    x, y = F.col("x"), F.col("y")
    cos = (x * cx + y * cy + d * cz) / (F.sqrt(x * x + y * y + d * d) * r)
    e = F.col("pupil") - F.col("size") * cos
    agg = sized.filter("x is not null and y is not null and pupil is not null").withColumn("_e", e).groupBy("recording_id").agg(F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("rss"), F.var_pop("pupil").alias("_v"))
    return agg.select("recording_id", "n", "rss", F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), (1 - F.col("rss") / F.greatest(F.col("_v") * F.col("n"), F.lit(1e-12))).alias("r2"))


__all__ = [
    "asymmetric_baseline", "baseline", "design_matrix", "fitted_size", "foreshortening", "foreshortening_rows", "iterated_baseline",
    "lowpass", "moving_mean", "predicted", "quality", "residuals", "response", "response_baseline",
]

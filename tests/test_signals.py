"""Blinks, fills, filters, fits, stores and readers on hand-made recordings."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions import densities as dn
from saccadia.functions import geometry as geo
from saccadia.functions import kernels as K
from saccadia.functions import units
from saccadia.operators import blinks as bl
from saccadia.operators import columns as co
from saccadia.operators import epochs as ep
from saccadia.operators import events as es
from saccadia.operators import intervals as iv
from saccadia.operators import models as md
from saccadia.operators import samples as sm
from saccadia.operators import stores as st
from saccadia.operators import views as vw
from saccadia.sources import generators as gen
from saccadia.sources import recordings as rec
from saccadia.streaming import live


def signal(spark, values, name="v", step=10.0, recording=1):
    rows = [(recording, i, i * step, None if v is None else float(v), v is None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"recording_id long, i long, t_ms double, {name} double, {name}__m boolean")


def spans(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "recording_id long, start double, end double")


def got(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_units_and_addresses(spark):
    assert units.normalize_unit("idx") is None and units.normalize_unit(" Hours ") == "h"
    assert rec.is_url("https://a.b/c") and not rec.is_url("/a/b") and not rec.is_url("https://")


def test_nearest_sample_takes_the_first_of_equal_times(spark):
    rows = [(1, 0, 0.0), (1, 1, 5.0), (1, 2, 5.0), (1, 3, 9.0)]
    s = spark.createDataFrame(rows, "recording_id long, i long, t_ms double")
    e = spark.createDataFrame([(1, 10, 6.0), (1, 11, 7.0), (1, 12, -3.0), (1, 13, 99.0)], "recording_id long, event_id long, t_ms double")
    assert {r["event_id"]: r["i"] for r in iv.nearest_index(e, s).collect()} == {10: 1, 11: 1, 12: 0, 13: 3}


def greedy(on, off, n):
    out, at = [], (on or [None])[0]
    while off and at is not None:
        e = next((x for x in off if x > at), n)
        out.append((at, e))
        at = next((x for x in on if x > e), None)
    return out


def plain_slopes(x, length):
    h = length // 2
    pad = np.concatenate([[x[0]] * h, x, [x[-1]] * h])
    k = np.arange(length) - h
    fits = [np.polyfit(k, pad[i : i + length], 2) for i in range(len(x))]
    return np.array([2 * a * h + b for a, b, _ in fits]), np.array([-2 * a * h + b for a, b, _ in fits])


def firsts(flag, longer):
    at = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(int), [0]])))
    return [int(a) for a, b in at.reshape(-1, 2) if b - a > longer]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_velocity_blinks_against_the_walk(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 10, 300)
    gap = rng.random(300) < 0.05
    filled = np.interp(np.arange(300), np.flatnonzero(~gap), x[~gap])
    back, fore = plain_slopes(filled, 5)
    on, off = firsts(np.where(gap, 0, back) <= -6, seed % 2), firsts(np.where(gap, 0, fore) >= 6, seed % 2)
    df = signal(spark, [None if g else v for v, g in zip(x, gap, strict=True)])
    assert got(bl.velocity_blinks(df, "v", 5, -6.0, 6.0, seed % 2, seed % 2)) == greedy(on, off, 300)


def test_onsets_on_offsets_and_without_offsets(spark):
    """A run of onsets that stand on the offsets of the ones before, an open end, a recording without offsets."""
    x = np.full(60, 100.0)
    assert got(bl.velocity_blinks(signal(spark, x), "v", 3, -5.0, 5.0)) == []
    x[20:] = 50.0
    back, fore = plain_slopes(x, 3)
    assert got(bl.velocity_blinks(signal(spark, x), "v", 3, -5.0, 5.0, 0, 0)) == greedy(firsts(back <= -5, 0), firsts(fore >= 5, 0), 60)
    assert got(bl.velocity_blinks(signal(spark, np.linspace(100, 0, 30)), "v", 3, -2.0, 5.0, 0, 0)) == []
    y = 100 + 60 * np.sin(np.arange(200) / 2.0)
    back, fore = plain_slopes(y, 5)
    assert got(bl.velocity_blinks(signal(spark, y), "v", 5, -20.0, 20.0, 0, 0)) == greedy(firsts(back <= -20, 0), firsts(fore >= 20, 0), 200)


def test_detect_merges_strategies_and_filters_by_duration(spark):
    x = [1000.0] * 100 + list(np.linspace(1000, 100, 10)) + [None] * 20 + list(np.linspace(100, 1000, 10)) + [1000.0] * 100 + [None] * 3 + [1000.0] * 20
    df = signal(spark, x)
    both = got(bl.detect(df, "v", 1000, 20, 5, -50.0, 50.0, 2, 2))
    assert len(both) == 1 and both[0][0] <= 110 and both[0][1] >= 130
    assert got(bl.detect(df, "v", 1000, 2, 5, strategies=("zero",))) == [(110, 130), (240, 243)]
    with pytest.raises(ValueError):
        bl.detect(df, "v", 1000, strategies=("other",))
    assert got(bl.merge_sorted(spans(spark, [(0, 5), (20, 30)]), spans(spark, [(3, 8), (25, 27)]))) == [(0, 8), (20, 30)]


def test_refined_edges_stay_in_their_window(spark):
    x = np.full(200, 1000.0)
    x[90:100] = np.linspace(1000, 200, 10)
    x[120:130] = np.linspace(200, 1000, 10)
    values = [None if 100 <= i < 120 else v for i, v in enumerate(x)]
    df = signal(spark, values)
    fine = bl.refine(df, bl.zero_blinks(df, "v", 1), "v", 5, -20.0, 20.0, (2, 3), 40).first()
    assert (fine["start"], fine["end"]) == (100, 120) and 85 <= fine["onset"] < 96 and 124 < fine["offset"] <= 135
    out, done = bl.reconstruct(df, bl.zero_blinks(df, "v", 1), "v", 100, 50, -2.0, 2.0, (20, 30), 400)
    assert done.count() == 1 and out.filter("v is null").count() == 0
    assert out.filter("v__m").count() == done.first()["end"] - done.first()["start"]
    assert bl.refine(df, spans(spark, [(10, 12)]).select("recording_id", F.col("start").cast("long"), F.col("end").cast("long")), "v", 5, -20.0, 20.0).count() == 0


def test_the_last_blink_counts_where_two_share_their_points(spark):
    """Both have t2 = 1 and t3 = 10; the later one, from 1 on, has t4 = 19, the other 20."""
    df = signal(spark, [float(i**3 % 17) for i in range(40)])
    ends = "recording_id long, onset long, offset long"
    want = bl.interpolate_cubic(df, spark.createDataFrame([(1, 1, 10)], ends), "v", "w")
    for rows in ([(1, 0, 10), (1, 1, 10)], [(1, 1, 10), (1, 0, 10)]):
        both = bl.interpolate_cubic(df, spark.createDataFrame(rows, ends).coalesce(1), "v", "w")
        assert [r["w"] for r in both.orderBy("i").collect()] == [r["w"] for r in want.orderBy("i").collect()]


@pytest.mark.parametrize(("method", "want"), [("linear", [2, 4, 6]), ("cubic", [2, 4, 6]), ("nearest", [0, 0, 8]), ("previous", [0, 0, 0]), ("next", [8, 8, 8])])
def test_interpolated_intervals(spark, method, want):
    df = signal(spark, [0, None, None, None, 8, None])
    out = bl.interpolate(df, spans(spark, [(1, 4), (5, 9)]), "v", method, "w").orderBy("i").collect()
    assert [r["w"] for r in out] == [0, *want, 8, None]
    assert [r["w__m"] for r in out] == [False, True, True, True, False, True]
    with pytest.raises(ValueError):
        bl.interpolate(df, spans(spark, []), "v", "other")


def test_smoothing_rules(spark):
    x = np.random.default_rng(3).normal(size=30)
    for n in (5, 6):
        w = np.hanning(n) / np.hanning(n).sum()
        s = np.concatenate([x[n - 1 : 0 : -1], x, x[-2 : -n - 1 : -1]])
        want = np.convolve(w, s, "same")[n - 1 : -n + 1]
        have = [r["v"] for r in sm.smooth(signal(spark, x), "v", n).orderBy("i").collect()]
        assert have == pytest.approx(want)
    assert sm.smooth(signal(spark, x), "v", 2).count() == 30
    for bad in ([1.0, None, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0]):
        with pytest.raises(Exception, match="missing|shorter"):
            sm.smooth(signal(spark, bad), "v", 5).collect()


def test_filter_in_blocks_is_the_filter(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1500).cumsum()
    have = {r["i"]: r["filtered"] for r in md.lowpass(signal(spark, x), "v", 0.1, 1.0, block=200).collect()}
    assert [have[i] for i in range(1500)] == pytest.approx(K.lowpass(x, 0.1, 1.0), abs=1e-6)
    values = [None if rng.random() < 0.1 else v for v in x]
    have = {r["i"]: r["filtered"] for r in md.lowpass(signal(spark, values), "v", 0.1, 1.0, block=200).collect()}
    assert [have[i] for i in range(1500)] == pytest.approx(K.lowpass_gaps(np.array(values, float), 0.1, 1.0), abs=1e-5)
    assert [r["filtered"] for r in md.lowpass(signal(spark, [None] * 9), "v", 0.1, 1.0).collect()] == [None] * 9


def test_filter_against_the_recursion():
    for order, cut in ((2, 0.05), (3, 0.2), (4, 0.1)):
        b, a = K.butterworth(order, cut, 1.0)
        x = np.random.default_rng(order).normal(size=200)
        h = K.impulse(b, a, 200)
        y = np.zeros(200)
        for n in range(200):
            y[n] = sum(b[j] * x[n - j] for j in range(order + 1) if n >= j) - sum(a[j] * y[n - j] for j in range(1, order + 1) if n >= j)
        assert np.convolve(h, x)[:200] == pytest.approx(y)


def test_splines_and_troughs():
    t, knots = np.linspace(0, 9000, 200), K.clamped_knots(0, 9000)
    first, v = K.local_basis(t, knots)
    assert v.sum(1) == pytest.approx(np.ones(200)) and K.bspline_basis(t, knots) @ np.ones(len(knots) - 4) == pytest.approx(np.ones(200))
    band, rhs = K.banded_normal(first, v, np.ones(200), np.sin(t / 900), len(knots) - 4)
    dense = K.bspline_basis(t, knots)
    assert K.banded_solve(band, rhs) == pytest.approx(np.linalg.lstsq(dense, np.sin(t / 900), rcond=None)[0], abs=1e-6)
    x = np.array([0.0, 1, 4, 6, 9])
    at = np.linspace(0, 9, 40)
    assert K.cubic_spline(x, x**3 - x, at) == pytest.approx(at**3 - at)
    k, p = K.troughs([5, 1, 4, 2, 2, 6, 0, 3])
    assert k.tolist() == [1, 3, 6] and p.tolist() == [4, 2, 3]


def test_fits_recover_their_settings(spark):
    setup = geo.Setup.of(1920, 1080, 520, 290, 700, camera={"r": 600, "theta": 1.45, "phi": 0.1})
    made = gen.foreshortened_recording(spark, setup, seconds=40, fs=200, noise=2.0)
    rows = md.foreshortening_rows(made, "left", setup, 200)
    assert 1000 < rows.count() <= 2000  # a quarter of the samples, less those the camera can't see
    fit = md.foreshortening(rows, setup.r, setup.d)
    one = fit.first()
    assert abs(one["theta"] - 1.45) < 0.09 and abs(one["phi"] - 0.1) < 0.09 and one["r2"] > 0.9
    assert md.residuals(rows, fit, setup.r, setup.d).first()["r2"] == pytest.approx(one["r2"], abs=1e-6)
    first, v = K.local_basis([r["t_ms"] for r in rows.orderBy("i").collect()], np.array(one["knots"]))
    size = [r["size"] for r in md.fitted_size(rows, fit).orderBy("i").collect()]
    assert size == pytest.approx(K.banded_mean(first, v, np.array(one["coef"])))
    few = made.filter("i < 50")
    assert md.foreshortening_rows(few, "left", setup, 200).count() == 0
    assert md.foreshortening(rows.withColumn("x", F.lit(None).cast("double")), setup.r, setup.d).count() == 0


def test_camera_grid_is_solved_at_once():
    """All points of a grid from sums over the samples, as each by itself; many systems as one by one."""
    g = np.random.default_rng(2)
    half = g.normal(size=(7, 9, 9)) + 4 * np.eye(9)
    full = half @ half.transpose(0, 2, 1)
    band = np.stack([np.pad(np.diagonal(full, k, 1, 2), ((0, 0), (0, k))) for k in range(4)], 1)
    band[:, 0] += 40
    rhs = g.normal(size=(7, 9))
    assert K.banded_solve_many(band, rhs) == pytest.approx(np.stack([K.banded_solve(b, r) for b, r in zip(band, rhs, strict=True)]))
    f = lambda u, v: (u - 0.3) ** 2 + (v + 1) ** 2 + u * v
    assert K.shrinking_grid(lambda p: f(p[:, 0], p[:, 1]), (-2, -2), (2, 2), (5, 7), at_once=True).tolist() == K.shrinking_grid(f, (-2, -2), (2, 2), (5, 7)).tolist()


def test_groups_go_on_over_batches(spark):
    """Groups shorter and longer than a batch, a null key among them, each whole and in order."""
    sizes = {None: 4, 1: 1, 2: 9, 3: 2, 4: 3, 5: 7}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows[::-1], "recording_id long, i long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = md.many_groups(df, ["recording_id"], md.each_group(lambda p: {"n": np.array([len(p["i"])]), "all": [p["i"].astype(float)]}), "n long, all array<double>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r["recording_id"]: r["n"] for r in out} == sizes and len(out) == 6
    assert all(r["all"] == list(range(r["n"])) for r in out)


def test_camera_rows_are_worked_out_once(spark, tmp_path):
    from saccadia.plans import catalog

    rows = [(k % 2, k, 0, 1, float(5 + k % 40), float(2000 + k * 7 % 70000), 0.01, 0.02) for k in range(300)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    df.withColumn("l_shipdate", F.timestamp_seconds("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.foreshortening_residuals(spark, str(tmp_path))
    assert found.count() == 2
    assert "lineitem" not in found._jdf.queryExecution().optimizedPlan().toString() + str(found.inputFiles())


def test_short_splines_are_solved_whole(monkeypatch):
    z = np.random.default_rng(4).normal(size=90)
    z[7] = np.nan
    knots = np.concatenate([[0.0] * 3, np.linspace(0, 89, 12), [89.0] * 3])
    whole = md._spline_below(z, knots, np.ones(90), 0.05)
    monkeypatch.setattr(md, "FEW", 0)
    assert whole == pytest.approx(md._spline_below(z, knots, np.ones(90), 0.05), abs=1e-6)


def test_responses_and_baselines(spark):
    made = gen.pupil_responses(spark, 1, npar=(8.0, 0.0), tmax=(800.0, 0.0), weight=(1.0, 0.3)).cache()
    fit = md.response(made, "pupil", None, None, baseline="baseline")
    one = fit.first()
    true = [r["weight"] for r in made.filter("event").orderBy("i").collect()]
    assert one["coef"] == pytest.approx(true, abs=0.1) and abs(one["tmax"] - 800) < 60
    p = md.predicted(made, fit).orderBy("i").collect()
    assert np.corrcoef([r["response"] for r in p], [r["pupil"] - r["baseline"] for r in p])[0, 1] > 0.98
    wavy = gen.pupil_responses(spark, 1, 12, 3000, 50, baseline_freq=0.05, noise=0.05, scale=(500.0, 50.0))
    truth = [r["baseline"] for r in wavy.orderBy("i").collect()]
    events = wavy.filter("event").select("recording_id", F.col("i").alias("event_id"), "t_ms")
    base = [r["baseline"] for r in md.response_baseline(wavy, events, "pupil", 50.0).orderBy("i").collect()]
    assert np.corrcoef(base, truth)[0, 1] > 0.9
    low = [r["base2"] for r in md.iterated_baseline(wavy, "pupil", 50.0).orderBy("i").collect()]
    assert np.corrcoef(low, truth)[0, 1] > 0.8
    assert md.response(made.withColumn("pupil", F.lit(None).cast("double")), "pupil").count() == 0


def test_quality(spark):
    x = 3 + np.sin(np.arange(400) / 40)
    noisy = x + np.random.default_rng(5).normal(0, 0.1, 400)
    good, bad = (md.quality(signal(spark, v, step=10.0), "v", 100).agg(F.avg("snr_db"), F.min("noise_cv")).first() for v in (x, noisy))
    assert good[0] > bad[0] + 10 and bad[1] > 0


def test_densities_and_their_inverse(spark):
    y = spark.range(400).select((F.col("id") / 20 - 10).alias("y"))
    total = y.select(F.sum(dn.asymmetric_laplace(F.col("y"), 0.0, 0.5, 0.2) / 20), F.sum(dn.asymmetric_laplace_kappa(F.col("y"), 0.0, 2.0, 0.5) / 20)).first()
    assert total[0] == pytest.approx(1, abs=0.02) and total[1] == pytest.approx(1, abs=0.02)
    for a, b in ((0, 1), (2, np.inf), (-np.inf, 3)):
        there = y.select(F.max(F.abs(dn.unbounded(dn.bounded(F.col("y") / 10, a, b), a, b) - F.col("y") / 10))).first()[0]
        assert there < 1e-9


def test_events(spark):
    s = signal(spark, range(11))
    e = spark.createDataFrame([(1, 1, "stim", 10.0), (1, 2, "resp", 50.0), (1, 3, "stim", 100.0)], "recording_id long, event_id long, label string, t_ms double")
    assert es.select(e, "stim").count() == 2 and es.select(e, time_range=(20, 80)).count() == 1
    assert [r["event_id"] for r in es.take(e, -2).orderBy("event_id").collect()] == [2, 3]
    assert [r["event_id"] for r in es.take(e, 0, None, 2).orderBy("event_id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        es.select(e, time_range=(5, 5))
    new = spark.createDataFrame([(1, "a", 0.05)], "recording_id long, label string, t double")
    assert es.replaced(new, s, "s").first()["t_ms"] == pytest.approx(50)
    with pytest.raises(Exception, match="outside"):
        es.replaced(new.withColumn("t", F.lit(9.0)), s, "s").collect()
    with pytest.raises(Exception, match="unequal"):
        iv.between_events(es.select(e, "stim"), es.select(e, "resp")).collect()


def test_signals_as_columns(spark):
    rows = [(1, i, i * 1.0, 1.0, False, 2.0, i == 1, 3.0, False) for i in range(3)]
    df = spark.createDataFrame(rows, "recording_id long, i long, t_ms double, left_x double, left_x__m boolean, left_pupil double, left_pupil__m boolean, right_x double, right_x__m boolean")
    assert co.signals(co.of_eye(df, "left")) == ["left_pupil", "left_x"] and co.signals(co.of_variable(df, "x")) == ["left_x", "right_x"]
    assert co.masked_counts(df).first()["most"] == 1 and co.signals(co.pupil_of(df)) == ["left_pupil"]
    with pytest.raises(KeyError):
        co.without(df, "none")
    with pytest.raises(ValueError):
        co.without(df, "t_ms")
    nan = co.put(df, "left_x", F.lit(float("nan")))
    assert nan.filter("left_x is null and left_x__m").count() == 3
    wanted = spark.createDataFrame([("left", "none")], "eye string, variable string")
    assert st.looked_up(df, wanted, strict=False).count() == 0
    with pytest.raises(Exception, match="no signal"):
        st.looked_up(df, wanted).collect()


def test_signals_are_looked_up_where_they_are(spark):
    """No sample moves to one of a few tasks, one for each wanted signal; a signal wanted twice comes twice."""
    rows = [(1, i, i * 1.0, float(i), i == 1, -float(i), False) for i in range(3)]
    df = spark.createDataFrame(rows, "recording_id long, i long, t_ms double, left_x double, left_x__m boolean, right_pupil double, right_pupil__m boolean")
    found = st.looked_up(df, spark.createDataFrame([("right", "pupil"), ("left", "x"), ("left", "x")], "eye string, variable string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted([(1, i, "left", "x", float(i), i == 1) for i in range(3)] * 2 + [(1, i, "right", "pupil", -float(i), False) for i in range(3)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    with pytest.raises(Exception, match="no signal"):
        st.looked_up(df, spark.createDataFrame([("left", "x"), (None, "left_x")], "eye string, variable string")).collect()


def test_statistic_by_function_and_epochs(spark):
    s = signal(spark, [1, 2, None, 4, 5, 6])
    one = spark.createDataFrame([(1, 7, 11.0, 39.0), (1, 8, 21.0, 22.0)], "recording_id long, event_id long, start double, end double")
    got_ = {r["event_id"]: r["v"] for r in iv.stat_per_event(s, one, ["v"], F.max).collect()}
    assert got_ == {7: 4.0, 8: None}
    with pytest.raises(ValueError):
        iv.stat_per_event(s, one, ["v"], "other")
    cut = ep.cut(s, spark.createDataFrame([(1, 1, 0.0)], "recording_id long, event_id long, t_ms double"), "v", 1, 2, outside=True)
    assert [(r["k"], r["v"], r["masked"]) for r in cut.orderBy("k").collect()] == [(-1, None, True), (0, 1.0, False), (1, 2.0, False), (2, None, True)]


def test_levels_keep_a_spike(spark):
    x = [0.0] * 95
    x[33], x[37] = 9.0, -9.0
    rows = vw.levels(signal(spark, x), "v", (10,)).filter("chunk = 3").orderBy("pos").collect()
    assert [r["value"] for r in rows] == [9.0, -9.0] and vw.levels(signal(spark, x), "v", (10,)).count() == 18


def test_tracker_files(spark, tmp_path):
    text = "\n".join(["START 1", "MSG 10 !CAL x", "MSG 20 experiment_start", "MSG 20 first", "MSG 30 GAZE_COORDS 0 0", "EFIX L 1 2 3 4 5 6", "MSG 40 second more"])
    (tmp_path / "e.asc").write_text(text)
    events = rec.read_messages(spark, str(tmp_path / "e.asc"))
    assert [(r["event_id"], r["t_ms"], r["label"]) for r in events.orderBy("event_id").collect()] == [(0, 20.0, "first"), (1, 30.0, "GAZE_COORDS"), (2, 40.0, "second")]
    assert rec.without_tracker_messages(events).count() == 2
    for n in "ab":
        (tmp_path / f"{n}.asc").write_text("1\t1\t2\t3\t4\t5\t6\n2\t   .\t2\t0\t4\t5\t6\n")
    (tmp_path / "c.json").write_text(json.dumps({"raw_data": {n: {"samples": str(tmp_path / f"{n}.asc")} for n in "ab"}}))
    study = rec.read_study(spark, str(tmp_path / "c.json"), ["a", "nobody"])
    assert {(r["recording_id"], r["i"], r["left_x"], r["left_pupil"]) for r in study.collect()} == {("a", 0, 1.0, 3.0), ("a", 1, None, None)}
    assert rec.read_study(spark, str(tmp_path / "c.json")).count() == 4 and rec.read_study(spark, str(tmp_path / "c.json"), ["nobody"]).count() == 0
    rec.write_bundle(str(tmp_path / "out"), samples=study)
    assert rec.read_bundle(spark, str(tmp_path / "out"), "samples").count() == 2
    lines = ["MSG 5 !CAL VALIDATE R POINT 0  RIGHT  at 640,512  OFFSET 0.9 deg.  1.0,2.0 pix.", "MSG 9 !CAL VALIDATE R POINT 0  RIGHT  at 640,512  OFFSET 0.3 deg.  -13.3,-1.6 pix.", "MSG 9 !CAL VALIDATE R POINT 1  RIGHT  at 640,87  OFFSET 0.42 deg.  16.1,9.2 pix."]
    (tmp_path / "v.asc").write_text("\n".join(lines))
    assert sorted((r["eye"], r["i"], r["offset"], r["diff_x"]) for r in rec.read_validations(spark, str(tmp_path / "v.asc")).collect()) == [("right", 0, 0.3, -13.3), ("right", 1, 0.42, 16.1)]


def test_tracker_records(spark):
    points = [(640.0, 512.0, 0.3, -13.3, -1.6)]
    record = {
        "info": {"sample_fields": ["xpos", "ypos", "ps"], "eye": "RIGHT", "calibrations": [{"eye": "RIGHT", "validation": [(0.0,) * 5]}, {"eye": "RIGHT", "validation": points}]},
        "samples": [[1.0, 2.0], [3.0, 4.0], [5.0, 0.0]], "times": [0.0, 0.002], "discrete": {"messages": {"stime": [0.001, 0.002], "msg": [b"go", b"!MODE x"]}},
    }
    samples, events, validation = rec.from_tracker(spark, record, "r")
    assert [(r["t_ms"], r["right_x"], r["right_pupil"]) for r in samples.orderBy("i").collect()] == [(0.0, 1.0, 5.0), (2.0, 2.0, None)]
    assert [(r["t_ms"], r["label"]) for r in events.collect()] == [(1.0, "go")] and validation.first()["offset"] == 0.3


def test_simulations_run_again(spark):
    one = gen.Simulation("trials", {"ntrials": 4, "fs": 20})
    a, b, c = (x.orderBy("i").collect() for x in (one.run(spark), one.run(spark), one.run(spark, seed=9)))
    assert a == b and a != c and sum(r["event"] for r in a) in (7, 8) and one.call() == "trials(ntrials=4, fs=20)"
    steps = gen.gaze_steps(spark, 100, 5, n=2)
    assert steps.count() == 1000 and steps.select("recording_id", "x").distinct().count() > 10


def test_simulated_recordings_are_dealt_out(spark):
    """Many rows come of a few ids: these don't end up in one task; filters and kernels are worked out once."""
    ids = spark.range(40).withColumnRenamed("id", "recording_id")
    K.kernel_duration.cache_clear()
    made = gen.trials(spark, ids.unionByName(ids), ntrials=2, fs=20)
    at = made.groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("recording_id").alias("n")).collect()
    assert len(at) == 4 and sum(r["n"] for r in at) == 40
    one = [tuple(r) for r in gen.trials(spark, 8, ntrials=2, fs=20).filter("recording_id = 7").orderBy("i").collect()]
    assert one == [tuple(r) for r in made.filter("recording_id = 7").orderBy("i").collect()]
    for _ in range(3):
        K.kernel_duration(10.1, 930.0)
        K.lowpass(np.arange(9.0), 0.2, 50.0)
    assert K.kernel_duration.cache_info().misses == 1


def test_setup_changes_keep_the_distance():
    s = geo.Setup.of(1920, 1080, 520, 290, "70 cm", offset=(30, 40))
    assert s.update(width=1000).d == s.d and s.update(dx=0, dy=0).d == pytest.approx(700)
    assert s.update(distance=800).d == pytest.approx((800**2 - 2500) ** 0.5)


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:0{s}.{m}00", None if s == 1 else float(s)) for s in range(4) for m in range(5)]
    src = spark.createDataFrame(rows, "recording_id long, t string, v double").selectExpr("recording_id", "cast(t as timestamp) as ts", "v")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in (("means", live.windowed_means(stream, "v")), ("gaps", live.missing_sessions(stream, "v", "500 milliseconds"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "means" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        time.sleep(0.1)
    assert {r["v"] for r in spark.table("means").collect()} == {0.0, None, 2.0, 3.0}


def test_small_kernels_and_setups():
    last = K.kernel_duration(10.1, 930.0)
    assert K.pupil_kernel(np.array([last]))[0] <= 1e-8 < K.pupil_kernel(np.array([last - 1]))[0]
    s = geo.Setup.of(1000, 800, 500, 400, 600, camera=(30, -400, 450))
    assert s.camera_position() == pytest.approx((30, -400, 450)) and geo.Setup.from_dict(s.to_dict()) == s and s.is_complete()
    with pytest.raises(ValueError):
        geo.Setup.of(1000, 800, 500, 400, 10, offset=(20, 0))


def test_rectangle_from_angles(spark):
    from saccadia.functions.rois import Rectangle

    s = geo.Setup.of(1000, 1000, 500, 500, 600)
    box = Rectangle.from_degrees(("-5 deg", "-5 deg"), ("5 deg", "5 deg"), s)
    side = 600 * np.tan(np.radians(5)) * 2
    got_ = spark.range(1).select(box.contains(F.lit(500 + side - 0.1), F.lit(500)), box.contains(F.lit(500 + side + 0.1), F.lit(500))).first()
    assert tuple(got_) == (True, False)


def test_noise_has_its_spread(spark):
    df = signal(spark, [5.0] * 2000)
    noisy = gen.with_noise(df, "v", 2.0, seed=4)
    assert noisy.agg(F.stddev("v")).first()[0] == pytest.approx(2.0, rel=0.1)

"""Hand-checked fixtures and properties of the signal operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions import geometry as geo
from saccadia.functions import kernels as K
from saccadia.functions import units
from saccadia.operators import blinks as bl
from saccadia.operators import intervals as iv
from saccadia.operators import models as md
from saccadia.operators import samples as sm
from saccadia.sources import generators as gen


def signal(spark, values, masks=None, name="v"):
    rows = [(1, i, float(i * 10), None if v is None else float(v), v is None if masks is None else masks[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"recording_id long, i long, t_ms double, {name} double, {name}__m boolean")


def spans(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "recording_id long, start double, end double")


def got(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_units():
    assert [units.normalize_unit(u) for u in ("s", "minutes", "hrs", "samples")] == ["sec", "min", "h", None]
    assert units.parse_distance("60 cm") == 600 and units.parse_angle("180 deg") == pytest.approx(np.pi)
    with pytest.raises(ValueError):
        units.normalize_unit("parsec")


def test_mask_runs(spark):
    m = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0]
    assert got(iv.runs(signal(spark, m), F.col("v") == 1)) == [(2, 5), (7, 9)]


def test_interval_algebra(spark):
    a, b = spans(spark, [(0, 100), (200, 300)]), spans(spark, [(50, 150)])
    assert got(iv.subtract(a, b)) == [(0, 50), (200, 300)]
    assert got(iv.intersect(a, b)) == [(50, 100)]
    assert got(iv.merge(spans(spark, [(10, 15), (17, 22)]), 2)) == [(10, 22)]
    once = iv.merge(spans(spark, [(0, 5), (5, 6), (9, 12), (10, 11)])).drop("parts")
    assert got(once) == got(iv.merge(once)) == [(0, 6), (9, 12)]
    assert got(iv.pad(spans(spark, [(100, 200), (300, 400)]), 10, 20, F.lit(0.0), F.lit(1e9))) == [(90, 220), (290, 420)]
    d = spans(spark, [(0, 100), (200, 400), (500, 550)])
    assert iv.select(d, max_duration=100).count() == 2 and iv.select(d, min_duration=150).count() == 1


def test_scale_and_back(spark):
    x = signal(spark, [1, 2, 1, 2])
    z = sm.scale(x, ["v"])
    assert z.agg(F.avg("v")).first()[0] == pytest.approx(0)
    back = sm.unscale(z, sm.scale_params(x, ["v"]), ["v"]).orderBy("i")
    assert [r["v"] for r in back.collect()] == pytest.approx([1, 2, 1, 2])


def test_gap_filler(spark):
    rows = [(1, i, float(t), 1.0, False) for i, t in enumerate([0, 1, 2, 10, 11, 12])]
    f = sm.fill_gaps(spark.createDataFrame(rows, "recording_id long, i long, t_ms double, v double, v__m boolean"), ["v"])
    assert [r["t_ms"] for r in f.orderBy("i").collect()] == list(range(13))
    assert f.filter("v__m").count() == 7


def test_slope_of_a_ramp(spark):
    v = bl.velocity(signal(spark, range(20)), "v", 5).filter("i between 2 and 17").select("velocity").collect()
    assert [r[0] for r in v] == pytest.approx([1.0] * 16)
    assert K.slope_weights(5) == pytest.approx([-0.2, -0.1, 0, 0.1, 0.2])


def test_blinks(spark):
    x = [5.0] * 10 + [None] * 5 + [5.0] * 10 + [None] * 3
    assert got(bl.zero_blinks(signal(spark, x), "v", 2)) == [(10, 15)]
    line = bl.interpolate_linear(signal(spark, [0, None, None, 3]), spans(spark, [(1, 3)]), "v", "out").orderBy("i")
    assert [r["out"] for r in line.collect()] == pytest.approx([0, 1, 2, 3])


def test_merge_eyes(spark):
    rows = [(1, 1.0, False, 3.0, False), (2, 1.0, True, 3.0, False), (3, 1.0, True, 3.0, True)]
    df = spark.createDataFrame(rows, "i long, l double, l__m boolean, r double, r__m boolean")
    out = sm.merge_eyes(df, "l", "r", "m").orderBy("i").collect()
    assert [(r["m"], r["m__m"]) for r in out] == [(2.0, False), (3.0, False), (None, True)]


def test_regions(spark):
    r = spark.range(1).select(geo.in_circle(F.lit(3), F.lit(4), 0, 0, 5), geo.in_circle(F.lit(6), F.lit(0), 0, 0, 5)).first()
    assert tuple(r) == (True, False)
    with pytest.raises(ValueError):
        geo.in_circle(F.lit(0), F.lit(0), 0, 0, -1)


def test_filter_design():
    b, a = K.butterworth(2, 10, 100)
    assert b.sum() / a.sum() == pytest.approx(1)
    z = np.exp(-1j * 2 * np.pi * 10 / 100 * np.arange(3))
    assert abs((b @ z) / (a @ z)) == pytest.approx(2**-0.5)
    assert K.lowpass(np.full(100, 3.0), 5, 100) == pytest.approx(np.full(100, 3.0))


def test_least_squares():
    a = np.array([[1.0, 0], [0, 1], [1, 1]])
    assert K.nonnegative(a, a @ [2, 0.5]) == pytest.approx([2, 0.5], abs=1e-6)
    assert K.nonnegative(a, np.array([1.0, -5, -4])).min() >= 0


def test_recovery(spark):
    fit = md.foreshortening(gen.foreshortened(spark, 1), 600, 700).first()
    assert abs(fit["theta"] - 1.48) < 0.09 and fit["r2"] > 0.5
    r = md.response(gen.pupil_responses(spark, 1), "pupil").first()
    assert np.mean(r["coef"]) == pytest.approx(1, abs=0.3)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

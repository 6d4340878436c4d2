"""Splines as sums by cell against dense matrices and plain solves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.operators import models as md
from saccadia.operators import splines


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(11)
    rows = [(r, i, i * 2.0 + 5, float(np.sin(i / 40) + 4 + 0.2 * rng.normal()) if rng.random() > 0.1 else None) for r, n in ((1, 900), (2, 50), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, i long, t_ms double, v double").cache()


def test_basis_fit_and_values(spark, waves):
    knots = splines.evenly(waves, "t_ms", 8.0)
    size = {r["recording_id"]: (r["lo"], r["hi"], r["inner"]) for r in knots.collect()}
    rows = {}
    for r in waves.orderBy("i").collect():
        rows.setdefault(r["recording_id"], []).append((r["t_ms"], r["v"]))
    got = splines.basis(waves, knots).collect()
    fit = splines.fitted(waves, "v", knots)
    coef = {}
    for r in fit.orderBy("basis").collect():
        coef.setdefault(r["recording_id"], []).append(r["a"])
    values = {(r["recording_id"], r["i"]): r["value"] for r in splines.values(splines.placed(waves, knots), fit).collect()}
    for rec, (lo, hi, inner) in size.items():
        t = np.array([x for x, _ in rows[rec]])
        b = K.bspline_basis(t, np.concatenate([[lo] * 4, np.linspace(lo, hi, inner + 2)[1:-1], [hi] * 4]))
        dense = np.zeros_like(b)
        for r in got:
            if r["recording_id"] == rec:
                dense[r["i"], r["basis"]] = r["value"]
        assert np.allclose(dense, b)
        y = np.array([np.nan if v is None else v for _, v in rows[rec]])
        ok = ~np.isnan(y)
        plain = np.linalg.solve(b[ok].T @ b[ok] + 1e-9 * np.eye(b.shape[1]), b[ok].T @ y[ok])
        if rec == 1:
            assert np.allclose(coef[rec], plain, rtol=1e-6)
        assert np.allclose([values[rec, i] for i in range(len(t))], b @ coef[rec])


def test_objective(spark):
    rng = np.random.default_rng(12)
    n, r, d, theta, phi = 400, 600.0, 700.0, 1.3, 0.2
    x, y, a = rng.normal(0, 80, n), rng.normal(0, 60, n), rng.normal(4, 0.3, n)
    df = spark.createDataFrame([(1, i, i * 10.0, float(x[i]), float(y[i]), float(a[i])) for i in range(n)] + [(1, n, 5.0, None, 1.0, 1.0)], "recording_id long, i long, t_ms double, x double, y double, pupil double")
    knots = splines.evenly(df, "t_ms", 1.0)
    c = rng.normal(4, 0.2, int(knots.first()["inner"]) + 4)
    coef = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(c)], "recording_id long, basis int, a double")
    got = splines.objective(df, coef, knots, theta, phi, r, d, 0.7, 12.0).first()
    b = K.bspline_basis(np.arange(n) * 10.0, K.clamped_knots(0.0, (n - 1) * 10.0, 1.0))
    cx, cy, cz = r * np.sin(theta) * np.cos(phi) - 12, r * np.sin(theta) * np.sin(phi), r * np.cos(theta)
    cos = ((x - 12) * cx + y * cy + d * cz) / np.sqrt((x - 12) ** 2 + y**2 + d**2) / np.sqrt(cx**2 + cy**2 + cz**2)
    e = a - b @ c * cos
    smooth = 0.7 * (np.diff(c) ** 2).sum()
    assert (got["n"], got["data_loss"], got["smooth_loss"]) == (n, pytest.approx(e @ e), pytest.approx(smooth))
    assert got["loss"] == pytest.approx(e @ e + smooth) and got["r2"] == pytest.approx(1 - e @ e / ((a - a.mean()) ** 2).sum())


def test_baseline_equals_the_plain_solve(spark, waves):
    """All rounds, samples of one recording in several tasks."""
    df = waves.withColumn("v", F.when(F.col("recording_id") != 3, F.col("v")))
    want = {(r["recording_id"], r["i"]): r["baseline"] for r in md.asymmetric_baseline(df, "v", 5).collect()}
    got = {(r["recording_id"], r["i"]): r["baseline"] for r in splines.asymmetric_baseline(df.repartition(6), "v", 5, tolerance=-1.0, rounds=30).collect()}
    assert want.keys() == got.keys()
    for k, v in want.items():
        assert (v is None) == (got[k] is None) and (v is None or got[k] == pytest.approx(v, abs=1e-5))


def test_systems_of_several_sizes_are_solved_together(spark):
    """Recordings with other numbers of cells, some of them empty, against one system at a time."""
    rows = [(r, i, float(np.sin(i / (3 + r)) + r)) for r, n in ((1, 30), (2, 55), (3, 30), (4, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "recording_id long, i long, v double")
    knots = splines.evenly(df, "i", 100.0)
    sums = splines.normal_sums(splines.placed(df, knots, "i"), F.col("v"), F.lit(1.0))
    n = {r["recording_id"]: r["inner"] + splines.DEGREE + 1 for r in knots.collect()}
    got = {(r["recording_id"], r["basis"]): r["a"] for r in splines.solved(sums, knots, 0.01, 0.1).collect()}
    assert len(got) == sum(n.values()) and len(set(n.values())) > 1
    cells = sums.collect()
    for rec, size in n.items():
        full, right = 0.01 * np.eye(size) + 0.1 * np.diff(np.eye(size), axis=0).T @ np.diff(np.eye(size), axis=0), np.zeros(size)
        for c in (c for c in cells if c["recording_id"] == rec):
            for a in range(4):
                right[c["cell"] + a] += c[f"r_{a}"]
                for b in range(a, 4):
                    full[c["cell"] + a, c["cell"] + b] += c[f"m_{a}{b}"]
                    if b > a:
                        full[c["cell"] + b, c["cell"] + a] += c[f"m_{a}{b}"]
        assert [got[rec, k] for k in range(size)] == pytest.approx(np.linalg.solve(full, right).tolist())

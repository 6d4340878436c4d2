"""Baselines and response weights against the fits that hold one recording in a task."""

import numpy as np
import pytest

from saccadia.functions import kernels as K
from saccadia.operators import envelopes
from saccadia.operators import models as md
from saccadia.sources import generators as gen


@pytest.fixture(scope="module")
def made(spark):
    return gen.pupil_responses(spark, 2, 5, npar=(8.0, 0.0), tmax=(800.0, 0.0), weight=(1.0, 0.3)).cache()


@pytest.mark.parametrize("method", ["linear", "cubic"])
def test_trough_baseline(spark, made, method):
    df = made.unionByName(made.filter("i < 2").selectExpr("recording_id + 10 as recording_id", "i", "t_ms", "pupil", "baseline", "event", "weight"))
    want = {(r["recording_id"], r["i"]): r["baseline"] for r in md.baseline(df, "pupil", 20.0, 2.0, 60.0, method).collect()}
    got = {(r["recording_id"], r["i"]): r["baseline"] for r in envelopes.trough_baseline(df, "pupil", 20.0, 2.0, 60.0, method, 6).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def test_cubic_moments_of_few_knots():
    for n in (1, 2, 3, 6):
        x, y = np.arange(n) * 2.0 + 1, np.array([1.0, 4.0, 2.0, 7.0, 0.0, 3.0])[:n]
        c, at = K.cubic_moments(x, y), np.linspace(x[0], x[-1], 9)
        k = np.clip(np.searchsorted(x, at, "right") - 1, 0, max(n - 2, 0))
        if n > 1:
            h = np.diff(x)[k]
            a, b = (x[k + 1] - at) / h, (at - x[k]) / h
            assert np.allclose(a * y[k] + b * y[k + 1] + ((a**3 - a) * c[k] + (b**3 - b) * c[k + 1]) * h**2 / 6, K.cubic_spline(x, y, at))


def test_response_weights(spark, made):
    want = {r["recording_id"]: r for r in md.response(made, "pupil", 8.0, 800.0, baseline="baseline").collect()}
    got = {r["recording_id"]: r for r in envelopes.response_weights(made, "pupil", 8.0, 800.0, "baseline").collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k]["onsets"] == w["onsets"] and got[k]["coef"] == pytest.approx(w["coef"], abs=1e-5) and got[k]["rss"] == pytest.approx(w["rss"], rel=1e-4)
    one = envelopes.response_weights(made.filter("recording_id = 1"), "pupil", 8.0, None, "baseline", rounds=3).first()
    assert abs(one["tmax"] - 800) < 60 and one["npar"] == 8.0
    assert envelopes.response_weights(made.filter("not event"), "pupil").count() == 0

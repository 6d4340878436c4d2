"""Operators for long recordings, intervals and groups against the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.operators import dyadic, extrema, long, selection
from saccadia.operators import intervals as iv
from saccadia.operators import samples as sm


@pytest.fixture(scope="module")
def recording(spark):
    rng = random.Random(7)
    rows = [(r, i, i * 2.0 + r, rng.choice([None, None, round(rng.uniform(3, 9), 2)])) for r, n in ((1, 5000), (2, 7), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, i long, t_ms double, pupil double").cache()


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_scans_in_eight_parts_give_the_plain_rows(spark, recording):
    ordered = long._ordered(recording, ["i"], 8)
    assert max(r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()) < 1000
    rng = random.Random(8)
    spans = [(rng.choice([1, 1, 1, 2]), float(a), float(a + rng.randrange(1, 60)), i) for i, a in enumerate(rng.choices(range(9900), k=300))]
    ivs = spark.createDataFrame(spans, "recording_id long, start double, end double, event_id long")
    same(long.merge(ivs, 3.0, 8), iv.merge(ivs, 3.0))
    same(long.runs(recording, F.col("pupil").isNull(), 8), iv.runs(recording, F.col("pupil").isNull()))
    same(long.filled_linear(recording, "pupil", "f", 8), sm.filled_linear(recording, "pupil", "f"))
    same(long.covered(recording, ivs, "t_ms", parts=8), iv.covered(recording, ivs, "t_ms"))
    asks = ivs.select("recording_id", "event_id", F.col("start").alias("t_ms"))
    same(long.nearest_index(asks, recording, 8), iv.nearest_index(asks, recording).select("recording_id", "event_id", "t_ms", "i"))
    same(long.indexed(recording.drop("i"), "t_ms", parts=8), recording)
    assert long.steps(recording, parts=8).filter("step is null").count() == 3
    with pytest.raises(ValueError):
        long.steps(recording.withColumn("at", F.lit(1)))


def test_pieces_cover_an_interval_once(spark):
    for bits in (1, 3):
        cuts = spark.createDataFrame([(a, b) for a in range(0, 40) for b in range(a, 80, 3)], "a long, b long").select("a", "b", dyadic.pieces(F.col("a"), F.col("b"), 2, bits).alias("p"))
        for r in cuts.collect():
            covered = [c for x in r["p"] for c in range(x["block"] << bits * x["level"], (x["block"] + 1) << bits * x["level"])]
            assert sorted(covered) == list(range(r["a"], r["b"]))


def test_long_intervals(spark, recording):
    spans = [(1, 0, 0, 5000), (1, 1, 17, 18), (1, 2, 63, 4097), (2, 3, 0, 7), (2, 4, 3, 3), (9, 5, 0, 10)]
    ivs = spark.createDataFrame(spans, "recording_id long, event_id long, start long, end long")
    data = {(r["recording_id"], r["i"]): r["pupil"] for r in recording.collect()}
    want = {e: [v for i in range(a, b) if (v := data.get((r, i))) is not None] for r, e, a, b in spans}
    for r in dyadic.interval_sums(recording, ivs, ["pupil"]).collect():
        vs = want[r["event_id"]]
        assert r["pupil_n"] == len(vs) and (r["pupil_min"], r["pupil_max"]) == ((min(vs), max(vs)) if vs else (None, None))
        assert (r["pupil_mean"] is None) if not vs else abs(r["pupil_mean"] - sum(vs) / len(vs)) < 1e-9
    met = dyadic.samples_in(recording, ivs).groupBy("event_id").agg(F.count("*").alias("n")).collect()
    assert {r["event_id"]: r["n"] for r in met} == {0: 5000, 1: 1, 2: 4034, 3: 7}
    assert dyadic.interval_sums(recording, ivs.limit(0), ["pupil"]).count() == 0


def test_percentiles(spark):
    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [rng.choice([1.0, 2.0, 2.0]) for _ in range(500)], "c": [5.0], None: [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(300)] + [1.7e308, -1.7e308], "d": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None, float("nan")]]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in selection.percentiles(df, ["g"], "v", at, 16).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs)
        for q in at if vs else []:
            p = q * (len(vs) - 1)
            a, b = vs[int(p)], vs[-int(-p // 1)]
            want[g, q] = a + (b - a) * (p - int(p))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    with pytest.raises(ValueError):
        selection.percentiles(df, ["g"], "v", [50])


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_troughs(spark, block):
    rng = np.random.default_rng(10)
    waves = {1: np.round(np.cumsum(rng.normal(size=400)), 1), 2: np.repeat(rng.integers(0, 5, 60), 3).astype(float), 3: np.array([1.0]), 4: -np.arange(50.0) + 3 * (np.arange(50) % 2), 5: np.array([2.0, 1.0, 2.0])}
    rows = [(r, i, float(v)) for r, x in waves.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(5, 3, None)], "recording_id long, i long, v double")
    got = {(r["recording_id"], r["i"]): (r["value"], r["prominence"]) for r in extrema.troughs(df, "v", block, 8).collect()}
    want = {}
    for r, x in waves.items():
        for i, p in zip(*K.troughs(x), strict=True):
            want[r, int(i)] = (x[i], p)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

"""Regions, validation points and replayed steps, each against values worked out by hand."""

import math

import duckdb
import pytest

from saccadia.functions import geometry as geo
from saccadia.functions import rois
from saccadia.operators import calibration as cal
from saccadia.operators import samples as sm
from saccadia.operators.history import History
from saccadia.plans import catalog

SF = "/root/testdata/sf0.001"
SETUP = geo.Setup.of(1000, 500, 500, 250, 600)


def test_circle_and_rectangle():
    c = rois.Circle.from_mm((50, 25), "3 cm", SETUP)
    assert (c.cx, c.cy, c.radius) == (600, 200, 60)
    d = rois.Circle.from_degrees((0, "0 deg"), "2 deg", SETUP)
    assert math.isclose(d.radius, 600 * math.tan(math.radians(2)) * 2)
    r = rois.Rectangle.from_mm((-10, -10), (10, 10), SETUP)
    assert (r.x0, r.y0, r.x1, r.y1) == (480, 270, 520, 230)
    with pytest.raises(ValueError):
        rois.Circle(0, 0, -1)
    with pytest.raises(ValueError):
        rois.Circle.from_degrees((0, 0), 0.1, geo.Setup.of(10, 10, 10, 10))


def test_calibration(spark):
    v = spark.createDataFrame([("LEFT", 640.0, 512.0, 0.3, -13.3, -1.6), ("LEFT", 640.0, 87.0, 0.5, 13.2, -0.2), (None, 640.0, 936.0, 0.42, 16.1, 9.2)], "eye string, point_x double, point_y double, offset double, diff_x double, diff_y double")
    rows = {r["eye"]: r for r in cal.error_stats(cal.measured_points(v), "eye").collect()}
    assert rows["left"]["n"] == 2 and math.isclose(rows["left"]["sd"], 0.1) and rows["unknown"]["max"] == 0.42


def test_history(spark):
    df = spark.createDataFrame([(1, k, float(k), float(k), False) for k in range(8)], "recording_id long, i long, t_ms double, v double, v__m boolean")
    h = History().then(sm.sub_slice, 2, 7).then(sm.downsample, ["v"], by=3)
    assert h.describe() == ["sub_slice(2, 7)", "downsample(['v'], by=3)"]
    assert [r["v"] for r in h.apply(df).orderBy("i").collect()] == [3.0, 6.0]


@pytest.mark.parametrize("name", ["roi_from_angles", "calibration_points", "calibration_errors", "history_replay"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = ", ".join(got.columns)
    want = con.execute(f"SELECT {cols} FROM ({catalog.SQL[name]})").fetchall()
    key = lambda r: tuple(("" if v is None else str(v)) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)

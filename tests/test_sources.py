"""The tracker data source and bucketed bundles: rows, plans, pruning."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from saccadia.functions.geometry import Setup
from saccadia.operators import gaze as gz
from saccadia.operators import intervals as iv
from saccadia.operators import samples as sm
from saccadia.operators import views as vw
from saccadia.sources import recordings as rec
from saccadia.sources import tracker


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_tracker_files(spark, tmp_path, monkeypatch):
    lines = {"a": ["0\t1\t2\t3\t4\t5\t6", "2\t   .\t2\t0\t4\t5\t6", "note", "4\t7\t8", ""], "b": [f"{2 * i}\t{i}\t0\t0\t0\t0\t0" for i in range(1000)], "empty": []}
    (tmp_path / "deep").mkdir()
    for name, text in lines.items():
        (tmp_path / "deep" / f"{name}.tsv").write_text("\n".join(text))
    (tmp_path / "other.txt").write_text("1\t1\t1\t1\t1\t1\t1")
    top = f"file://{tmp_path}"
    df = tracker.read_tracker(spark, top)
    rows = [tuple(r) for r in df.filter("recording_id = 'a'").orderBy("i").collect()]
    assert rows == [("a", 0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("a", 1, 2.0, None, 2.0, 0.0, 4.0, 5.0, 6.0), ("a", 2, 4.0, 7.0, 8.0, None, None, None, None)]
    assert df.count() == 1003 and df.rdd.getNumPartitions() == 3
    some = tracker.read_tracker(spark, top, ["b", "none"], 10, 20)
    assert [(r["i"], r["left_x"]) for r in some.orderBy("i").collect()] == [(k, float(k)) for k in range(5, 10)] and some.rdd.getNumPartitions() == 1
    assert tracker.read_tracker(spark, top, ["none"]).count() == 0
    few = tracker.read_tracker(spark, f"{top}/deep/a.tsv", columns=["t_ms", "right_x"])
    assert few.columns == ["t_ms", "right_x"] and sorted(map(tuple, few.collect())) == [(0.0, 4.0), (2.0, 4.0), (4.0, None)]
    with pytest.raises(Exception, match="unknown columns"):
        tracker.read_tracker(spark, top, columns=["t_ms", "nose"]).count()
    # a reader's batches and chunks join up
    monkeypatch.setattr(tracker, "BATCH", 7)
    r = tracker.TrackerReader({"path": f"file://{tmp_path}"}, df.schema)
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 1003


def test_bundles_in_buckets_need_no_shuffle_or_sort(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 20).alias("recording_id"), F.floor(F.col("id") / 20).alias("i"), F.rand(1).alias("v"))
    rec.write_bundle(str(tmp_path), 4, samples=df, plain=df.select("v"))
    back = rec.read_bundle(spark, str(tmp_path), "samples")
    assert back.dtypes == df.dtypes and back.exceptAll(df).isEmpty() and back.count() == 4000
    assert len(list((tmp_path / "samples").glob("*.parquet"))) == 4
    w = Window.partitionBy("recording_id").orderBy("i")
    text = plan(back.withColumn("d", F.col("v") - F.lag("v").over(w)))
    assert "Exchange" not in text and "Sort " not in text and "Window" in text
    text = plan(back.join(rec.read_bundle(spark, str(tmp_path), "samples").withColumnRenamed("v", "u").hint("merge"), "recording_id"))
    assert "Exchange" not in text
    # one recording is one bucket's file
    assert back.filter("recording_id = 7").select("_metadata.file_path").distinct().count() == 1
    assert rec.read_bundle(spark, str(tmp_path), "plain").count() == 4000
    # written again, with other buckets
    rec.write_bundle(str(tmp_path), 2, samples=df.limit(10))
    assert rec.read_bundle(spark, str(tmp_path), "samples").count() == 10


def test_slices_take_events_and_intervals_along(spark):
    df = spark.createDataFrame([(r, i, i * 10.0, 1.0) for r in (1, 2) for i in range(10 if r == 1 else 2)], "recording_id long, i long, t_ms double, pupil double")
    events = spark.createDataFrame([(1, 0, "a", 25.0), (1, 1, "b", 30.0), (1, 2, "c", 80.5), (2, 3, "d", 40.0)], "recording_id long, event_id long, label string, t_ms double")
    store = spark.createDataFrame([(1, "blinks", "left", "pupil", 0.0, 4.0), (1, "blinks", "left", "pupil", 5.0, 6.0), (1, "blinks", "left", "pupil", 8.0, 10.0), (2, "blinks", "left", "pupil", 0.0, 1.0)], "recording_id long, kind string, eye string, variable string, start double, end double")
    s, e, b = sm.slice_with(df, events, store, 30, 80)
    assert [r["i"] for r in s.orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]
    assert [r["label"] for r in e.collect()] == ["b"]
    assert sorted((r["start"], r["end"]) for r in b.collect()) == [(0.0, 1.0), (2.0, 3.0), (5.0, 6.0)]
    assert sm.slice_with(df, events, None, 0, 1)[2] is None


def test_foreshortening_correction(spark):
    setup = Setup.of(100, 50, 200, 100, 500)
    df = spark.createDataFrame([(1, 0, 50.0, 25.0, 2.0, False), (1, 1, 60.0, 25.0, 2.0, True), (1, 2, None, 25.0, 2.0, False)], "recording_id long, i long, left_x double, left_y double, left_pupil double, left_pupil__m boolean")
    got = [(r["left_size"], r["left_size__m"]) for r in gz.correct_foreshortening(df, setup, store_as="size").orderBy("i").collect()]
    assert got[0] == (2.0, False) and got[1] == (pytest.approx(2 * (1 + (20 / setup.d) ** 2) ** 0.5), True) and got[2] == (None, True)
    with pytest.raises(ValueError):
        gz.correct_foreshortening(df, setup, ("right",))


def test_pyramid_equals_the_levels(spark):
    rows = [(r, i, float(i), None if i % 11 < 3 and r == 2 else float((i * 7919) % 101), i % 5 == 0) for r, n in ((1, 7), (2, 1234)) for i in range(n)]
    df = spark.createDataFrame(rows, "recording_id long, i long, t_ms double, v double, v__m boolean")
    got = sorted(map(str, (tuple(r) for r in vw.pyramid(df, "v", (3, 12, 120)).collect())))
    want = vw.levels(df, "v", (3, 12, 120)).select("recording_id", "factor", "chunk", "pos", "t_ms", F.when(~F.col("masked"), F.col("value")), F.when(F.col("masked"), F.col("value")))
    assert got == sorted(map(str, (tuple(r) for r in want.collect())))
    with pytest.raises(ValueError):
        vw.pyramid(df, "v", (10, 25))


def test_subtotals(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, None)], "x string, y long, v double")
    got = {(r["grouping"], r["x"], r["y"]): (r["n"], r["mean"]) for r in iv.subtotals(df, ["x", "y"], "v").collect()}
    assert got == {(0, "a", 1): (1, 2.0), (0, "a", 2): (1, 4.0), (0, "b", 1): (0, None), (1, "a", None): (2, 3.0), (1, "b", None): (0, None), (3, None, None): (2, 3.0)}
    assert iv.subtotals(df, ["x", "y"], "v", cross=True).filter("grouping = 2").count() == 2

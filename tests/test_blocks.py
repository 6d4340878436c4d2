"""Scans over groups that lie in several parts, against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from saccadia.operators.blocks import in_order, pieces, scan

COLUMNS = {"lag": "lag", "lead": "lead", "last": "last", "first": "first", "next": "next", "sum": "sum", "max": "max", "max_before": "max_before"}


def test_scans_equal_windows_over_the_whole_group(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, None, i % 7, -i])) for g, n in ((1, 4000), (2, 3), (None, 50), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    ordered = in_order(df, ["g", "i"], 8)
    sizes = [r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    assert pieces(ordered, ["g"]).count() < 16
    v = F.col("v")
    got = scan(ordered, ["g"], **{k: (kind, v) for k, kind in COLUMNS.items()})
    w = Window.partitionBy("g").orderBy("i")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.withColumns({"lag": F.lag(v).over(w), "lead": F.lead(v).over(w), "last": F.last(v, True).over(up), "first": F.first(v).over(w), "next": F.first(v, True).over(down), "sum": F.sum(v).over(up), "max": F.max(v).over(up), "max_before": F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    assert sorted(map(str, got.drop("at", "part").collect())) == sorted(map(str, want.collect()))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g long, i long, v long")
    assert scan(in_order(df, ["g", "i"]), ["g"], s=("sum", F.col("v"))).collect() == []

"""Streams with state against the same rows as a table."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.streaming import stateful

SCHEMA = "recording_id long, ts timestamp, i long, pupil double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def feed(spark, tmp_path, batches, run):
    """Runs a stream over files, one a trigger, and gives what it wrote."""
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        text = "\n".join(json.dumps({"recording_id": r, "ts": t.isoformat(), "i": i, "pupil": v}) for r, t, i, v in rows)
        (tmp_path / "in" / f"{k:03}.json").write_text(text)
        import os

        os.utime(tmp_path / "in" / f"{k:03}.json", (k + 1, k + 1))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = run(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(n, rng):
    return [(r, T0 + dt.timedelta(milliseconds=100 * i), i, None if rng.random() < 0.1 else rng.gauss(5, 1)) for i in range(n) for r in (1, 2)]


def test_causal_lowpass_over_late_rows(spark, tmp_path, rocks):
    rng = random.Random(1)
    rows = rows_of(60, rng)
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 15))  # up to 1.5 s late
    end = [(r, T0 + dt.timedelta(seconds=100), 999, 0.0) for r in (1, 2)]
    batches = [shuffled[:40], shuffled[40:90], shuffled[90:], end, [(1, T0 + dt.timedelta(seconds=200), 1000, 0.0)]]
    got = {(r["recording_id"], r["i"]): r["filtered"] for r in feed(spark, tmp_path, batches, lambda s: stateful.causal_lowpass(s, "pupil", 1.0, 10.0, 2, "2 seconds")).filter("i < 999").collect()}
    b, a = (np.asarray(x, float) for x in K.butterworth(2, 1.0, 10.0))
    for rec in (1, 2):
        z = np.zeros(len(b) - 1)
        for r, _, i, v in sorted(rows, key=lambda r: r[2]):
            if r != rec:
                continue
            if v is None:
                assert got[rec, i] is None
                continue
            y = b[0] * v + z[0]
            z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * y
            assert got[rec, i] == pytest.approx(y)
    assert len(got) == len(rows)


def test_repeats_and_sliding_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = rows_of(50, rng)
    twice = [r for r in rows for _ in range(1 + (rng.random() < 0.3))]
    end = [(r, T0 + dt.timedelta(seconds=300), 999, 0.0) for r in (1, 2)]
    (tmp_path / "a").mkdir()
    got = feed(spark, tmp_path / "a", [twice[:60], twice[60:], twice[50:70]], lambda s: stateful.deduplicated(s, ["recording_id", "i"], "20 seconds"))
    key = lambda r: (r["recording_id"], r["i"], r["pupil"])
    assert sorted(map(str, map(key, got.collect()))) == sorted(str((r, i, v)) for r, _, i, v in rows)
    (tmp_path / "b").mkdir()
    late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 15))
    means = lambda df: stateful.sliding_means(df, "pupil", "1 second", "250 milliseconds", "2 seconds")
    got = feed(spark, tmp_path / "b", [late[:50], late[50:], end, [(1, T0 + dt.timedelta(seconds=900), 1000, 0.0)]], means).filter(F.col("start") < F.lit(T0 + dt.timedelta(seconds=30)))
    want = means(spark.createDataFrame(rows, SCHEMA))
    show = lambda df: sorted((r["recording_id"], r["start"], round(r["mean"] or 0, 9), r["n"]) for r in df.collect())
    assert show(got) == show(want)

"""Clashing names, repeated rows and reruns; how many pairs of a given similarity meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.llm import linededup, mixing, simhash


def test_line_dedup_with_clashing_columns(spark):
    text = "one shared line of text\nown line number {}"
    df = spark.createDataFrame([(i, text.format(i)) for i in range(3)], "doc_id long, text string")
    want = {0: text.format(0), 1: "own line number 1", 2: "own line number 2"}
    for names in (("_id", "_row", "_gone"), ("line_id", "line_row", "line_gone")):
        got = linededup.drop_repeated_lines(df.withColumns({n: F.lit(k) for k, n in enumerate(names)}))
        assert got.columns == ["doc_id", "text", *names] and {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_near_unique_keeps_a_defined_row(spark):
    rows = [(1, "a text of several words here", s) for s in ("c", None, "b", "c")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        assert [r["source"] for r in simhash.near_unique(df).collect()] == [None]


def test_mixing_reruns_agree_whatever_the_layout(spark):
    rows = [(i % 20, " ".join(["word"] * (i % 7 * 30 + 5)), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(str, mixing.repeat_documents(df.repartition(n)).collect())) for n in (1, 5))
    assert once == again
    assert mixing.mixed(df).count() == 200


@pytest.mark.parametrize("bits", [16, 22, 25, 32])
def test_pairs_meet_at_any_length_of_segments(spark, bits):
    """Of pairs of each similarity, counted one by one, 0.95 agree in a segment but for one bit and pass the two bounds."""
    rng = np.random.default_rng(bits)
    salts = (np.arange(simhash.WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]

    def bits_of(h):
        z = h[None, :] + salts
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return simhash.majority(z ^ (z >> np.uint64(31)))

    rows = []
    for step, j in enumerate((0.8, 0.83, 0.86, 0.9)):
        n = 180
        for k in range(250):
            own = round(n * (1 - j) / (1 + j))
            h = rng.integers(0, 1 << 63, n + own, dtype=np.uint64)
            a, b = bits_of(h[:n]), bits_of(h[own:])
            near = np.bitwise_count((a[-1] ^ b[-1]) & np.uint64(0xFFFFFFFF)) <= simhash.NODE_FAR
            rows.append((step, a[:-1].view(np.int64).tolist(), b[:-1].view(np.int64).tolist(), bool(near)))
    df = spark.createDataFrame(rows, "step int, a array<long>, b array<long>, near boolean")
    a, b = F.col("a"), F.col("b")
    met = F.arrays_overlap(simhash._keys(a, bits), simhash._keys(b, bits))
    got = df.withColumn("ok", met & F.col("near") & simhash._prints_close(a, b)).groupBy("step").agg(F.avg(F.col("ok").cast("int")).alias("r")).collect()
    assert len(got) == 4 and min(r["r"] for r in got) >= 0.95, sorted(map(tuple, got))

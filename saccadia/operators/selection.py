"""Exact percentiles of groups of any size, by refined histograms.

A wanted place in a group's sorted values is known to lie between two of its values. Each
round counts the values between them in bins, with each bin's smallest and largest value, and
goes on with the one bin that holds the place. It ends where a bin's values are all equal, so
the answer is a value of the group, not an estimate. No task holds a group's values: what is
shuffled is a row for each bin that isn't empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.tables import released, written

BINS = 1024


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float], bins: int = BINS) -> DataFrame:
    """by, q, value: percentiles (q from 0 to 1) of each group's values, between neighbours by a line.

    Nulls and NaN don't count; a group without values has no row. Rounds grow with the
    logarithm of a group's size, or, where its values lie many orders of magnitude apart,
    with the number of these.
    """
    if not at or any(not 0 <= q <= 1 for q in at):
        raise ValueError("percentiles are from 0 to 1")
    clash = {"q", "want", "lo", "hi", "before", "bin"} & set(by)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.col("q") * (F.col("n") - 1)
    wanted = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("place", place)
    ends = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    state = wanted.select(*by, "q", "place", F.explode(ends).alias("want"), "lo", "hi", F.lit(0).cast("long").alias("before"))
    state = written(state, "places")
    key = [*by, "q", "want"]
    while not (unsettled := state.filter("lo < hi")).isEmpty():
        # the largest of the bin numbers is the interval's end alone
        near = rows.join(unsettled.withColumnsRenamed({k: f"{k}_" for k in by}), _same(by)).drop(*[f"{k}_" for k in by]).filter("v >= lo and v <= hi")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = near.withColumn("bin", F.when(F.col("v") >= F.col("hi"), bins).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))).groupBy(*key, "place", "before", "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*key).orderBy("bin"))
        found = counted.withColumn("upto", upto).filter((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("c") <= F.col("want")))
        following = found.select(*by, "q", "place", "want", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("upto") - F.col("c")).alias("before"))
        state, last = written(state.filter("lo = hi").unionByName(following), "places"), state
        released(last)
    low, high = F.min_by("lo", "want"), F.max_by("lo", "want")
    return state.groupBy(*by, "q", "place").agg(low.alias("low"), high.alias("high")).select(*by, "q", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"))


def _same(by: list[str]):
    out = F.lit(True)
    for k in by:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return out

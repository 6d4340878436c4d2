"""Intervals of any length met with samples by equality joins.

An interval of n cells is cut into whole blocks of 1, r, r², ... cells, each aligned to its
size: at most 2 (r - 1) log_r(n) rows, whatever the length. A sample lies in one block of each
level, so (level, block) is a plain join key. Statistics that add up don't even meet the
samples: blocks are summed once, level from level, and an interval takes the sums of its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of r, the blocks of one level in a block of the next.
BITS = 3


def _cells(lo: Column, hi: Column) -> Column:
    """lo, ..., hi - 1 as an array; empty where there is none."""
    return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def pieces(start: Column, end: Column, levels: int, bits: int = BITS) -> Column:
    """Array of (level, block) structs that cover the whole cells [start, end) once; `levels` beyond the first."""
    out = []
    up = lambda x, k: F.shiftright(x + ((1 << bits * k) - 1), bits * k)
    for level in range(levels + 1):
        s, e = up(start, level), F.shiftright(end, bits * level)
        if level == levels:
            blocks = _cells(s, e)
        else:
            s2, e2 = up(start, level + 1), F.shiftright(end, bits * (level + 1))
            inner = F.when(s2 <= e2, F.concat(_cells(s, F.shiftleft(s2, bits)), _cells(F.shiftleft(e2, bits), e)))
            blocks = F.when(s < e, F.coalesce(inner, _cells(s, e))).otherwise(F.array().cast("array<bigint>"))
        out.append(_named(blocks, level))
    return F.concat(*out)


def _named(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def depth(iv: DataFrame, bits: int = BITS) -> int:
    """Levels that the longest interval needs."""
    longest = iv.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    return max(0, (int(longest) - 1).bit_length() // bits)


def _cut(iv: DataFrame, levels: int, bits: int) -> DataFrame:
    p = pieces(F.col("start").cast("long"), F.col("end").cast("long"), levels, bits)
    return iv.withColumn("_p", F.explode(p)).withColumns({"_level": F.col("_p.level"), "_block": F.col("_p.block")}).drop("_p")


def samples_in(samples: DataFrame, iv: DataFrame, at: str = "i", bits: int = BITS) -> DataFrame:
    """samples joined to the intervals [start, end) of whole numbers that hold them, for any statistic."""
    levels = depth(iv, bits)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    s = samples.withColumn("_level", level).withColumn("_block", F.expr(f"shiftright(cast(`{at}` as bigint), {bits} * _level)"))
    return s.join(_cut(iv, levels, bits), ["recording_id", "_level", "_block"]).drop("_level", "_block")


def interval_sums(samples: DataFrame, iv: DataFrame, signals: list[str], at: str = "i", bits: int = BITS) -> DataFrame:
    """recording_id, event_id and of each signal its n, sum, mean, min and max over [start, end); nulls don't count.

    Work is one pass over the samples, a shrinking one over the blocks of each level, and a
    row for each block of an interval, however many samples lie in it. An interval without
    a sample has n 0.
    """
    levels = depth(iv, bits)

    def summed(df, block, first):
        parts = []
        for s in signals:
            n, total, low, high = (F.col(s),) * 4 if first else (F.col(f"{s}_{x}") for x in ("n", "sum", "min", "max"))
            parts += [(F.count(n) if first else F.sum(n)).alias(f"{s}_n"), F.sum(total).alias(f"{s}_sum"), F.min(low).alias(f"{s}_min"), F.max(high).alias(f"{s}_max")]
        return df.groupBy("recording_id", block.alias("_block")).agg(*parts)

    level = summed(samples, F.col(at).cast("long"), True)
    tables = [level.withColumn("_level", F.lit(0))]
    for k in range(1, levels + 1):
        level = summed(level, F.shiftright("_block", bits), False)
        tables.append(level.withColumn("_level", F.lit(k)))
    blocks = reduce(DataFrame.unionByName, tables)
    cut = _cut(iv.select("recording_id", "event_id", "start", "end"), levels, bits).drop("start", "end")
    met = cut.join(blocks, ["recording_id", "_level", "_block"])
    out = []
    for s in signals:
        n, total = F.sum(f"{s}_n"), F.sum(f"{s}_sum")
        out += [n.alias(f"{s}_n"), total.alias(f"{s}_sum"), F.when(n > 0, total / n).alias(f"{s}_mean"), F.min(f"{s}_min").alias(f"{s}_min"), F.max(f"{s}_max").alias(f"{s}_max")]
    found = met.groupBy("recording_id", "event_id").agg(*out)
    return iv.select("recording_id", "event_id").join(found, ["recording_id", "event_id"], "left").fillna(0, [f"{s}_n" for s in signals])

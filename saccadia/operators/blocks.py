"""Scans over ordered groups that are longer than a task.

`in_order` range-partitions rows by their keys, sorts, numbers and writes them, so a group
may lie in several parts, none longer than a partition. A window over (part, group) sees one
such piece. What a piece needs from the pieces before or after it (a carry) is one row a
piece, and only groups that cross a part's edge need one: fewer rows than there are parts,
which is why they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.tables import written

#: monotonically_increasing_id has the partition above these bits.
PART_BITS = 33


def in_order(df: DataFrame, keys: list[str], parts: int | None = None, name: str = "ordered") -> DataFrame:
    """df with `at` (long, ascending by the keys over the whole table) and `part`; nulls come first.

    Written once, as range bounds may differ when they are drawn again. Rows equal in all
    keys are in no given order.
    """
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = dealt.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    table = written(rows, name)
    out = table.withColumn("part", F.shiftright("at", PART_BITS))
    out.scratch_path = table.scratch_path
    return out


def piece(group: list[str]):
    """Window over one piece of a group, in order."""
    return Window.partitionBy("part", *group).orderBy("at")


def pieces(rows: DataFrame, group: list[str], **aggs: Column) -> DataFrame:
    """A row for each piece of the groups that have several: fewer than twice the number of parts."""
    w = Window.partitionBy(*group)
    found = rows.groupBy("part", *group).agg(F.lit(1).alias("one"), *[a.alias(k) for k, a in aggs.items()])
    return found.withColumn("n_pieces", F.count("*").over(w)).filter("n_pieces > 1").drop("one", "n_pieces")


#: kind: (value within the piece, one value a piece, that of the pieces before or after, both together)
def _lag(v, w):
    return F.lag(F.struct(v.alias("v"))).over(w), F.max_by(F.struct(v.alias("v")), "at"), -1, lambda here, carry: F.coalesce(here, carry)["v"]


def _lead(v, w):
    return F.lead(F.struct(v.alias("v"))).over(w), F.min_by(F.struct(v.alias("v")), "at"), 1, lambda here, carry: F.coalesce(here, carry)["v"]


def _last(v, w):
    here = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return here, F.max_by(v, F.when(v.isNotNull(), F.col("at"))), -1, F.coalesce


def _first(v, w):
    return F.first(F.struct(v.alias("v"))).over(w), F.min_by(F.struct(v.alias("v")), "at"), -1, lambda here, carry: F.coalesce(carry, here)["v"]


def _next(v, w):
    here = F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return here, F.min_by(v, F.when(v.isNotNull(), F.col("at"))), 1, F.coalesce


def _sum(v, w):
    here = F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return here, F.sum(v), -1, lambda here, carry: F.when(here.isNull(), carry).otherwise(here + F.coalesce(carry, F.lit(0)))


def _max(v, w):
    here = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return here, F.max(v), -1, F.greatest


def _max_before(v, w):
    here = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return here, F.max(v), -1, F.greatest


_KINDS = {"max_before": _max_before, "lag": _lag, "lead": _lead, "last": _last, "first": _first, "next": _next, "sum": _sum, "max": _max}


def scan(rows: DataFrame, group: list[str], **columns: tuple[str, Column]) -> DataFrame:
    """rows of `in_order` with running columns: name=(kind, value), in the order of the group's rows.

    lag, lead: the value one row before or after; last, next: the last value at or before,
    the next at or after, nulls passed over; first: the value of the group's first row; sum,
    max: of all rows up to this one, max_before: of those before it, nulls passed over. No task holds more of a group than one part has.
    """
    w, before, after = piece(group), {}, {}
    spec = {k: _KINDS[kind](v, w) for k, (kind, v) in columns.items()}
    for k, (_, one, side, _) in spec.items():
        (before if side < 0 else after)[k] = one
    by_part = Window.partitionBy(*group).orderBy("part")
    back, ahead = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    found = pieces(rows, group, **before, **after)
    carry = {}
    for k, (kind, _) in columns.items():
        over = {"sum": F.sum(k), "max": F.max(k), "max_before": F.max(k), "first": F.first(k, True)}.get(kind)
        if over is None:
            over = F.last(k, True) if k in before else F.first(k, True)
        carry[f"{k}_carry"] = over.over(back if k in before else ahead)
    keys = ["part", *group]
    carries = found.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[c.alias(k) for k, c in carry.items()])
    here = rows.withColumns({f"{k}_here": s[0] for k, s in spec.items()})
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"{k}_of"))
        same = eq if same is None else same & eq
    out = here.join(F.broadcast(carries), same, "left")
    done = {k: s[3](F.col(f"{k}_here"), F.col(f"{k}_carry")) for k, s in spec.items()}
    return out.select(*rows.columns, *[c.alias(k) for k, c in done.items()])

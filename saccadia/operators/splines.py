"""B-splines over recordings of any length: bases, fits and objectives as sums by knot cell.

Knots are evenly spaced between a recording's first and last time, with repeated ends, so
the knots around a sample follow from its cell and nothing is searched. Between two knots
only four cubic bases aren't zero: the Cox-de Boor recursion is a few column expressions.
Normal equations are fourteen sums a cell, which Spark takes over all samples; what is solved
in a task is one recording's cells, and coefficients come back to samples by (recording, cell).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.functions.geometry import cos_alpha
from saccadia.functions.tables import released, written
from saccadia.operators.models import many_groups

DEGREE = 3


def evenly(df: DataFrame, time: str = "t_ms", knots_per_second: float | None = 1.0, inner: int | None = None) -> DataFrame:
    """recording_id, lo, hi, inner: the ends and the number of knots between them, by a rate (two at least) or given."""
    ends = df.groupBy("recording_id").agg(F.min(time).cast("double").alias("lo"), F.max(time).cast("double").alias("hi"))
    n = F.lit(inner) if inner is not None else F.greatest(F.ceil((F.col("hi") - F.col("lo")) / 1000 * knots_per_second), F.lit(2))
    # a recording of one moment has knots one unit apart
    return ends.withColumns({"inner": n.cast("int"), "hi": F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1)})


def _knot(j: Column) -> Column:
    step = (F.col("hi") - F.col("lo")) / (F.col("inner") + 1)
    return F.col("lo") + step * F.greatest(F.lit(0), F.least(F.col("inner") + 1, j - DEGREE))


def _local(t: Column) -> tuple[Column, list[Column]]:
    """Cell of a time, and the values there of bases cell .. cell + 3."""
    cell = F.greatest(F.lit(0), F.least(F.col("inner"), F.floor((t - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("inner") + 1)).cast("int")))
    j = cell + DEGREE
    v = [F.lit(1.0)]
    for k in range(1, DEGREE + 1):
        carry, nxt = F.lit(0.0), []
        for r in range(k):
            low, high = _knot(j + r + 1 - k), _knot(j + r + 1)
            w = v[r] / (high - low)
            nxt.append(carry + (high - t) * w)
            carry = (t - low) * w
        v = [*nxt, carry]
    return cell, v


def placed(df: DataFrame, knots: DataFrame, time: str = "t_ms") -> DataFrame:
    """df with cell and b0 .. b3: a sample's knot cell and the four bases that aren't zero there."""
    cell, v = _local(F.col(time).cast("double"))
    return df.join(knots, "recording_id").withColumns({"cell": cell, **{f"b{m}": x for m, x in enumerate(v)}}).drop("lo", "hi", "inner")


def basis(df: DataFrame, knots: DataFrame, time: str = "t_ms") -> DataFrame:
    """recording_id, i, basis, value: every basis that isn't zero at a sample, in long form."""
    each = F.array(*[F.struct((F.col("cell") + m).alias("basis"), F.col(f"b{m}").alias("value")) for m in range(DEGREE + 1)])
    rows = placed(df.select("recording_id", "i", time), knots, time).select("recording_id", "i", F.explode(each).alias("x"))
    return rows.select("recording_id", "i", "x.basis", "x.value").filter("value <> 0")


def by_cell(coef: DataFrame) -> DataFrame:
    """recording_id, cell, c0 .. c3 of coefficients (recording_id, basis, a): those that count in each cell."""
    w = Window.partitionBy("recording_id").orderBy("basis")
    rows = coef.select("recording_id", F.col("basis").cast("int").alias("cell"), *[F.lead("a", m).over(w).alias(f"c{m}") if m else F.col("a").alias("c0") for m in range(DEGREE + 1)])
    return rows.filter(F.col(f"c{DEGREE}").isNotNull())


def values(at: DataFrame, coef: DataFrame, out: str = "value") -> DataFrame:
    """placed() rows with the spline's value."""
    total = reduce(lambda x, y: x + y, [F.col(f"b{m}") * F.col(f"c{m}") for m in range(DEGREE + 1)])
    return at.join(by_cell(coef), ["recording_id", "cell"], "left").withColumn(out, total).drop(*[f"c{m}" for m in range(DEGREE + 1)])


def objective(df: DataFrame, coef: DataFrame, knots: DataFrame, theta: float, phi: float, r: float, d: float, smooth: float = 1.0, eye_offset: float = 0.0) -> DataFrame:
    """recording_id, n, data_loss, smooth_loss, loss, rmse, r2 of a size spline and camera angles.

    df has t_ms, x, y (mm) and pupil; rows that miss one don't count. data_loss: squares of
    pupil - size * cos(alpha); smooth_loss: `smooth` times the squares of the coefficients'
    steps; r2 against the mean pupil.
    """
    seen = df.filter("x is not null and y is not null and pupil is not null").select("recording_id", "t_ms", "x", "y", "pupil")
    sized = values(placed(seen, knots), coef, "size")
    e = F.col("pupil") - F.col("size") * cos_alpha(F.col("x"), F.col("y"), theta, phi, r, d, eye_offset)
    fit = sized.withColumn("_e", e).groupBy("recording_id").agg(F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("data_loss"), F.var_pop("pupil").alias("_v"))
    step = F.lead("a").over(Window.partitionBy("recording_id").orderBy("basis")) - F.col("a")
    rough = coef.withColumn("_s", step).groupBy("recording_id").agg((smooth * F.coalesce(F.sum(F.col("_s") * F.col("_s")), F.lit(0.0))).alias("smooth_loss"))
    total = F.greatest(F.col("_v") * F.col("n"), F.lit(1e-12))
    return fit.join(rough, "recording_id").select("recording_id", "n", "data_loss", "smooth_loss", (F.col("data_loss") + F.col("smooth_loss")).alias("loss"), F.sqrt(F.col("data_loss") / F.col("n")).alias("rmse"), (1 - F.col("data_loss") / total).alias("r2"))


def normal_sums(at: DataFrame, y: Column, weight: Column) -> DataFrame:
    """recording_id, cell and the weighted sums of a cell's normal equations: m_00 .. m_33 and r_0 .. r_3."""
    b = [F.col(f"b{m}") for m in range(DEGREE + 1)]
    pairs = [(p, q) for p in range(DEGREE + 1) for q in range(p, DEGREE + 1)]
    return at.groupBy("recording_id", "cell").agg(*[F.sum(b[p] * b[q] * weight).alias(f"m_{p}{q}") for p, q in pairs], *[F.sum(b[p] * y * weight).alias(f"r_{p}") for p in range(DEGREE + 1)])


def solved(sums: DataFrame, knots: DataFrame, ridge: float = 1e-9, smooth: float = 0.0) -> DataFrame:
    """Coefficients (recording_id, basis, a) from normal_sums: one banded system a recording, of as many rows as it has cells; many at once.

    `ridge` is added to the diagonal; `smooth` weighs the squares of the coefficients' steps.
    """
    def fn(p: dict, starts: np.ndarray):
        sizes = p["inner"][starts].astype(int) + DEGREE + 1
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p["cell"]))))
        done = [np.zeros(0)] * len(starts)
        for n in np.unique(sizes):
            of = np.flatnonzero(sizes == n)
            rows = sizes[which] == n
            at, cell = np.searchsorted(of, which[rows]), p["cell"][rows].astype(int)
            band, rhs = np.zeros((len(of), DEGREE + 1, n)), np.zeros((len(of), n))
            for a in range(DEGREE + 1):
                np.add.at(rhs, (at, cell + a), p[f"r_{a}"][rows])
                for b in range(a, DEGREE + 1):
                    np.add.at(band, (at, b - a, cell + a), p[f"m_{a}{b}"][rows])
            band[:, 0] += ridge + smooth * np.concatenate(([1.0], np.full(n - 2, 2.0), [1.0]))
            band[:, 1, :-1] -= smooth
            for k, x in zip(of, K.banded_solve_many(band, rhs), strict=True):
                done[k] = x
        return sizes, {"basis": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), "a": np.concatenate(done)}

    return many_groups(sums.join(knots.select("recording_id", "inner"), "recording_id"), ["recording_id"], fn, "basis int, a double")


def fitted(df: DataFrame, signal: str, knots: DataFrame, time: str = "t_ms", smooth: float = 0.0) -> DataFrame:
    """Least-squares coefficients (recording_id, basis, a) of a signal; missing samples don't count."""
    at = placed(df.filter(F.col(signal).isNotNull()).select("recording_id", time, signal), knots, time)
    return solved(normal_sums(at, F.col(signal).cast("double"), F.lit(1.0)), knots, smooth=smooth)


def asymmetric_baseline(df: DataFrame, signal: str, knots: int = 6, share: float = 0.05, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """recording_id, i, baseline: a spline below about 1 - `share` of the signal, on evenly spaced knots.

    The most probable spline of an asymmetric-Laplace residual with N(0, 5) coefficients, by
    reweighted least squares: each round is one aggregation over all samples and one small
    solve a recording. It ends after `rounds`, or when no coefficient moves by more than
    `tolerance` of the signal's deviation. A recording without a value has a null baseline.
    """
    v = F.col(signal).cast("double")
    moments = df.groupBy("recording_id").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    ends = evenly(df, "i", inner=knots - 2)
    at = written(placed(df.select("recording_id", "i", v.alias("v")).join(moments, "recording_id"), ends, "i").withColumn("z", (F.col("v") - F.col("mean")) / F.col("sd")), "placed")
    coef = None
    for _ in range(rounds):
        now = at.withColumn("base", F.lit(0.0)) if coef is None else values(at, coef, "base")
        r = F.col("z") - F.col("base")
        weight = F.when(r > 0, share).otherwise(1 - share) / F.greatest(F.abs(r), F.lit(1e-3))
        new = written(solved(normal_sums(now.filter("z is not null"), F.col("z"), weight), ends, ridge=1 / 25), "coefficients")
        moved = None if coef is None else new.join(coef.withColumnRenamed("a", "was"), ["recording_id", "basis"]).agg(F.max(F.abs(F.col("a") - F.col("was")))).first()[0]
        if coef is not None:
            released(coef)
        coef = new
        if moved is not None and moved <= tolerance:
            break
    return values(at, coef, "base").select("recording_id", "i", F.when(F.col("mean").isNotNull(), F.col("base") * F.col("sd") + F.col("mean")).alias("baseline"))

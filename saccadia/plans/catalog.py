"""Queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saccadia.functions import densities as dn
from saccadia.functions import geometry as geo
from saccadia.functions import kernels as K
from saccadia.functions import rois, units
from saccadia.functions.tables import written
from saccadia.operators import blinks as bl
from saccadia.operators import calibration as cal
from saccadia.operators import columns as co
from saccadia.operators import envelopes
from saccadia.operators import epochs as ep
from saccadia.operators import events as es
from saccadia.operators import gaze as gz
from saccadia.operators import intervals as iv
from saccadia.operators import models as md
from saccadia.operators.history import History
from saccadia.operators import samples as sm
from saccadia.operators import splines
from saccadia.operators import stores as st
from saccadia.operators import views as vw
from saccadia.sources import generators as gen
from saccadia.sources.recordings import gaze_table, is_url_column, pupil_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_P = """
p AS (SELECT user_id AS recording_id, event_id, event_type AS label,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0 AS t_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN value >= 10 THEN value END AS pupil FROM events)"""
_G = """
g AS (SELECT l_suppkey AS recording_id, l_quantity AS left_x, l_extendedprice / 2100 AS left_y, l_quantity + l_discount * 10 AS right_x,
  l_extendedprice / 2100 + l_tax * 10 AS right_y, l_extendedprice AS pupil, l_quantity > 48 AS left_x__m, l_quantity + l_discount * 10 > 50 AS right_x__m, l_extendedprice / 2100 > 45 AS left_y__m, l_extendedprice / 2100 + l_tax * 10 > 45 AS right_y__m,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i FROM lineitem)"""
_EV = """
ev AS (SELECT recording_id, event_id, label, t_ms FROM p WHERE label = 'click'),
iv AS (SELECT recording_id, event_id, label, t_ms AS onset, t_ms - 43200000.0 AS s, t_ms + 43200000.0 AS e FROM ev)"""
_MERGED = """
ordered AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
grouped AS (SELECT *, sum(CASE WHEN s > reach + {d} OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM ordered)"""
_RUNS = """
hit AS (SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS island FROM p WHERE {flag}),
runs AS (SELECT recording_id, min(i) AS s, max(i) + 1 AS e FROM hit GROUP BY recording_id, island)"""
HALF_DAY = 43_200_000.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _clicks(p: DataFrame) -> DataFrame:
    return p.filter("label = 'click'").select("recording_id", "event_id", "label", "t_ms")


def _around(spark, sf) -> DataFrame:
    return iv.around_events(_clicks(pupil_table(spark, sf)), -HALF_DAY, HALF_DAY)


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("recording_id", r6("start", "start_ms"), r6("end", "end_ms"), *more)


# --- samples


@query(f"WITH {_P} SELECT recording_id, i, round(t_ms, 6) AS t_ms, pupil, pupil IS NULL AS masked FROM p")
def ingest_mask(spark: SparkSession, sf: str) -> DataFrame:
    return pupil_table(spark, sf).select("recording_id", "i", r6("t_ms", "t_ms"), "pupil", F.col("pupil__m").alias("masked"))


@query(f"WITH {_P}, k AS (SELECT *, t_ms / 3600000.0 AS h FROM p) SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY i) - 1 AS i, round(h, 6) AS t_h, pupil FROM k WHERE h >= 100 AND h <= 400")
def sub_slice(spark, sf):
    return sm.sub_slice(pupil_table(spark, sf), 100, 400, units.factor("h")).select("recording_id", "i", r6(units.to_unit(F.col("t_ms"), "h"), "t_h"), "pupil")


@query(f"WITH {_P}, k AS (SELECT * FROM p WHERE i >= 3) SELECT recording_id, i, round(t_ms - min(t_ms) OVER (PARTITION BY recording_id), 3) AS t_ms FROM k")
def reset_time(spark, sf):
    return sm.reset_time(pupil_table(spark, sf).filter("i >= 3")).select("recording_id", "i", F.round("t_ms", 3).alias("t_ms"))


@query(f"WITH {_P} SELECT recording_id, count(*) AS n, round(min(t_ms), 6) AS t_min, round(max(t_ms), 6) AS t_max, CAST(sum(CASE WHEN pupil IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS pupil_masked FROM p GROUP BY recording_id")
def summary(spark, sf):
    return sm.summary(pupil_table(spark, sf), ["pupil"]).select("recording_id", "n", r6("t_min", "t_min"), r6("t_max", "t_max"), "pupil_masked")


@query(f"WITH {_P}, d AS (SELECT recording_id, t_ms - lag(t_ms) OVER (PARTITION BY recording_id ORDER BY i) AS step FROM p), f AS (SELECT recording_id, median(step) AS m FROM d GROUP BY recording_id), c AS (SELECT recording_id, count(*) AS n FROM p GROUP BY recording_id) SELECT recording_id, round(m, 4) AS step_ms, round(n * m / 3600000.0, 6) AS duration_h FROM f JOIN c USING (recording_id)")
def duration(spark, sf):
    return sm.duration(pupil_table(spark, sf), "h").select("recording_id", F.round("step_ms", 4).alias("step_ms"), r6("duration", "duration_h"))


@query(f"WITH {_P}, s AS (SELECT recording_id, avg(pupil) AS m, stddev_pop(pupil) AS d FROM p GROUP BY recording_id) SELECT recording_id, i, round((pupil - m) / d, 6) AS z FROM p JOIN s USING (recording_id)")
def scale(spark, sf):
    return sm.scale(pupil_table(spark, sf), ["pupil"]).select("recording_id", "i", r6("pupil", "z"))


@query(f"WITH {_P} SELECT recording_id, round(avg(pupil), 6) AS pupil_mean, round(stddev_pop(pupil), 6) AS pupil_sd FROM p GROUP BY recording_id")
def scale_params(spark, sf):
    return sm.scale_params(pupil_table(spark, sf), ["pupil"]).select("recording_id", r6("pupil_mean", "pupil_mean"), r6("pupil_sd", "pupil_sd"))


@query(f"WITH {_P} SELECT recording_id, i, round(pupil, 6) AS pupil FROM p")
def unscale(spark, sf):
    p = pupil_table(spark, sf)
    return sm.unscale(sm.scale(p, ["pupil"]), sm.scale_params(p, ["pupil"]), ["pupil"]).select("recording_id", "i", r6("pupil", "pupil"))


@query(f"WITH {_P} SELECT recording_id, CAST(floor(i / 4) AS BIGINT) AS i, round(avg(t_ms), 5) AS t_ms, round(avg(pupil), 6) AS pupil, bool_or(pupil IS NULL) AS masked FROM p GROUP BY recording_id, floor(i / 4)")
def downsample(spark, sf):
    return sm.downsample(pupil_table(spark, sf), ["pupil"], 4).select("recording_id", "i", F.round("t_ms", 5).alias("t_ms"), r6("pupil", "pupil"), F.col("pupil__m").alias("masked"))


@query(f"WITH {_G} SELECT recording_id, i, round(CASE WHEN left_x__m AND right_x__m THEN NULL WHEN left_x__m THEN right_x WHEN right_x__m THEN left_x ELSE (left_x + right_x) / 2 END, 6) AS mean_x, left_x__m AND right_x__m AS masked FROM g")
def merge_eyes(spark, sf):
    return sm.merge_eyes(gaze_table(spark, sf), "left_x", "right_x", "mean_x").select("recording_id", "i", r6("mean_x", "mean_x"), F.col("mean_x__m").alias("masked"))


@query(f"WITH {_G} SELECT recording_id, CAST(sum(CAST(left_x__m AS INT)) AS BIGINT) AS n_left, CAST(sum(CAST(right_x__m AS INT)) AS BIGINT) AS n_right, CAST(sum(CAST(left_x__m OR right_x__m AS INT)) AS BIGINT) AS n_any FROM g GROUP BY recording_id")
def merge_masks(spark, sf):
    g = gaze_table(spark, sf)
    both = sm.merge_masks(g.withColumns({"a": F.col("left_x__m"), "b": F.col("right_x__m")}), ["left_x", "right_x"])
    n = lambda c, a: F.sum(F.col(c).cast("long")).alias(a)
    return both.groupBy("recording_id").agg(n("a", "n_left"), n("b", "n_right"), n("left_x__m", "n_any"))


@query(
    f"""WITH {_P}, d AS (SELECT *, lag(t_ms) OVER (PARTITION BY recording_id ORDER BY i) AS before FROM p),
m AS (SELECT recording_id, median(t_ms - before) AS usual FROM d GROUP BY recording_id),
g AS (SELECT d.recording_id, before, usual, CAST(ceil((t_ms - before) / usual - 1e-9) AS BIGINT) - 1 AS k FROM d JOIN m USING (recording_id) WHERE usual > 0 AND t_ms - before > 2 * usual)
SELECT recording_id, CAST(sum(n) AS BIGINT) AS n, round(sum(t), 0) AS t_sum FROM (SELECT recording_id, count(*) AS n, sum(t_ms) AS t FROM p GROUP BY ALL
UNION ALL SELECT recording_id, k AS n, k * before + usual * k * (k + 1) / 2 AS t FROM g) GROUP BY recording_id"""
)
def fill_gaps(spark, sf):
    f = sm.fill_gaps(pupil_table(spark, sf), ["pupil"])
    return f.groupBy("recording_id").agg(F.count("*").alias("n"), F.round(F.sum("t_ms"), 0).alias("t_sum"))


def _smooth_sql(shape: str, length: int, direction: str) -> str:
    w = K.smoothing_weights(shape, length)
    first = {"center": -(length // 2), "backward": -(length - 1), "forward": 0}[direction]
    if direction == "center":
        at = "CASE WHEN abs(b.i + k.k) > b.n - 1 THEN 2 * (b.n - 1) - abs(b.i + k.k) ELSE abs(b.i + k.k) END"
    else:
        at = "greatest(0, least(b.n - 1, b.i + k.k))"
    rows = ", ".join(f"({first + k}, {v!r})" for k, v in enumerate(w))
    return f"""WITH {_G}, b AS (SELECT recording_id, i, left_x AS v, count(*) OVER (PARTITION BY recording_id) AS n FROM g), k(k, w) AS (VALUES {rows})
SELECT b.recording_id, b.i, round(sum(k.w * o.v), 6) AS smoothed FROM b CROSS JOIN k JOIN b o ON o.recording_id = b.recording_id AND o.i = {at} GROUP BY b.recording_id, b.i"""


def _add_smooth(name: str, shape: str, length: int, direction: str) -> None:
    def fn(spark, sf):
        return sm.smooth(gaze_table(spark, sf), "left_x", length, shape, direction).select("recording_id", "i", r6("left_x", "smoothed"))

    fn.__name__ = name
    query(_smooth_sql(shape, length, direction))(fn)


for _shape in K.SHAPES:
    _add_smooth(f"smooth_{_shape}", _shape, 5, "center")
_add_smooth("smooth_backward", "hamming", 5, "backward")
_add_smooth("smooth_forward", "hamming", 5, "forward")

# --- events and intervals


@query(f"WITH {_P} SELECT recording_id, event_id, label, round(t_ms / 1000.0, 6) AS t_sec FROM p WHERE contains(label, 'c') AND t_ms / 1000.0 BETWEEN 100000 AND 900000")
def event_filter(spark, sf):
    e = es.select(pupil_table(spark, sf), "c", (100_000, 900_000), "sec")
    return es.in_unit(e, "sec", "t_sec").select("recording_id", "event_id", "label", r6("t_sec", "t_sec"))


@query(f"WITH {_P} SELECT recording_id, event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_ms, event_id) AS k FROM p) WHERE k BETWEEN 3 AND 7")
def event_slice(spark, sf):
    return es.take(pupil_table(spark, sf), 2, 7).select("recording_id", "event_id", "label")


@query(f"WITH {_P}, {_EV} SELECT recording_id, event_id, round(s, 6) AS start_ms, round(e, 6) AS end_ms FROM iv")
def intervals_around(spark, sf):
    return _out(_around(spark, sf), "event_id")


@query(f"WITH {_P}, {_EV}, pairs AS (SELECT ev.recording_id, ev.event_id, arg_min(p.i, (abs(p.t_ms - ev.t_ms - 3600000.0), p.t_ms)) AS i FROM ev JOIN p ON p.recording_id = ev.recording_id GROUP BY ALL) SELECT * FROM pairs")
def nearest_sample(spark, sf):
    p = pupil_table(spark, sf)
    return iv.nearest_index(_clicks(p).withColumn("t_ms", F.col("t_ms") + 3_600_000.0), p).select("recording_id", "event_id", "i")


@query(f"WITH {_P}, a AS (SELECT recording_id, t_ms, row_number() OVER (PARTITION BY recording_id ORDER BY t_ms, event_id) AS k FROM p WHERE label = 'click'), b AS (SELECT recording_id, t_ms, row_number() OVER (PARTITION BY recording_id ORDER BY t_ms, event_id) AS k FROM p WHERE label = 'purchase') SELECT recording_id, CAST(k AS BIGINT) AS k, round(a.t_ms, 6) AS start_ms, round(b.t_ms, 6) AS end_ms FROM a JOIN b USING (recording_id, k)")
def intervals_between(spark, sf):
    p = pupil_table(spark, sf)
    return _out(iv.between_events(p.filter("label = 'click'"), p.filter("label = 'purchase'"), strict=False), F.col("k").cast("long").alias("k"))


@query(f"WITH {_P}, {_EV}, {_MERGED.format(d=0)} SELECT recording_id, round(min(s), 6) AS start_ms, round(max(e), 6) AS end_ms, count(*) AS parts FROM grouped GROUP BY recording_id, grp")
def interval_merge(spark, sf):
    return _out(iv.merge(_around(spark, sf)), "parts")


@query(f"WITH {_P}, {_EV}, {_MERGED.format(d=86400000)} SELECT recording_id, round(min(s), 6) AS start_ms, round(max(e), 6) AS end_ms, string_agg(label, '_' ORDER BY s, e) AS label FROM grouped GROUP BY recording_id, grp")
def interval_merge_distance(spark, sf):
    return _out(iv.merge_labels(_around(spark, sf), 86_400_000.0), "label")


@query(f"WITH {_P}, {_EV} SELECT recording_id, round(s / 1000.0, 6) AS start_sec, round(e / 1000.0, 6) AS end_sec, 'a' AS side FROM iv UNION ALL SELECT recording_id, round(t_ms / 1000.0, 6), round(t_ms / 1000.0 + 60, 6), 'b' FROM p WHERE label = 'view'")
def interval_union(spark, sf):
    b = _around(spark, sf).select("recording_id", "start", "end").withColumn("side", F.lit("a"))
    t = units.to_unit(F.col("t_ms"), "sec")
    a = pupil_table(spark, sf).filter("label = 'view'").select("recording_id", t.alias("start"), (t + 60).alias("end")).withColumn("side", F.lit("b"))
    return iv.added(a, b, "sec", "ms").select("recording_id", r6("start", "start_sec"), r6("end", "end_sec"), "side")


_SWEEP = """WITH {P}, {EV}, b AS (SELECT recording_id, t_ms AS s, t_ms + 7200000.0 AS e FROM p WHERE label = 'view'),
d AS (SELECT recording_id, s AS t, 1 AS da, 0 AS db FROM iv UNION ALL SELECT recording_id, e, -1, 0 FROM iv UNION ALL SELECT recording_id, s, 0, 1 FROM b UNION ALL SELECT recording_id, e, 0, -1 FROM b),
c AS (SELECT recording_id, t, sum(da) AS da, sum(db) AS db FROM d GROUP BY ALL),
x AS (SELECT recording_id, t, lead(t) OVER w AS u, sum(da) OVER w AS a, sum(db) OVER w AS b FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY t))
SELECT recording_id, round(sum(u - t), 3) AS total FROM x WHERE {keep} AND u IS NOT NULL GROUP BY recording_id"""


def _views(spark, sf):
    return pupil_table(spark, sf).filter("label = 'view'").select("recording_id", F.col("t_ms").alias("start"), (F.col("t_ms") + 7_200_000.0).alias("end"))


@query(_SWEEP.format(P=_P, EV=_EV, keep="a > 0 AND b = 0"))
def interval_subtract(spark, sf):
    x = iv.subtract(_around(spark, sf), _views(spark, sf))
    return x.groupBy("recording_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total"))


@query(_SWEEP.format(P=_P, EV=_EV, keep="a > 0 AND b > 0"))
def interval_intersect(spark, sf):
    x = iv.intersect(_around(spark, sf), _views(spark, sf))
    return x.groupBy("recording_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total"))


@query(f"WITH {_P}, {_EV}, b AS (SELECT recording_id, max(t_ms) AS hi FROM p GROUP BY 1) SELECT recording_id, event_id, round(greatest(0, s - 3600000.0), 6) AS start_ms, round(least(hi, e + 7200000.0), 6) AS end_ms FROM iv JOIN b USING (recording_id)")
def interval_pad(spark, sf):
    hi = pupil_table(spark, sf).groupBy("recording_id").agg(F.max("t_ms").alias("hi"))
    return _out(iv.pad(_around(spark, sf).join(hi, "recording_id"), 3_600_000.0, 7_200_000.0, F.lit(0.0), F.col("hi")), "event_id")


@query(f"WITH {_P}, {_EV}, {_MERGED.format(d=0)}, m AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY recording_id, grp) SELECT recording_id, round(s, 6) AS start_ms, round(e, 6) AS end_ms FROM m WHERE e - s >= 86400001 AND e - s <= 400000000 AND e > 0 AND s < 1500000000")
def interval_filter(spark, sf):
    return _out(iv.select(iv.merge(_around(spark, sf)), 86_400_001, 400_000_000, (0, 1_500_000_000)))


@query(f"WITH {_P}, {_EV}, {_MERGED.format(d=0)}, m AS (SELECT recording_id, max(e) - min(s) AS d FROM grouped GROUP BY recording_id, grp) SELECT recording_id, count(*) AS n, round(avg(d), 3) AS mean, round(stddev_pop(d), 3) AS sd, round(min(d), 3) AS min, round(max(d), 3) AS max, round(sum(d), 3) AS total FROM m GROUP BY recording_id")
def interval_stats(spark, sf):
    s = iv.stats(iv.merge(_around(spark, sf)))
    return s.select("recording_id", "n", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "min", "max", "total")])


@query(f"WITH {_P}, {_EV} SELECT recording_id, i, EXISTS (SELECT 1 FROM iv WHERE iv.recording_id = p.recording_id AND p.t_ms >= iv.s AND p.t_ms < iv.e) AS hit FROM p")
def interval_to_mask(spark, sf):
    return iv.covered(pupil_table(spark, sf).select("recording_id", "i", "t_ms"), _around(spark, sf), "t_ms").select("recording_id", "i", "hit")


@query(f"WITH {_P}, {_RUNS.format(flag='pupil IS NULL')} SELECT recording_id, s AS start_i, e AS end_i FROM runs")
def mask_to_intervals(spark, sf):
    return iv.runs(pupil_table(spark, sf), F.col("pupil__m")).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(f"WITH {_P}, {_EV} SELECT recording_id, event_id, CAST(round_even(s / 3600000.0, 0) AS BIGINT) AS start_i, CAST(round_even(e / 3600000.0, 0) AS BIGINT) AS end_i FROM iv")
def unit_to_index(spark, sf):
    x = iv.in_unit(_around(spark, sf), "ms", None, 1 / 3600)  # a sample each hour
    return x.select("recording_id", "event_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(f"WITH {_P}, {_EV} SELECT recording_id, i, pupil IS NULL OR EXISTS (SELECT 1 FROM iv WHERE iv.recording_id = p.recording_id AND p.t_ms >= iv.s AND p.t_ms < iv.e) AS masked FROM p")
def mask_intervals(spark, sf):
    return iv.masked(pupil_table(spark, sf).select("recording_id", "i", "t_ms", "pupil", "pupil__m"), _around(spark, sf), ["pupil"], "t_ms").select("recording_id", "i", F.col("pupil__m").alias("masked"))


_NEAR = """
ne AS (SELECT iv.recording_id, iv.event_id, arg_min(p.i, (abs(p.t_ms - iv.s), p.t_ms, p.i)) AS a, arg_min(p.i, (abs(p.t_ms - iv.e), p.t_ms, p.i)) AS b0 FROM iv JOIN p USING (recording_id) GROUP BY 1, 2),
nb AS (SELECT recording_id, event_id, a, CASE WHEN a = b0 THEN a + 1 ELSE b0 END AS b FROM ne)"""


@query(f"WITH {_P}, {_EV}, {_NEAR} SELECT nb.recording_id, nb.event_id, round(avg(pupil), 6) AS mean FROM nb JOIN p ON p.recording_id = nb.recording_id AND p.i >= a AND p.i < b GROUP BY 1, 2")
def stat_per_event(spark, sf):
    s = iv.stat_per_event(pupil_table(spark, sf), _around(spark, sf), ["pupil"])
    return s.select("recording_id", "event_id", r6("pupil", "mean"))


@query(
    f"""WITH {_P}, {_EV}, {_NEAR}, j AS (SELECT nb.recording_id, nb.event_id, pupil FROM nb JOIN p ON p.recording_id = nb.recording_id AND p.i >= a AND p.i < b)
SELECT recording_id, event_id, round(median(pupil), 6) AS median, round(stddev_pop(pupil), 6) AS sd, min(pupil) AS low, count(pupil) AS n FROM j GROUP BY 1, 2"""
)
def stats_by_name(spark, sf):
    p, around = pupil_table(spark, sf), _around(spark, sf)
    one = lambda stat, name: iv.stat_per_event(p, around, ["pupil"], stat).withColumnRenamed("pupil", name)
    out = one("median", "median").join(one("sd", "sd"), ["recording_id", "event_id"]).join(one(F.min, "low"), ["recording_id", "event_id"]).join(one("n", "n"), ["recording_id", "event_id"])
    return out.select("recording_id", "event_id", r6("median", "median"), r6("sd", "sd"), "low", "n")


# --- epochs

_EPOCH = f"""WITH {_P}, o AS (SELECT recording_id, event_id, label, i AS i0 FROM p WHERE label = 'click'),
ep AS (SELECT o.recording_id, o.event_id, o.label, p.i - o.i0 AS k, p.pupil AS v FROM o JOIN p ON p.recording_id = o.recording_id AND p.i BETWEEN o.i0 - 2 AND o.i0 + 4),
bc AS (SELECT *, v - avg(CASE WHEN k < 0 THEN v END) OVER (PARTITION BY recording_id, event_id) AS c FROM ep)"""


def epochs(p: DataFrame, label: str, before: int = 2, after: int = 4) -> DataFrame:
    return ep.cut(p, p.filter(F.col("label") == label).select("recording_id", "event_id", "i"), "pupil", before, after).drop("masked")


@query(_EPOCH + " SELECT recording_id, event_id, k, v FROM ep")
def erpd(spark, sf):
    return epochs(pupil_table(spark, sf), "click")


@query(_EPOCH + " SELECT recording_id, event_id, k, round(c, 6) AS v FROM bc")
def erpd_baseline(spark, sf):
    return ep.baseline_correct(epochs(pupil_table(spark, sf), "click")).select("recording_id", "event_id", "k", r6("v", "v"))


@query(_EPOCH + " SELECT k, round(avg(c), 6) AS mean, round(stddev_samp(c) / sqrt(count(c)), 6) AS sem, round(100.0 * avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END), 6) AS missing FROM bc GROUP BY k")
def erpd_mean_sem(spark, sf):
    raw = epochs(pupil_table(spark, sf), "click").withColumn("raw", F.col("v"))
    return ep.mean_sem(ep.baseline_correct(raw), missing="raw").select("k", r6("mean", "mean"), r6("sem", "sem"), r6("missing", "missing"))


@query(_EPOCH + ", sub AS (SELECT recording_id, k, avg(c) AS m FROM bc GROUP BY ALL) SELECT k, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, count(m) AS n FROM sub GROUP BY k")
def group_erpd(spark, sf):
    return ep.group(ep.baseline_correct(epochs(pupil_table(spark, sf), "click"))).select("k", r6("mean", "mean"), r6("sem", "sem"), "n")


@query("WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings) SELECT label, k, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY label, k")
def erpd_from_arrays(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    return e.groupBy("label", F.col("k").cast("long").alias("k")).agg(r6(F.avg("v"), "mean"))


_FLAG = f"""WITH {_P}, o AS (SELECT recording_id, event_id, label, i AS i0 FROM p),
ep AS (SELECT o.recording_id, o.event_id, o.label, p.i - o.i0 AS k, p.pupil AS v FROM o JOIN p ON p.recording_id = o.recording_id AND p.i BETWEEN o.i0 - 2 AND o.i0 + 4),
t AS (SELECT recording_id, event_id, label, avg(CASE WHEN k >= 0 THEN v END) - avg(CASE WHEN k < 0 THEN v END) AS d FROM ep GROUP BY ALL)
SELECT label, count(d) AS n, round(avg(d), 6) AS mean FROM t GROUP BY label"""


@query(_FLAG)
def response_by_label(spark, sf):
    """Baseline-corrected mean response to each kind of event: one window pass over recordings."""
    p = pupil_table(spark, sf)
    after = F.avg("pupil").over(sm.ordered().rowsBetween(0, 4))
    before = F.avg("pupil").over(sm.ordered().rowsBetween(-2, -1))
    return p.select("label", (after - before).alias("d")).groupBy("label").agg(F.count("d").alias("n"), r6(F.avg("d"), "mean"))


# --- blinks


@query(f"WITH {_P}, {_RUNS.format(flag='pupil IS NULL')}, n AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1) SELECT recording_id, s AS start_i, e AS end_i FROM runs JOIN n USING (recording_id) WHERE e < n AND e - 1 - s >= 1")
def blinks_zero(spark, sf):
    return bl.zero_blinks(pupil_table(spark, sf), "pupil", 1).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


def _slope_sql() -> str:
    rows = ", ".join(f"({k - 2}, {v!r})" for k, v in enumerate(K.slope_weights(5)))
    return f"""WITH {_G}, b AS (SELECT recording_id, i, pupil AS v, count(*) OVER (PARTITION BY recording_id) AS n FROM g), k(k, w) AS (VALUES {rows})
SELECT b.recording_id, b.i, round(sum(k.w * o.v), 4) AS velocity FROM b CROSS JOIN k JOIN b o ON o.recording_id = b.recording_id AND o.i = greatest(0, least(b.n - 1, b.i + k.k)) GROUP BY b.recording_id, b.i"""


@query(_slope_sql())
def velocity_savgol(spark, sf):
    return bl.velocity(gaze_table(spark, sf), "pupil", 5).select("recording_id", "i", F.round("velocity", 4).alias("velocity"))


@query(f"WITH {_P}, {_RUNS.format(flag='pupil IS NULL')}, iv AS (SELECT * FROM runs), {_MERGED.format(d=5)} SELECT recording_id, min(s) AS start_i, max(e) AS end_i FROM grouped GROUP BY recording_id, grp")
def blinks_merge_close(spark, sf):
    return iv.merge(iv.runs(pupil_table(spark, sf), F.col("pupil__m")), 5).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(f"WITH {_P}, {_RUNS.format(flag='pupil IS NULL')} SELECT recording_id, count(*) AS n, round(avg(e - s), 6) AS mean, round(stddev_pop(e - s), 6) AS sd, min(e - s) AS min, max(e - s) AS max FROM runs GROUP BY recording_id")
def blink_stats(spark, sf):
    s = iv.stats(iv.runs(pupil_table(spark, sf), F.col("pupil__m")))
    return s.select("recording_id", "n", r6("mean", "mean"), r6("sd", "sd"), "min", "max")


def _slopes_sql(source: str, value: str, length: int, name: str) -> str:
    """CTE `name` with slopes at the last (back) and first (fore) sample of the centred window; null where a sample of it is."""
    rows = ", ".join(f"({k - length // 2}, {x!r}, {y!r}, {z!r})" for k, (x, y, z) in enumerate(zip(*(K.slope_weights(length, at) for at in (length // 2, -(length // 2), 0)), strict=True)))
    return f"""{name}_b AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM {source}), {name}_k(k, wb, wf, wc) AS (VALUES {rows}),
{name} AS MATERIALIZED (SELECT b.recording_id, b.i, any_value(b.n) AS n, CASE WHEN count(o.{value}) = {length} THEN sum(wb * o.{value}) END AS back, CASE WHEN count(o.{value}) = {length} THEN sum(wf * o.{value}) END AS fore,
  CASE WHEN count(o.{value}) = {length} THEN sum(wc * o.{value}) END AS centre
  FROM {name}_b b CROSS JOIN {name}_k k JOIN {name}_b o ON o.recording_id = b.recording_id AND o.i = greatest(0, least(b.n - 1, b.i + k.k)) GROUP BY b.recording_id, b.i)"""


_FILLED = """
fl AS (SELECT *, last_value(CASE WHEN pupil IS NOT NULL THEN i END IGNORE NULLS) OVER w AS i0, last_value(pupil IGNORE NULLS) OVER w AS v0,
  first_value(CASE WHEN pupil IS NOT NULL THEN i END IGNORE NULLS) OVER u AS i1, first_value(pupil IGNORE NULLS) OVER u AS v1 FROM p
  WINDOW w AS (PARTITION BY recording_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY recording_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT recording_id, i, pupil, CASE WHEN pupil IS NOT NULL THEN pupil WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END AS f FROM fl)"""


def _flag_runs(name: str, source: str, flag: str) -> str:
    return f"""{name}_h AS (SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS island FROM {source} WHERE {flag}),
{name} AS (SELECT recording_id, min(i) AS s, max(i) AS e FROM {name}_h GROUP BY recording_id, island)"""


def _velocity_sql(length: int, on: str, off: str, shortest: int, extra: str = "") -> str:
    """CTE chain(recording_id, s, e): the greedy walk over onsets and offsets, one step at a time."""
    return f"""{_FILLED}, {_slopes_sql("filled", "f", length, "sl")}{extra},
vp AS (SELECT sl.*, p.pupil FROM sl JOIN p USING (recording_id, i)), {_flag_runs("onr", "vp", f"pupil IS NOT NULL AND back <= {on}")}, {_flag_runs("offr", "vp", f"pupil IS NOT NULL AND fore >= {off}")},
ons AS (SELECT recording_id, s AS i FROM onr WHERE e + 1 - s > {shortest}), offs AS (SELECT recording_id, s AS i FROM offr WHERE e + 1 - s > {shortest}),
ends AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1),
steps AS (SELECT o.recording_id, o.i AS s, coalesce((SELECT min(f.i) FROM offs f WHERE f.recording_id = o.recording_id AND f.i > o.i), n) AS e FROM ons o JOIN ends USING (recording_id) WHERE recording_id IN (SELECT recording_id FROM offs)),
nexts AS (SELECT *, (SELECT min(o.i) FROM ons o WHERE o.recording_id = steps.recording_id AND o.i > steps.e) AS nxt FROM steps),
chain AS (SELECT recording_id, s, e, nxt FROM nexts WHERE (recording_id, s) IN (SELECT recording_id, min(s) FROM nexts GROUP BY 1)
  UNION ALL SELECT n.recording_id, n.s, n.e, n.nxt FROM chain c JOIN nexts n ON n.recording_id = c.recording_id AND n.s = c.nxt)"""


@query(f"WITH RECURSIVE {_P}, {_velocity_sql(5, '-15.0', '15.0', 0)} SELECT recording_id, s AS start_i, e AS end_i FROM chain")
def blinks_velocity(spark, sf):
    return bl.velocity_blinks(pupil_table(spark, sf), "pupil", 5, -15.0, 15.0, 0, 0).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


_TENTH = """,
th AS (SELECT recording_id, quantile_cont(centre, 0.1) AS on_v, quantile_cont(centre, 0.9) AS off_v FROM sl JOIN p USING (recording_id, i) WHERE pupil IS NOT NULL GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {_P}, {_velocity_sql(3, '(SELECT on_v FROM th WHERE th.recording_id = vp.recording_id)', '(SELECT off_v FROM th WHERE th.recording_id = vp.recording_id)', 1, _TENTH)},
{_RUNS.format(flag='pupil IS NULL')}, z AS (SELECT recording_id, s, e FROM runs JOIN ends USING (recording_id) WHERE e < n AND e - 1 - s >= 1),
u AS (SELECT recording_id, s, e FROM chain UNION ALL SELECT recording_id, s, e FROM z),
a AS (SELECT recording_id, s, row_number() OVER (PARTITION BY recording_id ORDER BY s) AS k FROM u), b AS (SELECT recording_id, e, row_number() OVER (PARTITION BY recording_id ORDER BY e) AS k FROM u),
iv AS (SELECT recording_id, s, e FROM a JOIN b USING (recording_id, k)), {_MERGED.format(d=0)}, m AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY recording_id, grp)
SELECT recording_id, s AS start_i, e AS end_i FROM m WHERE e - s >= 2"""
)
def blinks_detect(spark, sf):
    """Settings in ms at 1000 samples a second: two samples at least, slopes by percentile over three samples."""
    b = bl.detect(pupil_table(spark, sf), "pupil", 1000, 2, 3, "10%", "90%", 1, 1)
    return b.select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


_MAHOT = f"""{_slopes_sql("p", "pupil", 5, "sl")}, {_RUNS.format(flag='pupil IS NULL')}, sz AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1),
bk AS (SELECT recording_id, s, e, greatest(0, s - 10) AS w0, least(e + 10, n) AS w1, CASE WHEN s > 10 THEN e ELSE e + 10 - s END AS f FROM runs JOIN sz USING (recording_id) WHERE e < n),
hits AS MATERIALIZED (SELECT recording_id, i, back <= -10 AS o, fore >= 10 AS x FROM sl),
lo AS (SELECT bk.recording_id, bk.s, bk.e, max(i) AS i FROM bk JOIN hits h ON h.recording_id = bk.recording_id AND h.o AND h.i BETWEEN w0 AND bk.s GROUP BY 1, 2, 3),
hi AS (SELECT bk.recording_id, bk.s, bk.e, min(i) AS i FROM bk JOIN hits h ON h.recording_id = bk.recording_id AND h.x AND h.i >= f AND h.i < w1 GROUP BY 1, 2, 3),
{_flag_runs("orun", "hits", "o")}, {_flag_runs("xrun", "hits", "x")},
fine AS MATERIALIZED (SELECT bk.recording_id, bk.s, bk.e, greatest(w0, greatest(w0, r.s) - 1) AS onset, least(w1 - 1, least(q.e, w1 - 1) + 1) AS offs, n FROM bk JOIN sz USING (recording_id)
  JOIN lo ON lo.recording_id = bk.recording_id AND lo.s = bk.s JOIN hi ON hi.recording_id = bk.recording_id AND hi.s = bk.s
  JOIN orun r ON r.recording_id = bk.recording_id AND lo.i BETWEEN r.s AND r.e JOIN xrun q ON q.recording_id = bk.recording_id AND hi.i BETWEEN q.s AND q.e)"""


def _fine(p: DataFrame) -> DataFrame:
    return bl.refine(p, bl.zero_blinks(p, "pupil", 0), "pupil", 5, -10.0, 10.0)


@query(f"WITH {_P}, {_MAHOT} SELECT recording_id, s AS start_i, e AS end_i, onset, offs AS offset_i FROM fine")
def mahot_bounds(spark, sf):
    return _fine(pupil_table(spark, sf)).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"), "onset", F.col("offset").alias("offset_i"))


@query(
    f"""WITH {_P}, {_MAHOT}, q AS (SELECT recording_id, onset, offs, greatest(0, 2 * onset - offs) AS t1, least(n - 1, 2 * offs - onset) AS t4 FROM fine),
o AS MATERIALIZED (SELECT DISTINCT recording_id, t1, CASE WHEN t1 = onset THEN onset + 1 ELSE onset END AS t2, CASE WHEN t4 = offs THEN offs - 1 ELSE offs END AS t3, t4 FROM q),
g1 AS MATERIALIZED (SELECT o.*, t_ms AS x1, pupil AS v1 FROM o JOIN p ON p.recording_id = o.recording_id AND i = t1 WHERE t1 < t2 AND t2 < t3 AND t3 < t4),
g2 AS MATERIALIZED (SELECT o.*, t_ms AS x2, pupil AS v2 FROM g1 o JOIN p ON p.recording_id = o.recording_id AND i = t2), g3 AS MATERIALIZED (SELECT o.*, t_ms AS x3, pupil AS v3 FROM g2 o JOIN p ON p.recording_id = o.recording_id AND i = t3),
g AS MATERIALIZED (SELECT o.*, t_ms AS x4, pupil AS v4 FROM g3 o JOIN p ON p.recording_id = o.recording_id AND i = t4),
c AS (SELECT p.recording_id, p.i, arg_max(struct_pack(v := v1 * ((t_ms - x2) / nullif(x1 - x2, 0)) * ((t_ms - x3) / nullif(x1 - x3, 0)) * ((t_ms - x4) / nullif(x1 - x4, 0)) + v2 * ((t_ms - x1) / nullif(x2 - x1, 0)) * ((t_ms - x3) / nullif(x2 - x3, 0)) * ((t_ms - x4) / nullif(x2 - x4, 0))
  + v3 * ((t_ms - x1) / nullif(x3 - x1, 0)) * ((t_ms - x2) / nullif(x3 - x2, 0)) * ((t_ms - x4) / nullif(x3 - x4, 0)) + v4 * ((t_ms - x1) / nullif(x4 - x1, 0)) * ((t_ms - x2) / nullif(x4 - x2, 0)) * ((t_ms - x3) / nullif(x4 - x3, 0))), (t2, t3)).v AS v, max(t2) AS hit
  FROM g JOIN p ON p.recording_id = g.recording_id AND p.i >= t2 AND p.i < t3 GROUP BY 1, 2)
SELECT p.recording_id, p.i, round(coalesce(v, pupil), 4) AS fixed, hit IS NOT NULL OR pupil IS NULL AS masked FROM p LEFT JOIN c USING (recording_id, i)"""
)
def blinks_interpolate(spark, sf):
    p = pupil_table(spark, sf)
    out = bl.interpolate_cubic(p, _fine(p), "pupil", "fixed")
    return out.select("recording_id", "i", F.round("fixed", 4).alias("fixed"), F.col("fixed__m").alias("masked"))


_LINES = f"""{_RUNS.format(flag='pupil IS NULL')}, sz AS (SELECT recording_id, max(i) AS last FROM p GROUP BY 1),
k0 AS MATERIALIZED (SELECT r.recording_id, s, e, last, pupil AS v0, t_ms AS t0 FROM runs r JOIN sz USING (recording_id) JOIN p ON p.recording_id = r.recording_id AND i = greatest(0, s - 1) WHERE pupil IS NOT NULL),
k AS MATERIALIZED (SELECT r.*, pupil AS v1, t_ms AS t1 FROM k0 r JOIN p ON p.recording_id = r.recording_id AND i = least(last, e) WHERE pupil IS NOT NULL),
x AS (SELECT p.*, k.s IS NOT NULL AS hit, v0, v1, (p.t_ms - t0) / nullif(t1 - t0, 0) AS u FROM p LEFT JOIN k ON k.recording_id = p.recording_id AND p.i >= s AND p.i < e)"""


def _filled_by(method: str, value: str):
    def fn(spark, sf):
        p = pupil_table(spark, sf)
        out = bl.interpolate(p, iv.runs(p, F.col("pupil__m")), "pupil", method, "out")
        return out.select("recording_id", "i", r6("out", "pupil"), F.col("out__m").alias("masked"))

    fn.__name__ = f"interpolate_{method}"
    query(f"WITH {_P}, {_LINES} SELECT recording_id, i, round(coalesce(pupil, {value}, v0), 6) AS pupil, hit OR pupil IS NULL AS masked FROM x")(fn)


for _method, _value in {"linear": "v0 + (v1 - v0) * u", "nearest": "CASE WHEN u <= 0.5 THEN v0 ELSE v1 END", "previous": "v0", "next": "v1"}.items():
    _filled_by(_method, _value)


@query(
    f"WITH {_P}, {_FILLED}, {_slopes_sql('filled', 'f', 5, 'sl')} SELECT recording_id, round(quantile_cont(centre, 0.1), 6) AS on_v, round(quantile_cont(centre, 0.9), 6) AS off_v FROM sl JOIN p USING (recording_id, i) WHERE pupil IS NOT NULL GROUP BY recording_id"
)
def velocity_thresholds(spark, sf):
    return bl.thresholds(pupil_table(spark, sf), "pupil", 1000, 5, "10%", "90%").select("recording_id", r6("on_v", "on_v"), r6("off_v", "off_v")).distinct()


# --- gaze and geometry

SETUP = geo.Setup.of(60, 60, 300, 200, 620, (10, 20), (0.1, 0.05), {"r": 600, "theta": 1.4, "phi": 0.1})


@query(f"WITH {_G}, d AS (SELECT recording_id, i, sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) AS dist FROM g), q AS (SELECT recording_id, quantile_cont(dist, 0.9) AS t FROM d GROUP BY 1) SELECT recording_id, i, round(dist, 6) AS dist, round(dist, 9) > round(t, 9) AS diverged FROM d JOIN q USING (recording_id)")
def eye_divergence(spark, sf):
    g = gz.divergent(gaze_table(spark, sf), 0.9)
    return g.select("recording_id", "i", r6("dist", "dist"), "diverged")


@query(f"WITH {_G}, hit AS (SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS island FROM g WHERE coalesce((NOT left_x__m AND (left_x < 0 OR left_x > 40)) OR (NOT left_y__m AND (left_y < 0 OR left_y > 40)), false)) SELECT recording_id, min(i) AS start_i, max(i) + 1 AS end_i FROM hit GROUP BY recording_id, island")
def offscreen(spark, sf):
    return gz.offscreen_runs(gaze_table(spark, sf), "left", geo.Setup.of(40, 40, 100, 100)).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(f"WITH {_G} SELECT recording_id, CAST(sum(CASE WHEN sqrt((left_x - 25) ** 2 + (left_y - 20) ** 2) <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS in_circle, CAST(sum(CASE WHEN left_x BETWEEN 10 AND 30 AND left_y BETWEEN 5 AND 25 THEN 1 ELSE 0 END) AS BIGINT) AS in_rect FROM g GROUP BY recording_id")
def roi_dwell(spark, sf):
    x, y = F.col("left_x"), F.col("left_y")
    n = lambda c, a: F.sum(c.cast("long")).alias(a)
    return gaze_table(spark, sf).groupBy("recording_id").agg(n(geo.in_circle(x, y, 25, 20, 10), "in_circle"), n(geo.in_rectangle(x, y, 30, 25, 10, 5), "in_rect"))


@query(f"WITH {_G} SELECT recording_id, i, round((left_x - 30) * 5, 6) AS x_mm, round((left_y - 30) * (200.0 / 60), 6) AS y_mm, round(degrees(atan((left_x - 30) * 5 / {SETUP.d!r})), 6) AS x_deg, round(degrees(atan(-(left_y - 30) * (200.0 / 60) / {SETUP.d!r})), 6) AS y_deg FROM g")
def px_mm_deg(spark, sf):
    x, y = F.col("left_x"), F.col("left_y")
    mx, my = SETUP.pixels_to_mm(x, y)
    ax, ay = SETUP.pixels_to_degrees(x, y)
    return gaze_table(spark, sf).select("recording_id", "i", r6(mx, "x_mm"), r6(my, "y_mm"), r6(ax, "x_deg"), r6(ay, "y_deg"))


@query(f"WITH {_G} SELECT recording_id, i, round(left_x, 6) AS x, round(left_y, 6) AS y FROM g")
def deg_to_px(spark, sf):
    ax, ay = SETUP.pixels_to_degrees(F.col("left_x"), F.col("left_y"))
    x, y = SETUP.radians_to_pixels(F.radians(ax), F.radians(ay))
    return gaze_table(spark, sf).select("recording_id", "i", r6(x, "x"), r6(y, "y"))


_MM = f"mm AS (SELECT recording_id, i, pupil, (left_x - 30) * 5 AS x, (left_y - 30) * (200.0 / 60) AS y FROM g), s AS (SELECT {SETUP.d!r}::DOUBLE AS d, {SETUP.pitch!r}::DOUBLE AS p, {SETUP.yaw!r}::DOUBLE AS w, 600.0::DOUBLE AS r, 1.4::DOUBLE AS th, 0.1::DOUBLE AS ph)"


@query(f"WITH {_G}, {_MM} SELECT recording_id, i, round(x * cos(w) + y * sin(p) * sin(w) + 10, 6) AS ex, round(y * cos(p) + 20, 6) AS ey, round(-x * sin(w) + y * sin(p) * cos(w) + d, 6) AS ez FROM mm, s")
def eye_frame(spark, sf):
    a, b, c = SETUP.eye_frame(*SETUP.pixels_to_mm(F.col("left_x"), F.col("left_y")))
    return gaze_table(spark, sf).select("recording_id", "i", r6(a, "ex"), r6(b, "ey"), r6(c, "ez"))


@query(f"WITH {_G}, {_MM} SELECT recording_id, i, round(pupil * sqrt((x * x + y * y) / (d * d) + 1), 4) AS pupil FROM mm, s")
def foreshorten_simple(spark, sf):
    x, y = SETUP.pixels_to_mm(F.col("left_x"), F.col("left_y"))
    return gaze_table(spark, sf).select("recording_id", "i", F.round(F.col("pupil") * F.sqrt((x * x + y * y) / SETUP.d**2 + 1), 4).alias("pupil"))


@query(f"WITH {_G}, {_MM}, c AS (SELECT recording_id, i, (x * r * sin(th) * cos(ph) + y * r * sin(th) * sin(ph) + d * r * cos(th)) / (sqrt(x * x + y * y + d * d) * r) AS c FROM mm, s) SELECT recording_id, i, round(c, 6) AS cos_alpha, round(CASE WHEN c >= 0.15 THEN 1 / c END, 6) AS factor FROM c")
def cos_alpha_correction(spark, sf):
    x, y = SETUP.pixels_to_mm(F.col("left_x"), F.col("left_y"))
    c = geo.cos_alpha(x, y, 1.4, 0.1, 600.0, SETUP.d)
    return gaze_table(spark, sf).select("recording_id", "i", r6(c, "cos_alpha"), r6(geo.correction_factor(c), "factor"))


@query(f"WITH {_G}, e AS (SELECT recording_id, sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) AS o FROM g) SELECT recording_id, count(*) AS n, round(avg(o), 6) AS mean, round(stddev_pop(o), 6) AS sd, round(min(o), 6) AS min, round(max(o), 6) AS max FROM e GROUP BY 1")
def calibration_stats(spark, sf):
    o = F.sqrt((F.col("left_x") - F.col("right_x")) ** 2 + (F.col("left_y") - F.col("right_y")) ** 2)
    return gaze_table(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n"), r6(F.avg(o), "mean"), r6(F.stddev_pop(o), "sd"), r6(F.min(o), "min"), r6(F.max(o), "max"))


# --- regions from angles and mm, validation points, replay

_CIRCLE = rois.Circle.from_degrees(("1 deg", "0.5 deg"), "4 deg", SETUP)
_BOX = rois.Rectangle.from_mm((-60, -40), ("5 cm", "2 cm"), SETUP)
_DIST = "sqrt(620.0 * 620 - 10 * 10 - 20 * 20)"


@query(
    f"""WITH {_G}, k AS (SELECT {_DIST} AS d), c AS (SELECT 30 + d * tan(radians(1)) / 5 AS cx, 30 - d * tan(radians(0.5)) / (200 / 60.0) AS cy,
  d * tan(radians(4)) / ((5 + 200 / 60.0) / 2) AS r FROM k)
SELECT recording_id, CAST(count(*) FILTER (sqrt((left_x - cx) ** 2 + (left_y - cy) ** 2) <= r) AS BIGINT) AS in_circle,
  CAST(count(*) FILTER (left_x BETWEEN 30 - 60 / 5.0 AND 30 + 50 / 5.0 AND left_y BETWEEN 30 - 20 * 60 / 200.0 AND 30 + 40 * 60 / 200.0) AS BIGINT) AS in_rect FROM g, c GROUP BY recording_id"""
)
def roi_from_angles(spark, sf):
    x, y = F.col("left_x"), F.col("left_y")
    n = lambda c, a: F.count_if(c).alias(a)
    return gaze_table(spark, sf).groupBy("recording_id").agg(n(_CIRCLE.contains(x, y), "in_circle"), n(_BOX.contains(x, y), "in_rect"))


def _validation(spark, sf) -> DataFrame:
    g = gaze_table(spark, sf)
    dx, dy = F.col("right_x") - F.col("left_x"), F.col("right_y") - F.col("left_y")
    return g.select("recording_id", "i", F.lit("LEFT").alias("eye"), F.col("left_x").alias("point_x"), F.col("left_y").alias("point_y"), F.sqrt(dx * dx + dy * dy).alias("offset"), dx.alias("diff_x"), dy.alias("diff_y"))


@query(f"WITH {_G} SELECT recording_id, i, 'left' AS eye, round(right_x, 6) AS measured_x, round(right_y, 6) AS measured_y FROM g")
def calibration_points(spark, sf):
    return cal.measured_points(_validation(spark, sf)).select("recording_id", "i", "eye", r6("measured_x", "measured_x"), r6("measured_y", "measured_y"))


@query(f"WITH {_G}, e AS (SELECT recording_id, sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) AS o FROM g) SELECT recording_id, 'left' AS eye, count(*) AS n, round(avg(o), 6) AS mean, round(stddev_pop(o), 6) AS sd, round(max(o), 6) AS max, round(min(o), 6) AS min FROM e GROUP BY 1")
def calibration_errors(spark, sf):
    e = cal.error_stats(cal.measured_points(_validation(spark, sf)), "recording_id", "eye")
    return e.select("recording_id", "eye", "n", *[r6(c, c) for c in ("mean", "sd", "max", "min")])


REPLAY = History().then(sm.scale, ["v"]).then(sm.downsample, ["v"], by=4)


@query(
    f"""WITH {_P}, {_G}, a AS (SELECT 'pupil' AS kind, recording_id, i, pupil AS v FROM p UNION ALL SELECT 'gaze', recording_id, i, left_x FROM g),
z AS (SELECT kind, recording_id, i, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM a WINDOW w AS (PARTITION BY kind, recording_id))
SELECT kind, recording_id, CAST(floor(i / 4) AS BIGINT) AS i, round(avg(v), 6) AS v FROM z GROUP BY 1, 2, floor(i / 4)"""
)
def history_replay(spark, sf):
    p = pupil_table(spark, sf).select("recording_id", "i", "t_ms", F.col("pupil").alias("v"), F.col("pupil__m").alias("v__m"))
    g = gaze_table(spark, sf).select("recording_id", "i", "t_ms", F.col("left_x").alias("v"), F.col("left_x__m").alias("v__m"))
    out = lambda df, kind: REPLAY.apply(df).select(F.lit(kind).alias("kind"), "recording_id", "i", r6("v", "v"))
    return out(p, "pupil").unionByName(out(g, "gaze"))


@query(f"WITH {_G}, v AS (SELECT * FROM g WHERE NOT left_x__m AND left_x BETWEEN 0 AND 50 AND left_y BETWEEN 0 AND 50) SELECT CAST(least(floor(left_x / 5), 9) AS BIGINT) AS bx, CAST(least(floor(left_y / 5), 9) AS BIGINT) AS by, count(*) AS n, round(avg(pupil), 4) AS pupil FROM v GROUP BY 1, 2")
def heatmap(spark, sf):
    b = vw.bins(gaze_table(spark, sf).filter(~F.col("left_x__m")), F.col("left_x"), F.col("left_y"), 0, 50, 10, F.col("pupil"))
    return b.select("bx", "by", "n", F.round("mean", 4).alias("pupil"))


@query(f"WITH {_P} SELECT recording_id, i, round((t_ms - min(t_ms) OVER w) / nullif(max(t_ms) OVER w - min(t_ms) OVER w, 0), 6) AS progress, CAST(floor(t_ms / 86400000.0) AS BIGINT) AS segment FROM p WINDOW w AS (PARTITION BY recording_id)")
def scanpath(spark, sf):
    p = vw.segments(pupil_table(spark, sf), 24, "h")
    return p.select("recording_id", "i", r6(vw.progress(p), "progress"), "segment")


@query(
    f"""WITH {_P}, n AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1), f(factor) AS (VALUES (10), (100), (1000)),
r AS (SELECT p.recording_id, factor, CAST(floor(i / factor) AS BIGINT) AS chunk, i, t_ms, pupil FROM p JOIN n USING (recording_id) CROSS JOIN f WHERE floor(i / factor) < greatest(1, floor(n / factor))),
a AS (SELECT recording_id, factor, chunk, coalesce(arg_min(i, (pupil, i)) FILTER (pupil IS NOT NULL), min(i)) AS lo, coalesce(arg_max(i, (pupil, -i)) FILTER (pupil IS NOT NULL), max(i)) AS hi FROM r GROUP BY 1, 2, 3),
e AS (SELECT recording_id, factor, chunk, CAST(0 AS BIGINT) AS pos, least(lo, hi) AS i FROM a UNION ALL SELECT recording_id, factor, chunk, CAST(1 AS BIGINT), greatest(lo, hi) FROM a)
SELECT recording_id, factor, chunk, pos, round(t_ms, 6) AS t_ms, pupil AS value, pupil IS NULL AS masked FROM e JOIN p USING (recording_id, i)"""
)
def lod(spark, sf):
    return vw.levels(pupil_table(spark, sf), "pupil").select("recording_id", "factor", "chunk", "pos", r6("t_ms", "t_ms"), "value", "masked")


@query(f"WITH {_P} SELECT recording_id, round(min(pupil) - 0.1 * (max(pupil) - min(pupil)), 6) AS lo, round(max(pupil) + 0.1 * (max(pupil) - min(pupil)), 6) AS hi FROM p GROUP BY 1")
def value_range(spark, sf):
    return co.value_range(pupil_table(spark, sf), "pupil", 0.1).select("recording_id", r6("lo", "lo"), r6("hi", "hi"))


@query(f"WITH {_P} SELECT recording_id, min(t_ms) / 3600000.0 <= 400 AND max(t_ms) / 3600000.0 >= 390 AS overlaps FROM p GROUP BY 1")
def plot_range(spark, sf):
    return vw.in_plot_range(pupil_table(spark, sf), 390, 400, "h")


@query(f"WITH {_P}, w AS (SELECT recording_id, event_id, label, i FROM p WHERE label = 'click' AND t_ms >= 86400000 AND t_ms < 864000000) SELECT w.*, pupil FROM w JOIN p USING (recording_id, i)".replace("w.*, pupil", "recording_id, w.event_id, w.label, i, pupil"))
def scanpath_labels(spark, sf):
    p = pupil_table(spark, sf)
    return vw.labels_at_samples(_clicks(p), p, 86_400_000, 864_000_000).select("recording_id", "event_id", "label", "i", "pupil")


_FOUR = ("left_x", "left_y", "right_x", "right_y")


@query(
    f"""WITH {_G}, m AS ({" UNION ALL ".join(f"SELECT recording_id, i, '{k}' AS key FROM g WHERE {k}__m" for k in _FOUR)} UNION ALL SELECT recording_id, i, 'any' FROM g WHERE {" OR ".join(f"{k}__m" for k in _FOUR)}),
h AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id, key ORDER BY i) AS island FROM m) SELECT recording_id, key, min(i) AS start_i, max(i) + 1 AS end_i FROM h GROUP BY recording_id, key, island"""
)
def mask_timelines(spark, sf):
    g = gaze_table(spark, sf)
    return vw.mask_timelines(g).unionByName(vw.mask_timelines(g, True)).select("recording_id", "key", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


# --- signals as columns


@query(f"WITH {_G} SELECT recording_id, i, round(2 * left_x, 6) AS twice, left_x__m AS kept_mask, round(right_x - left_x, 6) AS gap, left_x > 30 AS own_mask, false AS fresh_mask FROM g")
def set_signal(spark, sf):
    g = gaze_table(spark, sf)
    out = co.put(g, "left_x", 2 * F.col("left_x"), preserve=True)
    out = co.put(out, "gap", F.col("right_x") - F.col("left_x") / 2, F.col("left_x") > 60)
    out = co.put(out, "fresh", F.col("right_y"))
    return out.select("recording_id", "i", r6("left_x", "twice"), F.col("left_x__m").alias("kept_mask"), r6("gap", "gap"), F.col("gap__m").alias("own_mask"), F.col("fresh__m").alias("fresh_mask"))


@query(f"WITH {_G} SELECT recording_id, i, round(left_x, 6) AS left_x, left_y > 20 AS masked FROM g")
def set_mask(spark, sf):
    g = co.put_mask(gaze_table(spark, sf), "left_x", F.col("left_y") > 20)
    return g.select("recording_id", "i", r6("left_x", "left_x"), F.col("left_x__m").alias("masked"))


@query(f"WITH {_G} SELECT recording_id, i, 2.0 * i AS t_ms, round(left_x, 6) AS left_x, left_x__m, round(left_y, 6) AS left_y, left_y__m FROM g")
def one_eye(spark, sf):
    return co.of_eye(gaze_table(spark, sf), "left").withColumns({"left_x": F.round("left_x", 6), "left_y": F.round("left_y", 6)})


@query(f"WITH {_G} SELECT recording_id, i, 2.0 * i AS t_ms, round(left_x, 6) AS left_x, left_x__m, round(right_x, 6) AS right_x, right_x__m FROM g")
def one_variable(spark, sf):
    g = co.of_variable(gaze_table(spark, sf), "x")
    return g.withColumns({"left_x": F.round("left_x", 6), "right_x": F.round("right_x", 6)})


@query(f"WITH {_G} SELECT recording_id, i, round(left_x, 6) AS left_x, left_x__m FROM g")
def drop_signal(spark, sf):
    g = gaze_table(spark, sf)
    for k in _FOUR[1:]:
        g = co.without(g, k)
    return g.drop("t_ms", "pupil").withColumn("left_x", F.round("left_x", 6))


@query(f"WITH {_P} SELECT recording_id, i, round(t_ms / 60000.0, 3) AS t_min, pupil FROM p")
def set_time(spark, sf):
    p = co.put_time(pupil_table(spark, sf), units.to_unit(F.col("t_ms"), "h") * 60, "min")
    one = co.pupil_of(p.withColumnsRenamed({"pupil": "left_pupil", "pupil__m": "left_pupil__m"}))
    return one.select("recording_id", "i", F.round(units.to_unit(F.col("t_ms"), "minutes"), 3).alias("t_min"), F.col("left_pupil").alias("pupil"))


_COUNTS = ", ".join(f"CAST(sum(CAST({k}__m AS INT)) AS BIGINT) AS {k}" for k in _FOUR)


@query(f"WITH {_G}, c AS (SELECT recording_id, {_COUNTS} FROM g GROUP BY 1) SELECT *, greatest(left_x, left_y, right_x, right_y) AS most FROM c")
def masked_counts(spark, sf):
    return co.masked_counts(gaze_table(spark, sf))


@query(
    f"""WITH {_G}, e AS (SELECT recording_id, count(*) AS n, avg(sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2)) AS m FROM g GROUP BY 1), c AS (SELECT recording_id, {_COUNTS} FROM g GROUP BY 1)
SELECT recording_id, n, CASE WHEN n > 1 THEN 500.0 END AS fs, 2.0 * (n - 1) AS t_max, left_x AS left_x_masked, right_y AS right_y_masked, 'left_x,left_y,right_x,right_y' AS signals, round(m, 6) AS calibration_mean FROM e JOIN c USING (recording_id)"""
)
def summary_gaze(spark, sf):
    errors = cal.error_stats(_validation(spark, sf), "recording_id")
    out = co.summary(gaze_table(spark, sf), errors=errors)
    return out.select("recording_id", "n", "fs", "t_max", "left_x_masked", "right_y_masked", "signals", r6("calibration_mean", "calibration_mean"))


@query(
    f"""WITH {_P}, {_RUNS.format(flag='pupil IS NULL')}, b AS (SELECT recording_id, count(*) AS k FROM runs GROUP BY 1), d AS (SELECT recording_id, t_ms - lag(t_ms) OVER (PARTITION BY recording_id ORDER BY i) AS step FROM p),
f AS (SELECT recording_id, round(1000 / median(step)) AS fs FROM d GROUP BY 1)
SELECT recording_id, any_value(fs) AS fs, count(*) AS n, count(*) FILTER (label = 'click') AS n_events, coalesce(any_value(k), 0) AS n_blinks, CAST(sum(CAST(pupil IS NULL AS INT)) AS BIGINT) AS pupil_masked FROM p JOIN f USING (recording_id) LEFT JOIN b USING (recording_id) GROUP BY 1"""
)
def summary_full(spark, sf):
    p = pupil_table(spark, sf)
    out = co.summary(p, _clicks(p), iv.runs(p, F.col("pupil__m")))
    return out.select("recording_id", "fs", "n", "n_events", "n_blinks", "pupil_masked")


# --- events and stores


@query(f"WITH {_P} SELECT recording_id, count(*) AS n_events FROM p WHERE label = 'click' GROUP BY 1")
def n_events(spark, sf):
    return es.count(_clicks(pupil_table(spark, sf)))


@query(f"WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_ms, event_id) - 1 AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM p) SELECT recording_id, event_id FROM k WHERE k IN (0, 5) OR (k >= n - 3 AND k < n - 1)")
def event_pick(spark, sf):
    p = pupil_table(spark, sf)
    return es.pick(p, [0, 5]).union(es.take(p, -3, -1)).select("recording_id", "event_id").distinct()


@query(f"WITH {_P}, b AS (SELECT recording_id, max(t_ms) AS hi FROM p GROUP BY 1) SELECT recording_id, event_id FROM p JOIN b USING (recording_id) WHERE label = 'click' AND t_ms + 259200000 > hi")
def events_outside(spark, sf):
    p = pupil_table(spark, sf)
    late = _clicks(p).withColumn("t_ms", F.col("t_ms") + 259_200_000)
    return es.outside(late, p).select("recording_id", "event_id")


@query(f"WITH {_P} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY t_ms, label) - 1 AS event_id, label, round(t_ms, 3) AS t_ms FROM p WHERE label <> 'view'")
def events_replaced(spark, sf):
    p = pupil_table(spark, sf)
    # the trip through hours may leave the recording by a rounding error at its ends
    t = F.least(F.col("t_ms"), F.max("t_ms").over(sm.by()) - 1e-3)
    new = p.withColumn("t", units.to_unit(t, "h")).filter("label <> 'view'").select("recording_id", "label", "t")
    return es.replaced(new, p, "h").withColumn("t_ms", F.round("t_ms", 2))


SQL["events_replaced"] = f"WITH {_P}, m AS (SELECT *, max(t_ms) OVER (PARTITION BY recording_id) - 0.001 AS top FROM p) SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY least(t_ms, top), label) - 1 AS event_id, label, round(least(t_ms, top), 2) AS t_ms FROM m WHERE label <> 'view'"


def _store(p: DataFrame) -> DataFrame:
    found = iv.runs(p, F.col("pupil__m"))
    store = st.put(None, found, "left")
    store = st.put(store, found.filter("end - start > 1"), "right")
    store = st.put(store, found, "right", kind=st.RECONSTRUCTED)
    return st.put(store, found.filter("start > 5"), "left")


_STORE = f"WITH {_P}, {_RUNS.format(flag='pupil IS NULL')}, st AS (SELECT recording_id, 'blinks' AS kind, 'left' AS eye, s, e FROM runs WHERE s > 5 UNION ALL SELECT recording_id, 'blinks', 'right', s, e FROM runs WHERE e - s > 1 UNION ALL SELECT recording_id, 'interpolated_blinks', 'right', s, e FROM runs)"


@query(f"{_STORE} SELECT recording_id, kind, eye, round(1000.0 * s, 3) AS start_ms, round(1000.0 * e, 3) AS end_ms FROM st WHERE kind = 'blinks' OR eye = 'right'")
def blinks_stored(spark, sf):
    p = pupil_table(spark, sf)
    rates = p.select("recording_id").distinct().withColumns({"fs": F.lit(1.0), "t0": F.lit(0.0)})
    both = st.get(_store(p), unit="ms", rates=rates).unionByName(st.get(_store(p), ["right"], ["pupil"], st.RECONSTRUCTED, "ms", rates))
    return both.select("recording_id", "kind", "eye", F.round("start", 3).alias("start_ms"), F.round("end", 3).alias("end_ms"))


@query(f"{_STORE} SELECT recording_id, eye, 'pupil' AS variable, count(*) AS n FROM st WHERE kind = 'blinks' GROUP BY 1, 2")
def blink_counts(spark, sf):
    return st.count(_store(pupil_table(spark, sf)))


@query(f"{_STORE} SELECT recording_id, i, EXISTS (SELECT 1 FROM st WHERE st.recording_id = p.recording_id AND kind = 'blinks' AND eye = 'left' AND p.i >= s AND p.i < e) AS left_masked, EXISTS (SELECT 1 FROM st WHERE st.recording_id = p.recording_id AND kind = 'blinks' AND eye = 'right' AND p.i >= s AND p.i < e) AS right_masked FROM p")
def blinks_masked(spark, sf):
    p = pupil_table(spark, sf)
    two = p.select("recording_id", "i", *[c.alias(n) for e in ("left", "right") for c, n in ((F.col("pupil"), f"{e}_pupil"), (F.lit(False), f"{e}_pupil__m"))])
    return st.masked(two, _store(p)).select("recording_id", "i", F.col("left_pupil__m").alias("left_masked"), F.col("right_pupil__m").alias("right_masked"))


@query(f"{_STORE}, n AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1) SELECT recording_id, kind, eye, greatest(0.0, s - 3.0) AS start_i, least(n, e + 4.0) AS end_i FROM st JOIN n USING (recording_id)")
def blink_windows(spark, sf):
    p = pupil_table(spark, sf)
    return vw.blink_windows(_store(p), p, 3, 4).select("recording_id", "kind", "eye", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(f"WITH {_G} SELECT recording_id, i, 'left' AS eye, 'x' AS variable, round(left_x, 6) AS value, left_x__m AS masked FROM g UNION ALL SELECT recording_id, i, 'right', 'y', round(right_y, 6), right_y__m FROM g")
def signals_looked_up(spark, sf):
    wanted = spark.createDataFrame([("left", "x"), ("right", "y")], "eye string, variable string")
    return st.looked_up(gaze_table(spark, sf), wanted).withColumn("value", F.round("value", 6))


# --- more of intervals, epochs and gaze


@query(f"WITH {_P}, n AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1), k AS (SELECT p.recording_id, event_id, label, n, (SELECT min(q.i) FROM p q WHERE q.recording_id = p.recording_id AND q.t_ms = p.t_ms) AS i FROM p JOIN n USING (recording_id)) SELECT recording_id, event_id, i AS onset, greatest(0, i - 3) AS start_i, least(n, i + 5) AS end_i FROM k WHERE label = 'click'")
def intervals_around_samples(spark, sf):
    p = pupil_table(spark, sf)
    return iv.around_samples(_clicks(p), p, -3, 5).select("recording_id", "event_id", "onset", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(f"WITH {_P}, {_EV}, k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s, e) AS k FROM iv) SELECT recording_id, round(s / 3600000.0, 6) AS start_h, round((e - s) / 3600000.0, 6) AS duration, 'h' AS units FROM k WHERE k = 2")
def interval_table(spark, sf):
    hours = iv.in_unit(_around(spark, sf), "ms", "h", 1.0)
    return iv.as_table(iv.nth(hours, 1), "hours").select("recording_id", r6("start", "start_h"), r6("duration", "duration"), "units")


@query(
    f"""WITH {_P}, o AS (SELECT recording_id, event_id, i AS i0 FROM p WHERE label = 'click'), k AS (SELECT o.*, unnest(range(-2, 5)) AS k FROM o), e AS (SELECT k.recording_id, k.event_id, k, pupil AS v, pupil IS NULL AS m FROM k LEFT JOIN p ON p.recording_id = k.recording_id AND p.i = i0 + k),
b AS (SELECT *, v - avg(CASE WHEN k >= -2 AND k < 1 THEN v END) OVER (PARTITION BY recording_id, event_id) AS c FROM e) SELECT recording_id, event_id, CAST(k AS BIGINT) AS k, round(c, 6) AS v, m AS masked FROM b"""
)
def erpd_window(spark, sf):
    p = pupil_table(spark, sf)
    cut = ep.cut(p, p.filter("label = 'click'").select("recording_id", "event_id", "i"), "pupil", 2, 4, outside=True)
    return ep.baseline_correct(cut, (-2, 1)).select("recording_id", "event_id", "k", r6("v", "v"), "masked")


@query(_EPOCH + " SELECT recording_id, count(DISTINCT event_id) AS n_epochs, count(DISTINCT k) AS n_points, min(k) AS k_min, max(k) AS k_max, round(100.0 * avg(CAST(v IS NULL AS INT)), 6) AS missing FROM ep GROUP BY 1")
def erpd_summary(spark, sf):
    return ep.summary(epochs(pupil_table(spark, sf), "click")).withColumn("missing", F.round("missing", 6))


@query(_EPOCH + " SELECT k, round(median(v), 6) AS centre, round(stddev_pop(v), 6) AS spread FROM ep GROUP BY k")
def erpd_curve(spark, sf):
    return ep.curve(epochs(pupil_table(spark, sf), "click"), "median", F.stddev_pop).select("k", r6("centre", "centre"), r6("spread", "spread"))


_MASKS = " AND ".join(f"NOT {k}__m" for k in _FOUR)


@query(
    f"""WITH {_G}, d AS (SELECT *, sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) AS dist FROM g), c AS (SELECT *, coalesce(round(dist, 9) > 7, false) AS far FROM d)
SELECT recording_id, i, {", ".join(f"{k}__m OR far AS {k}_masked" for k in _FOUR)}, far OR NOT ({_MASKS}) AS dist_masked, round(dist, 6) AS gap FROM c"""
)
def divergence_masks(spark, sf):
    g = gz.mask_divergences(gaze_table(spark, sf), 7, "pixel", store_as="gap")
    return g.select("recording_id", "i", *[F.col(f"{k}__m").alias(f"{k}_masked") for k in _FOUR], F.col("gap__m").alias("dist_masked"), r6("gap", "gap"))


@query(
    f"""WITH {_G}, d AS (SELECT *, CASE WHEN {_MASKS} THEN sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) END AS dist FROM g), q AS (SELECT recording_id, quantile_cont(dist, 0.9) AS t FROM d GROUP BY 1),
hit AS (SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS island FROM d JOIN q USING (recording_id) WHERE round(dist, 9) > round(t, 9)) SELECT recording_id, min(i) AS start_i, max(i) + 1 AS end_i FROM hit GROUP BY recording_id, island"""
)
def divergence_runs(spark, sf):
    return gz.divergences(gaze_table(spark, sf), 0.9, honour_mask=True).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(
    f"""WITH {_G}, c AS (SELECT *, coalesce((NOT left_x__m AND left_x > 40) OR (NOT left_y__m AND left_y > 40), false) AS lo, coalesce((NOT right_x__m AND right_x > 40) OR (NOT right_y__m AND right_y > 40), false) AS ro FROM g)
SELECT recording_id, i, left_x__m OR lo AS left_x_masked, left_y__m OR lo AS left_y_masked, right_x__m OR ro AS right_x_masked, right_y__m OR ro AS right_y_masked FROM c"""
)
def offscreen_masks(spark, sf):
    g = gz.mask_offscreen(gaze_table(spark, sf), geo.Setup.of(40, 40, 100, 100))
    return g.select("recording_id", "i", *[F.col(f"{k}__m").alias(f"{k}_masked") for k in _FOUR])


@query(f"WITH {_G}, b AS MATERIALIZED (SELECT recording_id, i, left_x, count(*) OVER (PARTITION BY recording_id) AS n FROM g) SELECT b.recording_id, b.i, round(sum(o.left_x) / 4, 6) AS mean FROM b CROSS JOIN (SELECT unnest(range(-2, 2)) AS k) k JOIN b o ON o.recording_id = b.recording_id AND o.i = greatest(0, least(b.n - 1, b.i + k.k)) GROUP BY 1, 2")
def moving_mean(spark, sf):
    return gaze_table(spark, sf).select("recording_id", "i", r6(md.moving_mean("left_x", 4), "mean"))


@query(f"WITH {_P}, {_FILLED} SELECT recording_id, i, round(f, 6) AS pupil FROM filled")
def filled_lines(spark, sf):
    return sm.filled_linear(pupil_table(spark, sf), "pupil", "f").select("recording_id", "i", r6("f", "pupil"))


@query(_smooth_sql("hanning", 6, "center"))
def smooth_ms(spark, sf):
    return sm.smooth_ms(gaze_table(spark, sf), "left_x", 500, 11).select("recording_id", "i", r6("left_x", "smoothed"))


@query(f"WITH {_G} SELECT recording_id, CAST(floor(i / 3) AS BIGINT) AS i, round(avg(left_x), 6) AS left_x, bool_or(left_x__m) AS masked FROM g GROUP BY recording_id, floor(i / 3)")
def downsample_to(spark, sf):
    return sm.downsample_to(gaze_table(spark, sf), ["left_x"], 500, 150).select("recording_id", "i", r6("left_x", "left_x"), F.col("left_x__m").alias("masked"))


@query(f"WITH {_P}, k AS (SELECT * FROM p WHERE i >= 3), s AS (SELECT recording_id, min(t_ms) AS t0 FROM k GROUP BY 1) SELECT recording_id, event_id, round(t_ms - t0, 3) AS t_ms FROM p JOIN s USING (recording_id) WHERE label = 'click'")
def reset_events(spark, sf):
    p = pupil_table(spark, sf)
    return sm.reset_time_with(p.filter("i >= 3"), _clicks(p))[1].select("recording_id", "event_id", F.round("t_ms", 3).alias("t_ms"))


@query("SELECT part.p_partkey AS id, false AS is_url FROM part UNION ALL SELECT page_id + 1000000000, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') FROM pages")
def url_check(spark, sf):
    a = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), is_url_column(F.col("p_name")).alias("is_url"))
    return a.union(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id") + 1_000_000_000, is_url_column(F.col("url"))))


# --- models


_H = "CASE WHEN {t} > 0 THEN pow({t} / {m}, {n}) * exp({n} * (1 - {t} / {m})) ELSE 0 END"


@query(f"WITH {_P}, k AS (SELECT recording_id, i, t_ms / 1000000.0 AS t, 5.0 + i % 7 AS n FROM p) SELECT recording_id, i, round({_H.format(t='t', m='930.0', n='10.1')}, 6) AS h, round({_H.format(t='t', m='500.0', n='n')}, 6) AS h2 FROM k")
def prf_kernel(spark, sf):
    p, t = pupil_table(spark, sf), F.col("t_ms") / 1_000_000.0
    return p.select("recording_id", "i", r6(dn.response_kernel(t), "h"), r6(dn.response_kernel(t, 5.0 + F.col("i") % 7, 500.0), "h2"))


@query(f"WITH {_P}, o AS (SELECT recording_id, event_id, (SELECT min(q.i) FROM p q WHERE q.recording_id = p.recording_id AND q.t_ms = p.t_ms) AS i0 FROM p WHERE label = 'click') SELECT o.recording_id, o.event_id, p.i, round({_H.format(t='((p.i - i0) * 300.0)', m='930.0', n='10.1')}, 6) AS h FROM o JOIN p ON p.recording_id = o.recording_id AND p.i BETWEEN i0 AND i0 + 14")
def design_matrix(spark, sf):
    """One response for each event, sampled as if a sample came every 300 ms."""
    p = pupil_table(spark, sf)
    return md.design_matrix(p, _clicks(p), 1000 / 300, duration=4500).select("recording_id", "event_id", "i", r6("h", "h"))


@query(
    f"""WITH {_G}, k AS (SELECT recording_id, i, (left_x - 25) / 10 AS y, left_x / 60 AS u FROM g) SELECT recording_id, i,
  round(2 * 0.3 * 0.7 / 1.5 * exp(-2 / 1.5 * CASE WHEN y <= 0.5 THEN 0.7 * (0.5 - y) ELSE 0.3 * (y - 0.5) END), 6) AS by_share,
  round(2.0 / (1.7 + 1 / 1.7) * exp(CASE WHEN y <= 0.5 THEN 2.0 / 1.7 * (y - 0.5) ELSE -2.0 * 1.7 * (y - 0.5) END), 6) AS by_kappa,
  round(-ln(1 / u - 1), 6) AS odds, round(ln(u), 6) AS half, round(1 / (1 + exp(-y)) * 3 + 2, 6) AS back, round(4 - exp(y), 6) AS under FROM k"""
)
def densities(spark, sf):
    y, u = (F.col("left_x") - 25) / 10, F.col("left_x") / 60
    return gaze_table(spark, sf).select(
        "recording_id", "i", r6(dn.asymmetric_laplace(y, 0.5, 1.5, 0.3), "by_share"), r6(dn.asymmetric_laplace_kappa(y, 0.5, 2.0, 1.7), "by_kappa"),
        r6(dn.unbounded(u, 0, 1), "odds"), r6(dn.unbounded(u, 0), "half"), r6(dn.bounded(y, 2, 5), "back"), r6(dn.bounded(y, b=4), "under"),
    )


def _with_clicks(spark, sf) -> DataFrame:
    return pupil_table(spark, sf).withColumn("event", F.col("label") == "click")


@query()
def lowpass_filter(spark, sf):
    return md.lowpass(pupil_table(spark, sf), "pupil", 0.1, 1.0)


@query()
def signal_quality(spark, sf):
    return md.quality(pupil_table(spark, sf), "pupil", 100)


@query()
def response_fit(spark, sf):
    """Responses to clicks, on the clock of the table: one hour stands for a millisecond."""
    p = _with_clicks(spark, sf).withColumn("t_ms", F.col("t_ms") / 3_600_000)
    return envelopes.response_weights(p, "pupil")


@query()
def response_baseline(spark, sf):
    p = pupil_table(spark, sf)
    return md.response_baseline(p, _clicks(p), "pupil", 10.0, 2.0, 0.2)


@query()
def baseline_envelope(spark, sf):
    return envelopes.trough_baseline(pupil_table(spark, sf), "pupil", 1.0, 0.2)


@query()
def baseline_spline(spark, sf):
    return splines.asymmetric_baseline(pupil_table(spark, sf), "pupil", rounds=8)


@query()
def baseline_iterated(spark, sf):
    return md.iterated_baseline(_with_clicks(spark, sf), "pupil", 20.0)


def _camera_rows(spark, sf) -> DataFrame:
    g = gaze_table(spark, sf).withColumns({"left_pupil": F.col("pupil"), "left_pupil__m": F.lit(False)})
    return md.foreshortening_rows(g, "left", SETUP, 500.0)


@query()
def foreshortening_fit(spark, sf):
    return md.foreshortening(_camera_rows(spark, sf), SETUP.r, SETUP.d)


@query()
def foreshortening_residuals(spark, sf):
    rows = written(_camera_rows(spark, sf), "camera-rows")
    return md.residuals(rows, md.foreshortening(rows, SETUP.r, SETUP.d), SETUP.r, SETUP.d)


@query()
def fake_fixations(spark, sf):
    return gen.fixations(spark, gaze_table(spark, sf))


@query()
def fake_trials(spark, sf):
    return gen.Simulation("trials", {"n": pupil_table(spark, sf), "ntrials": 10, "fs": 50}).run(spark, seed=5)


__all__ = ["QUERIES", "SQL"]

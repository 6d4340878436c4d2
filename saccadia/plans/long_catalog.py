"""Queries of the operators for long recordings, long intervals and large groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saccadia.functions import units
from saccadia.functions.tables import held, scratch
from saccadia.operators import dyadic, extrema, long, selection, splines
from saccadia.operators import gaze as gz
from saccadia.operators import intervals as iv
from saccadia.operators import samples as sm
from saccadia.operators import stores as st
from saccadia.operators import views as vw
from saccadia.plans.catalog import _G, _MM, _P, _RUNS, SETUP, SQL, _around, _clicks, _out, query, r6
from saccadia.sources.recordings import gaze_table, pupil_table, read_bundle, write_bundle

# --- scans in parts: the rows of the operators whose windows hold a whole recording


@query(SQL["nearest_sample"])
def nearest_sample_long(spark, sf):
    p = pupil_table(spark, sf)
    return long.nearest_index(_clicks(p).withColumn("t_ms", F.col("t_ms") + 3_600_000.0), p).select("recording_id", "event_id", "i")


@query(SQL["interval_merge"])
def interval_merge_long(spark, sf):
    return _out(long.merge(_around(spark, sf)), "parts")


@query(SQL["mask_to_intervals"])
def mask_to_intervals_long(spark, sf):
    return long.runs(pupil_table(spark, sf), F.col("pupil__m")).select("recording_id", F.col("start").alias("start_i"), F.col("end").alias("end_i"))


@query(SQL["filled_lines"])
def filled_lines_long(spark, sf):
    return long.filled_linear(pupil_table(spark, sf), "pupil", "f").select("recording_id", "i", r6("f", "pupil"))


@query(SQL["mask_intervals"])
def mask_intervals_long(spark, sf):
    p = pupil_table(spark, sf).select("recording_id", "i", "t_ms", "pupil", "pupil__m")
    return long.covered(p, _around(spark, sf), "t_ms").select("recording_id", "i", (F.col("pupil__m") | F.col("hit")).alias("masked"))


@query(f"WITH {_P} SELECT recording_id, i, round(t_ms - lag(t_ms) OVER (PARTITION BY recording_id ORDER BY i), 3) AS step_ms FROM p")
def sample_steps_long(spark, sf):
    p = long.indexed(pupil_table(spark, sf).select("recording_id", "event_id", "t_ms"), "t_ms", "event_id")
    return long.steps(p).select("recording_id", "i", F.round("step", 3).alias("step_ms"))


# --- intervals from one sample to a whole recording

_SPANS = f"""WITH {_P}, n AS (SELECT recording_id, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT p.recording_id, event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE i END AS a, CASE WHEN event_id % 50 = 0 THEN n WHEN event_id % 5 = 0 THEN i + 1 ELSE least(n, i + 2 ** (event_id % 12)) END AS b FROM p JOIN n USING (recording_id)),
met AS (SELECT s.recording_id, s.event_id, pupil FROM s JOIN p ON p.recording_id = s.recording_id AND p.i >= a AND p.i < b)"""


def _spans(p):
    n = p.groupBy("recording_id").agg(F.count("*").alias("n"))
    whole, one = F.col("event_id") % 50 == 0, F.col("event_id") % 5 == 0
    end = F.when(whole, F.col("n")).when(one, F.col("i") + 1).otherwise(F.least(F.col("n"), F.col("i") + F.pow(F.lit(2.0), F.col("event_id") % 12).cast("long")))
    return p.join(n, "recording_id").select("recording_id", "event_id", F.when(whole, 0).otherwise(F.col("i")).cast("long").alias("start"), end.alias("end"))


@query(f"{_SPANS} SELECT recording_id, event_id, count(pupil) AS n, round(sum(pupil), 4) AS total, min(pupil) AS low, max(pupil) AS high FROM met GROUP BY ALL")
def span_sums(spark, sf):
    p = pupil_table(spark, sf)
    found = dyadic.interval_sums(p, _spans(p), ["pupil"])
    return found.select("recording_id", "event_id", F.col("pupil_n").cast("long").alias("n"), F.round("pupil_sum", 4).alias("total"), F.col("pupil_min").alias("low"), F.col("pupil_max").alias("high"))


@query(f"{_SPANS} SELECT recording_id, event_id, round(median(pupil), 6) AS median FROM met GROUP BY ALL")
def span_medians(spark, sf):
    p = pupil_table(spark, sf)
    met = dyadic.samples_in(p.select("recording_id", "i", "pupil"), _spans(p))
    return met.groupBy("recording_id", "event_id").agg(r6(F.median("pupil"), "median"))


# --- percentiles


@query(f"WITH {_P} " + " UNION ALL ".join(f"SELECT label, CAST({q} AS DOUBLE) AS q, round(quantile_cont(pupil, {q}), 6) AS value FROM p WHERE pupil IS NOT NULL GROUP BY label" for q in (0.0, 0.05, 0.5, 0.95, 1.0)))
def percentiles_by_label(spark, sf):
    return selection.percentiles(pupil_table(spark, sf), ["label"], "pupil", [0.0, 0.05, 0.5, 0.95, 1.0]).select("label", "q", r6("value", "value"))


@query(f"WITH {_G} " + " UNION ALL ".join(f"SELECT recording_id, CAST({q} AS DOUBLE) AS q, round(quantile_cont(sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2), {q}), 6) AS value FROM g GROUP BY recording_id" for q in (0.5, 0.99)))
def divergence_percentiles(spark, sf):
    d = gaze_table(spark, sf).withColumn("d", F.hypot(F.col("left_x") - F.col("right_x"), F.col("left_y") - F.col("right_y")))
    return selection.percentiles(d, ["recording_id"], "d", [0.5, 0.99]).select("recording_id", "q", r6("value", "value"))


# --- troughs


@query(
    f"""WITH {_G}, n AS (SELECT *, CASE WHEN pupil = lag(pupil) OVER (PARTITION BY recording_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM g),
c AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY i) AS k FROM n),
r AS (SELECT recording_id, k, min(i) AS a, max(i) AS b, any_value(pupil) AS v FROM c GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY k)) WHERE before > v AND after > v),
near AS (SELECT t.recording_id, t.k, max(o.k) FILTER (o.k < t.k) AS lo, min(o.k) FILTER (o.k > t.k) AS hi FROM t LEFT JOIN r o ON o.recording_id = t.recording_id AND o.v < t.v GROUP BY 1, 2),
top AS (SELECT t.recording_id, t.k, any_value(t.a) AS a, any_value(t.b) AS b, any_value(t.v) AS v, max(o.v) FILTER (o.k < t.k) AS l, max(o.v) FILTER (o.k > t.k) AS h
  FROM t JOIN near USING (recording_id, k) JOIN r o ON o.recording_id = t.recording_id AND o.k > coalesce(lo, -1) AND o.k < coalesce(hi, 1e18) GROUP BY 1, 2)
SELECT recording_id, CAST(floor((a + b) / 2) AS BIGINT) AS i, v AS value, round(least(l, h) - v, 6) AS prominence FROM top"""
)
def trough_prominence(spark, sf):
    return extrema.troughs(gaze_table(spark, sf), "pupil").select("recording_id", "i", "value", r6("prominence", "prominence"))


# --- splines

_KNOTS = """ends AS (SELECT recording_id, CAST(min(t) AS DOUBLE) AS lo, CAST(max(t) AS DOUBLE) AS hi, greatest(ceil((max(t) - min(t)) / 1000.0 * 5), 2) AS inn FROM g2 GROUP BY 1),
kn AS (SELECT recording_id, inn, CAST(j AS INT) AS j, lo + (hi - lo) / (inn + 1) * greatest(0, least(inn + 1, j - 3)) AS k FROM ends, range(0, 200) r(j) WHERE j <= inn + 7),
kk AS (SELECT recording_id, inn, j, k, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2, lead(k, 3) OVER w AS k3, lead(k, 4) OVER w AS k4 FROM kn WINDOW w AS (PARTITION BY recording_id ORDER BY j)),
d0 AS (SELECT g2.recording_id, g2.i, g2.t, kk.j, kk.k, kk.k1, kk.k2, kk.k3, kk.k4, CASE WHEN (t >= k AND t < k1) OR (t = k1 AND kk.j = inn + 3) THEN 1.0 ELSE 0.0 END AS b FROM g2 JOIN kk USING (recording_id)),
d1 AS (SELECT *, coalesce((t - k) / nullif(k1 - k, 0) * b, 0) + coalesce((k2 - t) / nullif(k2 - k1, 0) * lead(b) OVER (PARTITION BY recording_id, i ORDER BY j), 0) AS c FROM d0),
d2 AS (SELECT *, coalesce((t - k) / nullif(k2 - k, 0) * c, 0) + coalesce((k3 - t) / nullif(k3 - k1, 0) * lead(c) OVER (PARTITION BY recording_id, i ORDER BY j), 0) AS e FROM d1),
d3 AS (SELECT recording_id, i, j, coalesce((t - k) / nullif(k3 - k, 0) * e, 0) + coalesce((k4 - t) / nullif(k4 - k1, 0) * lead(e) OVER (PARTITION BY recording_id, i ORDER BY j), 0) AS v FROM d2)"""
_EVERY = "g2 AS (SELECT recording_id, i, i * 2.0 AS t FROM g)"


def _knots(g):
    return splines.evenly(g, "t_ms", 5.0)


@query(f"WITH {_G}, {_EVERY}, {_KNOTS} SELECT recording_id, i, j AS basis, round(v, 10) AS value FROM d3 WHERE v > 1e-10")
def spline_basis(spark, sf):
    g = gaze_table(spark, sf)
    return splines.basis(g, _knots(g)).filter("value > 1e-10").select("recording_id", "i", "basis", F.round("value", 10).alias("value"))


@query(
    f"""WITH {_G}, {_EVERY}, {_KNOTS}, {_MM},
a AS (SELECT recording_id, CAST(b AS INT) AS j, avg(pupil) / 1e4 * (1 + 0.01 * b) AS a FROM g JOIN ends USING (recording_id), range(0, 200) r(b) WHERE b <= inn + 3 GROUP BY 1, 2, b),
fit AS (SELECT recording_id, i, sum(v * a) AS size FROM d3 JOIN a USING (recording_id, j) GROUP BY 1, 2),
e AS (SELECT mm.recording_id, mm.pupil / 1e4 AS p, mm.pupil / 1e4 - size * (x * r * sin(th) * cos(ph) + y * r * sin(th) * sin(ph) + d * r * cos(th)) / (sqrt(x * x + y * y + d * d) * r) AS e FROM mm JOIN fit USING (recording_id, i), s),
rough AS (SELECT recording_id, 2.0 * sum((n - a) ** 2) AS r FROM (SELECT *, lead(a) OVER (PARTITION BY recording_id ORDER BY j) AS n FROM a) GROUP BY 1)
SELECT recording_id, count(*) AS n, round(sum(e * e), 6) AS data_loss, round(any_value(r), 6) AS smooth_loss, round(sum(e * e) + any_value(r), 6) AS loss, round(sqrt(avg(e * e)), 6) AS rmse,
  round(1 - sum(e * e) / (var_pop(p) * count(*)), 6) AS r2 FROM e JOIN rough USING (recording_id) GROUP BY 1"""
)
def foreshortening_objective(spark, sf):
    x, y = SETUP.pixels_to_mm(F.col("left_x"), F.col("left_y"))
    g = gaze_table(spark, sf).select("recording_id", "i", "t_ms", x.alias("x"), y.alias("y"), (F.col("pupil") / 1e4).alias("pupil"))
    knots = _knots(g)
    b = F.explode(F.sequence(F.lit(0), F.col("inner") + 3)).alias("basis")
    coef = g.groupBy("recording_id").agg(F.avg("pupil").alias("m")).join(knots, "recording_id").select("recording_id", "m", b).select("recording_id", "basis", (F.col("m") * (1 + 0.01 * F.col("basis"))).alias("a"))
    out = splines.objective(g, coef, knots, 1.4, 0.1, 600.0, SETUP.d, 2.0)
    return out.select("recording_id", "n", *[r6(c, c) for c in ("data_loss", "smooth_loss", "loss", "rmse", "r2")])


# --- storage, slices, levels and subtotals


@query(f"WITH {_P} SELECT recording_id, i, pupil, round(t_ms - lag(t_ms) OVER (PARTITION BY recording_id ORDER BY i), 3) AS step_ms FROM p")
def bundle_in_buckets(spark, sf):
    """Written in buckets, read back, and run through a window without a shuffle."""
    path = held(spark, scratch(spark, "bundle"))
    write_bundle(path, 8, samples=pupil_table(spark, sf).select("recording_id", "i", "t_ms", "pupil"))
    w = Window.partitionBy("recording_id").orderBy("i")
    return read_bundle(spark, path, "samples").select("recording_id", "i", "pupil", F.round(F.col("t_ms") - F.lag("t_ms").over(w), 3).alias("step_ms"))


_SLICED = f"""WITH {_P}, k AS (SELECT recording_id, min(i) AS a, count(*) AS n FROM p WHERE t_ms / 3600000.0 BETWEEN 100 AND 400 GROUP BY 1)"""


@query(f"{_SLICED} SELECT recording_id, event_id, round(t_ms, 6) AS t_ms FROM p JOIN k USING (recording_id) WHERE label = 'click' AND t_ms / 3600000.0 BETWEEN 100 AND 400")
def slice_events(spark, sf):
    p = pupil_table(spark, sf)
    return sm.slice_with(p, _clicks(p), None, 100, 400, units.factor("h"))[1].select("recording_id", "event_id", r6("t_ms", "t_ms"))


@query(f"{_SLICED}, {_RUNS.format(flag='pupil IS NULL')} SELECT recording_id, CAST(greatest(0, s - a) AS DOUBLE) AS start, CAST(least(n, e - a) AS DOUBLE) AS end FROM runs JOIN k USING (recording_id) WHERE least(n, e - a) > greatest(0, s - a)")
def slice_stored(spark, sf):
    p = pupil_table(spark, sf)
    store = st.stored(iv.runs(p, F.col("pupil__m")), "left")
    return sm.slice_with(p, _clicks(p), store, 100, 400, units.factor("h"))[2].select("recording_id", "start", "end")


@query(f"WITH {_G}, {_MM} SELECT g.recording_id, g.i, round(g.pupil * sqrt((((left_x - 40) * 5) ** 2 + ((left_y - 10) * (200.0 / 60)) ** 2) / (d * d) + 1), 4) AS size, left_x__m AS masked FROM g, s")
def foreshortening_corrected(spark, sf):
    g = gaze_table(spark, sf).withColumns({"left_pupil": F.col("pupil"), "left_pupil__m": F.col("left_x__m")})
    out = gz.correct_foreshortening(g, SETUP, ("left",), (40, 10), "size")
    return out.select("recording_id", "i", F.round("left_size", 4).alias("size"), F.col("left_size__m").alias("masked"))


@query(
    f"""WITH {_G}, n AS (SELECT recording_id, count(*) AS n FROM g GROUP BY 1), f(factor) AS (VALUES (5), (50), (500)),
r AS (SELECT g.recording_id, factor, CAST(floor(i / factor) AS BIGINT) AS chunk, i, left_x FROM g JOIN n USING (recording_id) CROSS JOIN f WHERE floor(i / factor) < greatest(1, floor(n / factor))),
a AS (SELECT recording_id, factor, chunk, arg_min(i, (left_x, i)) AS lo, arg_max(i, (left_x, -i)) AS hi FROM r GROUP BY 1, 2, 3),
e AS (SELECT recording_id, factor, chunk, CAST(0 AS BIGINT) AS pos, least(lo, hi) AS i FROM a UNION ALL SELECT recording_id, factor, chunk, CAST(1 AS BIGINT), greatest(lo, hi) FROM a)
SELECT recording_id, factor, chunk, pos, CAST(i * 2.0 AS DOUBLE) AS t_ms, CASE WHEN NOT left_x__m THEN left_x END AS normal, CASE WHEN left_x__m THEN left_x END AS masked FROM e JOIN g USING (recording_id, i)"""
)
def lod_pyramid(spark, sf):
    return vw.pyramid(gaze_table(spark, sf), "left_x", (5, 50, 500))


_TOTALS = "count(pupil) AS n, round(sum(pupil), 3) AS sum, min(pupil) AS min, max(pupil) AS max"


@query(f"WITH {_P} SELECT label, recording_id, CAST(grouping(label, recording_id) AS BIGINT) AS grouping, {_TOTALS} FROM p GROUP BY ROLLUP (label, recording_id)")
def subtotals_by_label(spark, sf):
    out = iv.subtotals(pupil_table(spark, sf), ["label", "recording_id"], "pupil", ("n", "sum", "min", "max"))
    return out.withColumns({"sum": F.round("sum", 3), "grouping": F.col("grouping").cast("long")})


@query(f"WITH {_P} SELECT label, masked, CAST(grouping(label, masked) AS BIGINT) AS grouping, {_TOTALS} FROM (SELECT *, pupil IS NULL AS masked FROM p) GROUP BY CUBE (label, masked)")
def subtotals_crossed(spark, sf):
    p = pupil_table(spark, sf).withColumnRenamed("pupil__m", "masked")
    out = iv.subtotals(p, ["label", "masked"], "pupil", ("n", "sum", "min", "max"), cross=True)
    return out.withColumns({"sum": F.round("sum", 3), "grouping": F.col("grouping").cast("long")})

"""Readers and writers: eye-tracker text files, Parquet bundles, studies, test tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saccadia.operators.samples import indexed, ingest, mask_of

SIGNALS = ["left_x", "left_y", "left_pupil", "right_x", "right_y", "right_pupil"]
#: Parts of messages that the tracker itself writes; events with one of them are no events of the experiment. Fixed values.
TRACKER_MESSAGES = (
    "!CAL", "VALIDATE", "RECCFG", "GAZE_COORDS", "ELCL_WINDOW_SIZES", "CAMERA_LENS_FOCAL_LENGTH", "ELCL_PROC", "!MODE", "ELCLCFG", "THRESHOLDS", "ELCL_PCR_PARAM",
)


def is_url(text: str) -> bool:
    """Whether a text names a scheme and a host."""
    parts = urlparse(str(text))
    return bool(parts.scheme and parts.netloc)


def is_url_column(text: Column) -> Column:
    """is_url over a column; null counts as no."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def read_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated time and six signals, '   .' for missing; recording_id is the file's path."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in ("time", *SIGNALS))).option("sep", "\t").csv(path)
    cols = [F.expr(f"try_cast(trim({c}) as double)").alias(c) for c in SIGNALS]
    df = raw.select(F.col("_metadata.file_path").alias("recording_id"), F.expr("try_cast(trim(time) as double)").alias("t_ms"), *cols).filter("t_ms is not null")
    return ingest(indexed(df, "t_ms"), SIGNALS)


def read_messages(spark: SparkSession, path: str, after: str = "experiment_start", drop: tuple[str, ...] = ()) -> DataFrame:
    """Events of MSG lines behind the first one that holds `after` (all lines where none does): recording_id, event_id, t_ms, label.

    The label is the line's third word. `drop` leaves out labels with one of the parts. Lines keep
    the order of the file through their place in it, so lines of one time as the first stay too.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("recording_id"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    msg = lines.filter(F.col("value").startswith("MSG")).select("recording_id", "at", F.split(F.trim("value"), r"\s+").alias("w"), F.col("value").contains(after).alias("_start"))
    start = F.coalesce(F.min(F.when(F.col("_start"), F.col("at"))).over(Window.partitionBy("recording_id")), F.lit(-1))
    rows = msg.withColumn("_first", start).filter("at > _first").select("recording_id", "at", F.expr("try_cast(w[1] as double)").alias("t_ms"), F.get("w", F.lit(2)).alias("label")).filter("t_ms is not null and label is not null")
    event = (F.row_number().over(Window.partitionBy("recording_id").orderBy("at")) - 1).cast("long")
    return without_tracker_messages(rows.withColumn("event_id", event).select("recording_id", "event_id", "t_ms", "label"), drop)


def without_tracker_messages(events: DataFrame, parts: tuple[str, ...] = TRACKER_MESSAGES) -> DataFrame:
    for x in parts:
        events = events.filter(~F.col("label").contains(x))
    return events


def from_tracker(spark: SparkSession, record: dict, name: str, keep_tracker_messages: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, events, validation points) of one recording in the form that tracker-file readers give.

    record: 'times' in seconds, 'samples' as one sequence for each of info['sample_fields'] (xpos, ypos, ps,
    with _left and _right for both eyes, else of info['eye'], left if it isn't named), 'discrete' with messages
    (stime in seconds, msg), info['calibrations'] with (eye, validation rows of point_x, point_y, offset, diff_x,
    diff_y), of which the last of an eye counts.
    """
    info, fields = record["info"], list(record["info"]["sample_fields"])
    tracked = str(info.get("eye", "left")).lower()
    sides = {"left": "_left", "right": "_right"} if "xpos_left" in fields or "xpos_right" in fields else {tracked if tracked in ("left", "right") else "left": ""}
    cols = {f"{eye}_{v}": record["samples"][fields.index(f + end)] for eye, end in sides.items() for v, f in (("x", "xpos"), ("y", "ypos"), ("pupil", "ps")) if all(g + end in fields for g in ("xpos", "ypos", "ps"))}
    frame = pd.DataFrame({"recording_id": name, "t_ms": np.asarray(record["times"], float) * 1000, **{k: np.asarray(v, float) for k, v in cols.items()}})
    samples = ingest(indexed(spark.createDataFrame(frame), "t_ms"), list(cols))
    msg = record["discrete"]["messages"]
    said = [x.decode() if isinstance(x, bytes) else str(x) for x in msg["msg"]]
    rows = [(name, k, float(t) * 1000, m) for k, (t, m) in enumerate(zip(msg["stime"], said, strict=True))]
    events = spark.createDataFrame(rows, "recording_id string, event_id long, t_ms double, label string")
    last = {str(c.get("eye", "unknown")).lower(): c["validation"] for c in info.get("calibrations", [])}
    names = ("point_x", "point_y", "offset", "diff_x", "diff_y")
    points = [(name, eye, k, *(float(v) for v in row)) for eye, table in last.items() for k, row in enumerate(table)]
    validation = spark.createDataFrame(points, "recording_id string, eye string, i long, " + ", ".join(f"{n} double" for n in names))
    return samples, events if keep_tracker_messages else without_tracker_messages(events), validation


def read_validations(spark: SparkSession, path: str) -> DataFrame:
    """Validation points out of tracker text files: recording_id, eye, i, point_x, point_y, offset, diff_x, diff_y.

    A line 'MSG t VALIDATE eye POINT k EYE at x,y OFFSET o deg. dx,dy pix.' is one point; of the
    validations of an eye the last one with a point counts.
    """
    number = r"(-?[0-9.]+)"
    form = rf"VALIDATE .*POINT\s+([0-9]+)\s+(LEFT|RIGHT)\s+at\s+{number},\s*{number}\s+OFFSET\s+{number}\s+deg\.\s+{number},\s*{number}"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("recording_id"), F.monotonically_increasing_id().alias("at"), "value").filter(F.col("value").rlike(form))
    part = lambda k: F.regexp_extract("value", form, k)
    rows = lines.select("recording_id", "at", F.lower(part(2)).alias("eye"), part(1).cast("long").alias("i"), *[part(k).cast("double").alias(c) for k, c in ((3, "point_x"), (4, "point_y"), (5, "offset"), (6, "diff_x"), (7, "diff_y"))])
    # a validation begins where the number of the point doesn't rise
    w = Window.partitionBy("recording_id", "eye").orderBy("at")
    turn = F.sum(F.coalesce((F.col("i") <= F.lag("i").over(w)).cast("int"), F.lit(0))).over(w)
    rows = rows.withColumn("turn", turn)
    return rows.withColumn("last", F.max("turn").over(Window.partitionBy("recording_id", "eye"))).filter("turn = last").drop("turn", "last", "at")


def read_tracker_events(spark: SparkSession, path: str) -> DataFrame:
    """Fixations, saccades and blinks (EFIX, ESACC, EBLINK lines): kind, eye, start, end, values."""
    w = spark.read.text(path).select(F.col("_metadata.file_path").alias("recording_id"), F.split(F.trim("value"), r"\s+").alias("w"))
    kinds = w.filter(F.get("w", F.lit(0)).isin("EFIX", "ESACC", "EBLINK"))
    rest = F.transform(F.slice("w", 6, 20), lambda v: v.try_cast("double"))
    return kinds.select("recording_id", F.substring(F.col("w")[0], 2, 10).alias("kind"), F.col("w")[1].alias("eye"), F.col("w")[2].try_cast("double").alias("start"), F.col("w")[3].try_cast("double").alias("end"), rest.alias("values"))


def write_bundle(path: str, buckets: int = 0, sort: str = "i", **tables: DataFrame) -> None:
    """Each table as Parquet under path/name.

    With `buckets`, tables that have recording_id are dealt into that many files by it, each
    sorted by recording and `sort`: what is read back needs no shuffle for windows and joins
    by recording, and a recording is found in one file. How a table is laid out is written
    beside it. A recording is in one file, whatever its length.
    """
    for name, df in tables.items():
        keys = [k for k in ("recording_id", sort) if k in df.columns] if buckets and "recording_id" in df.columns else []
        spark, to = df.sparkSession, f"{path}/{name}"
        if keys:
            table = f"bundle_{uuid.uuid4().hex}"
            df.repartition(buckets, "recording_id").write.mode("overwrite").bucketBy(buckets, "recording_id").sortBy(*keys).option("path", to).saveAsTable(table)
            spark.sql(f"DROP TABLE {table}")  # the name; the files stay
        else:
            df.write.mode("overwrite").parquet(to)
        layout = json.dumps({"schema": df.schema.jsonValue(), "buckets": buckets if keys else 0, "sorted": keys})
        spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}.layout")


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of write_bundle; a bucketed one comes with its buckets and their order."""
    layout = json.loads(spark.read.text(f"{path}/{name}.layout").first()["value"])
    if not layout["buckets"]:
        return spark.read.schema(StructType.fromJson(layout["schema"])).parquet(f"{path}/{name}")
    table = f"bundle_{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}/{name}#{json.dumps(layout)}').hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(layout["schema"]))
    by = ", ".join(f"`{k}`" for k in layout["sorted"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (recording_id) SORTED BY ({by}) INTO {layout['buckets']} BUCKETS LOCATION '{path}/{name}'")
    # one file a bucket: its order counts as the rows' order
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(table)


def study_paths(spark: SparkSession, config: str, kind: str, subjects: list[str] | None = None) -> dict[str, str]:
    """path of the `kind` of file by subject, from a JSON config {'raw_data': {subject: {kind: path}}}; unknown subjects are skipped."""
    text = "\n".join(r["value"] for r in spark.read.text(config).collect())
    found = json.loads(text)["raw_data"]
    return {s: found[s][kind] for s in (found if subjects is None else subjects) if s in found and kind in found[s]}


def read_study(spark: SparkSession, config: str, subjects: list[str] | None = None, reader: Callable[..., DataFrame] | None = None, kind: str = "samples") -> DataFrame:
    """Samples (or what `reader(spark, paths)` gives) of a study's subjects, recording_id being the subject.

    All files are one scan, whose rows find their subject by an equality join on the file's path; without a
    subject the result is empty. A file that two subjects name belongs to both.
    """
    paths = study_paths(spark, config, kind, subjects)
    reader = reader or read_samples
    # a path without a scheme is a local one, whose rows come back as file:///...
    full = [(s, p if ":/" in p else os.path.abspath(p)) for s, p in paths.items()]
    if not full:
        return reader(spark, [config]).filter("false")
    names = spark.createDataFrame(full, "subject string, path string")
    rows = reader(spark, sorted({p for _, p in full})).withColumn("_path", F.regexp_replace("recording_id", "^file:/+", "/"))
    return rows.join(names, F.col("_path") == F.col("path")).withColumn("recording_id", F.col("subject")).drop("_path", "path", "subject")


def pupil_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as pupil recordings: a user is a recording; a value under 10 is missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").alias("recording_id"), "event_id", F.col("event_type").alias("label"), us.alias("us"), "value")
    rows = rows.withColumn("t_ms", (F.col("us") - F.min("us").over(Window.partitionBy("recording_id"))) / 1000.0)
    rows = indexed(rows, "us", "event_id").drop("us")
    return rows.withColumn("pupil", F.when(F.col("value") >= 10, F.col("value"))).withColumn(mask_of("pupil"), F.col("pupil").isNull()).drop("value")


def gaze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as binocular gaze: a supplier is a recording; rightmost and steep values are masked."""
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = g.select(
        F.col("l_suppkey").alias("recording_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("left_x"), (F.col("l_extendedprice") / 2100).alias("left_y"),
        (F.col("l_quantity") + F.col("l_discount") * 10).alias("right_x"), (F.col("l_extendedprice") / 2100 + F.col("l_tax") * 10).alias("right_y"), F.col("l_extendedprice").alias("pupil"),
    )
    rows = indexed(rows, "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate", "l_orderkey", "l_linenumber")
    rows = rows.withColumn("t_ms", F.col("i") * 2.0)
    return rows.withColumns({mask_of("left_x"): F.col("left_x") > 48, mask_of("right_x"): F.col("right_x") > 50, mask_of("left_y"): F.col("left_y") > 45, mask_of("right_y"): F.col("right_y") > 45})

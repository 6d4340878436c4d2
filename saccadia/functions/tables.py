"""Written tables in the folder that a cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the folder that the cluster shares.

    spark.checkpoint.dir names that folder. Only where it is unset and the master is one
    machine (tests) a temporary folder takes its place and becomes the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Spark's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_KEPT: set[str] = set()


def held(spark: SparkSession, path: str) -> str:
    """The path, which goes when the driver's Python ends."""
    if not _KEPT:
        atexit.register(_clean, spark)
    _KEPT.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives executors.

    The table goes with `released`, or else when the driver's Python ends, as lazy results
    may read it till then.
    """
    spark, path = df.sparkSession, held(df.sparkSession, scratch(df.sparkSession, name))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _clean(spark: SparkSession) -> None:
    for path in list(_KEPT):
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before
            return


def released(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.scratch_path)
        _KEPT.discard(t.scratch_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it till no column of df clashes."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out

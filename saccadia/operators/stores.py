"""Stored intervals of signals, such as blinks: (recording_id, kind, eye, variable, start, end) in sample indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.operators import columns
from saccadia.operators import intervals as iv
from saccadia.operators.samples import mask_of

BLINKS, RECONSTRUCTED = "blinks", "interpolated_blinks"
_KEYS = ["recording_id", "kind", "eye", "variable", "start", "end"]


def stored(found: DataFrame, eye: str, variable: str = "pupil", kind: str = BLINKS) -> DataFrame:
    """Intervals as rows of a store."""
    return found.select("recording_id", F.lit(kind).alias("kind"), F.lit(eye).alias("eye"), F.lit(variable).alias("variable"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


def put(store: DataFrame | None, found: DataFrame, eye: str, variable: str = "pupil", kind: str = BLINKS) -> DataFrame:
    """The store with the intervals of one kind and signal replaced."""
    new = stored(found, eye, variable, kind)
    if store is None:
        return new
    same = (F.col("kind") == kind) & (F.col("eye") == eye) & (F.col("variable") == variable)
    return store.select(*_KEYS).filter(~same).unionByName(new)


def get(store: DataFrame, eyes: list[str] | None = None, variables: list[str] | None = None, kind: str = BLINKS, unit: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Stored intervals of some eyes and variables (none named: all) in sample indices, or in `unit` by `rates`
    (recording_id, fs, t0): none where nothing is stored."""
    out = store.filter(F.col("kind") == kind)
    if eyes:
        out = out.filter(F.col("eye").isin(eyes))
    if variables:
        out = out.filter(F.col("variable").isin(variables))
    return out if unit is None else iv.in_unit(out.join(rates, "recording_id"), None, unit, F.col("fs"), F.col("t0")).drop("fs", "t0")


def count(store: DataFrame, kind: str = BLINKS) -> DataFrame:
    """recording_id, eye, variable, n for signals that have any."""
    return store.filter(F.col("kind") == kind).groupBy("recording_id", "eye", "variable").agg(F.count("*").alias("n"))


def masked(df: DataFrame, store: DataFrame, kind: str = BLINKS) -> DataFrame:
    """samples with the masks of the stored signals set inside their intervals; a stored signal that df lacks is left out."""
    for s in columns.signals(df):
        eye, _, variable = s.partition("_")
        df = iv.masked(df, get(store, [eye], [variable], kind).select("recording_id", "start", "end"), [s])
    return df


def looked_up(df: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """Samples in long form (recording_id, i, eye, variable, value, masked) of the wanted (eye, variable) rows.

    A wanted signal that df lacks is an error when the result is read, or left out. The samples are read
    once and stay where they are: the wanted rows, a few, go to them.
    """
    names = columns.matching(df)
    there = F.concat_ws("_", "eye", "variable").isin(names) & F.col("eye").isNotNull() & F.col("variable").isNotNull()
    if strict:
        there = F.when(there, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no signal "), F.concat_ws("_", "eye", "variable"))).cast("boolean"))
    each = [F.struct(F.lit(s).alias("name"), F.col(s).alias("value"), F.col(mask_of(s)).alias("masked")) for s in names]
    long = df.select("recording_id", "i", F.explode(F.array(*each)).alias("s"))
    known = wanted.select("eye", "variable").filter(there).withColumn("name", F.concat_ws("_", "eye", "variable"))
    return long.join(F.broadcast(known), F.col("s.name") == F.col("name")).select("recording_id", "i", "eye", "variable", "s.value", "s.masked")

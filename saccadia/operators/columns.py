"""Signals of samples as columns `<eye>_<variable>` with masks `<eye>_<variable>__m`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.units import from_unit
from saccadia.operators.samples import mask_of, visible

KEYS = ["recording_id", "i", "t_ms"]


def signals(df: DataFrame) -> list[str]:
    """Names of the signals: the columns that have a mask."""
    return sorted(c for c in df.columns if mask_of(c) in df.columns)


def matching(df: DataFrame, eyes: list[str] | None = None, variables: list[str] | None = None) -> list[str]:
    """Signals of the given eyes and variables; none given means all."""
    parts = [(s, *s.split("_", 1)) for s in signals(df) if "_" in s]
    return [s for s, e, v in parts if (not eyes or e in eyes) and (not variables or v in variables)]


def need(df: DataFrame, signal: str) -> str:
    if signal not in signals(df):
        raise KeyError(f"no signal {signal!r}; there are {', '.join(signals(df))}")
    return signal


def put(df: DataFrame, signal: str, value: Column, mask: Column | None = None, preserve: bool = False) -> DataFrame:
    """Sets a signal. Its mask is the given one, or the one it had (`preserve`), or where the value is missing."""
    v = F.nanvl(value.cast("double"), F.lit(None))
    old = F.col(mask_of(signal)) if preserve and mask_of(signal) in df.columns else None
    m = mask if mask is not None else old if old is not None else v.isNull()
    return df.withColumns({signal: v, mask_of(signal): m.cast("boolean")})


def put_mask(df: DataFrame, signal: str, mask: Column) -> DataFrame:
    """Replaces the mask of a signal; a null in it counts as not masked."""
    return df.withColumn(mask_of(need(df, signal)), F.coalesce(mask.cast("boolean"), F.lit(False)))


def put_time(df: DataFrame, value: Column, unit: str = "ms") -> DataFrame:
    return df.withColumn("t_ms", from_unit(value, unit))


def without(df: DataFrame, signal: str) -> DataFrame:
    """Drops a signal with its mask; keys and times can't be dropped."""
    if signal in KEYS:
        raise ValueError(f"{signal} is no signal")
    return df.drop(need(df, signal), mask_of(signal))


def only(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[c for c in KEYS if c in df.columns], *[x for s in keep for x in (need(df, s), mask_of(s))])


def of_eye(df: DataFrame, eye: str) -> DataFrame:
    """The signals of one eye, masks as they are."""
    return only(df, matching(df, [eye]))


def of_variable(df: DataFrame, variable: str) -> DataFrame:
    """One variable of all eyes, masks as they are."""
    return only(df, matching(df, None, [variable]))


def pupil_of(df: DataFrame, eye: str | None = None) -> DataFrame:
    """The pupil of one eye, or of the only one that has it."""
    found = matching(df, [eye] if eye else None, ["pupil"])
    if len(found) != 1:
        raise ValueError(f"name the eye; there are {found}")
    return only(df, found)


def mask(df: DataFrame, signal: str | None = None) -> Column:
    """The mask of a signal, or whether any signal is masked."""
    return F.col(mask_of(need(df, signal))) if signal else reduce(lambda a, b: a | b, [F.col(mask_of(s)) for s in signals(df)])


def masked_counts(df: DataFrame) -> DataFrame:
    """recording_id, a count for each signal, and `most`, the largest of them."""
    n = {s: F.sum(F.col(mask_of(s)).cast("long")) for s in signals(df)}
    out = df.groupBy("recording_id").agg(*[c.alias(s) for s, c in n.items()])
    return out.withColumn("most", F.greatest(*n) if len(n) > 1 else F.col(next(iter(n))))


def summary(df: DataFrame, events: DataFrame | None = None, blinks: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """A row for each recording: n, fs, t_min, t_max, signals, masked counts, and where given the numbers of
    events and blinks and the calibration errors (recording_id, n, mean, ...)."""
    step = F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("recording_id").orderBy("i"))
    per = [F.sum(F.col(mask_of(s)).cast("long")).alias(f"{s}_masked") for s in signals(df)]
    out = df.withColumn("_step", step).groupBy("recording_id").agg(
        F.count("*").alias("n"), F.round(1000 / F.median("_step")).alias("fs"), F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"), *per
    ).withColumn("signals", F.lit(",".join(signals(df))))
    for name, table in (("n_events", events), ("n_blinks", blinks)):
        if table is not None:
            out = out.join(table.groupBy("recording_id").agg(F.count("*").alias(name)), "recording_id", "left").fillna(0, [name])
    if errors is not None:
        out = out.join(errors.select("recording_id", *[F.col(c).alias(f"calibration_{c}") for c in errors.columns if c != "recording_id"]), "recording_id", "left")
    return out


def value_range(df: DataFrame, signal: str, pad: float = 0.0, honour_mask: bool = True) -> DataFrame:
    """recording_id, lo and hi of a signal, widened on both sides by `pad` of their distance."""
    v = visible(signal) if honour_mask else F.col(signal)
    out = df.groupBy("recording_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    wide = (F.col("hi") - F.col("lo")) * pad
    return out.withColumns({"lo": F.col("lo") - wide, "hi": F.col("hi") + wide})

"""Synthetic recordings with known truth, made in parallel, one a number or one for each recording of a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccadia.functions import kernels as K
from saccadia.functions.geometry import Setup, cos_alpha
from saccadia.operators.samples import mask_of


#: Rows that a task hands on at once.
ROWS = 1 << 17


def _per(spark: SparkSession, n: int | DataFrame, fn, schema: str) -> DataFrame:
    """fn of each recording_id from 0 to n - 1, or of those (whole numbers) that a DataFrame has.

    A few ids make many rows, so they are dealt out, by no key: by the key of the distinct ids Spark would merge parts again.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if isinstance(n, DataFrame):
        ids = n.select(F.col("recording_id").cast("long").alias("recording_id")).distinct().repartition(parts)
    else:
        ids = spark.range(0, n, 1, max(1, min(n, parts))).withColumnRenamed("id", "recording_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for b in batches:
            for rec in b["recording_id"]:
                made.append(fn(int(rec)))
                if sum(map(len, made)) >= ROWS:
                    yield pd.concat(made)
                    made = []
        if made:
            yield pd.concat(made)

    return ids.mapInPandas(run, schema)


def pupil_baseline(spark: SparkSession, n: int = 4, seconds: float = 20, fs: float = 100, mean: float = 750, amplitude: float = 100, freq: float = 0.5, seed: int = 1) -> DataFrame:
    """Low-pass noise with the given mean and sd."""

    def fn(rec: int) -> pd.DataFrame:
        x = np.random.default_rng([seed, rec]).normal(size=int(seconds * fs))
        y = K.lowpass(x, freq, fs, 4)
        y = mean + amplitude * (y - y.mean()) / y.std()
        return pd.DataFrame({"recording_id": rec, "i": np.arange(len(y)), "t_ms": np.arange(len(y)) * 1000 / fs, "pupil": y})

    return _per(spark, n, fn, "recording_id long, i long, t_ms double, pupil double")


def fixations(spark: SparkSession, n: int | DataFrame = 4, seconds: float = 20, mean_ms: float = 300, sd_ms: float = 100, screen=((0, 1920), (0, 1080)), count: int | None = None, seed: int = 1) -> DataFrame:
    """Fixations with normal durations (50 ms at least), shortened to the time if they fill more of it, at uniform places."""

    def fn(rec: int) -> pd.DataFrame:
        g = np.random.default_rng([seed, rec, 2])
        k = int(seconds * 1000 / mean_ms) + 1 if count is None else count
        d = np.maximum(g.normal(mean_ms, sd_ms, k), 50)
        end = np.cumsum(d * min(1.0, seconds * 1000 / d.sum()))
        return pd.DataFrame({"recording_id": rec, "start": np.concatenate([[0], end[:-1]]), "end": end, "x": g.uniform(*screen[0], k), "y": g.uniform(*screen[1], k)})

    return _per(spark, n, fn, "recording_id long, start double, end double, x double, y double")


def gaze_steps(spark: SparkSession, fs: float = 100, seconds: float = 20, **settings) -> DataFrame:
    """Samples that step from fixation to fixation: recording_id, i, t_ms, x, y; 0 after the last one."""
    f = fixations(spark, seconds=seconds, **settings)
    last = int(seconds * fs)
    whole = f.withColumns({"a": F.floor(F.col("start") * fs / 1000).cast("long"), "b": F.least(F.floor(F.col("end") * fs / 1000).cast("long"), F.lit(last))})
    held = whole.filter("a < b").select("recording_id", F.explode(F.expr("sequence(a, b - 1)")).alias("i"), "x", "y")
    grid = f.select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last - 1).cast("long"))).alias("i"))
    return grid.join(held, ["recording_id", "i"], "left").fillna(0.0, ["x", "y"]).withColumn("t_ms", F.col("i") * (1000 / fs)).select("recording_id", "i", "t_ms", "x", "y")


def foreshortened_recording(
    spark: SparkSession, setup: Setup, n: int = 1, seconds: float = 120, fs: float = 1000, eye: str = "left", mean: float = 750, amplitude: float = 100,
    freq: float = 0.5, mean_ms: float = 500, sd_ms: float = 100, noise: float = 5.0, seed: int = 1,
) -> DataFrame:
    """x, y in pixels and the pupil of one eye as the setup's camera sees it, with the true size A0 and the cosine."""
    a0 = pupil_baseline(spark, n, seconds, fs, mean, amplitude, freq, seed).withColumnRenamed("pupil", f"{eye}_A0")
    xy = gaze_steps(spark, fs, seconds, n=n, mean_ms=mean_ms, sd_ms=sd_ms, screen=((0, setup.width), (0, setup.height)), seed=seed + 1).drop("t_ms")
    mx, my = setup.pixels_to_mm(F.col("x"), F.col("y"))
    cos = cos_alpha(mx, my, setup.theta, setup.phi, setup.r, setup.d)
    out = a0.join(xy, ["recording_id", "i"]).withColumn(f"{eye}_cosalpha", cos).withColumn(f"{eye}_pupil", F.col(f"{eye}_A0") * F.col(f"{eye}_cosalpha"))
    out = out.withColumnsRenamed({"x": f"{eye}_x", "y": f"{eye}_y"})
    out = with_noise(out, f"{eye}_pupil", noise, seed + 2) if noise > 0 else out
    return out.withColumns({mask_of(f"{eye}_{v}"): F.lit(False) for v in ("x", "y", "pupil")})


def foreshortened(spark: SparkSession, n: int = 2, seconds: float = 30, fs: float = 50, theta: float = 1.48, phi: float = 0.087, r: float = 600, d: float = 700, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """x, y in mm, true size, and the pupil as a camera at (r, theta, phi) sees it."""

    def fn(rec: int) -> pd.DataFrame:
        g = np.random.default_rng([seed, rec])
        t = np.arange(int(seconds * fs)) * 1000 / fs
        size = 3.5 + 0.3 * np.sin(2 * np.pi * t / 10000)
        hold = np.minimum((t / 400).astype(int), 10_000)
        x, y = g.uniform(-260, 260, hold.max() + 1)[hold], g.uniform(-145, 145, hold.max() + 1)[hold]
        cx, cy, cz = r * np.sin(theta) * np.cos(phi), r * np.sin(theta) * np.sin(phi), r * np.cos(theta)
        cos = (x * cx + y * cy + d * cz) / (np.sqrt(x * x + y * y + d * d) * r)
        return pd.DataFrame({"recording_id": rec, "i": np.arange(len(t)), "t_ms": t, "x": x, "y": y, "truth": size, "pupil": size * cos + g.normal(0, noise, len(t))})

    return _per(spark, n, fn, "recording_id long, i long, t_ms double, x double, y double, truth double, pupil double")


def _positive_normal(g, mean: float, sd: float, n: int) -> np.ndarray:
    """n draws of a normal distribution cut at 0."""
    out = np.full(n, -1.0)
    while (low := out < 0).any():
        out[low] = g.normal(mean, sd, low.sum()) if sd > 0 else abs(mean)
    return out


def pupil_responses(
    spark: SparkSession, n: int | DataFrame = 2, trials: int = 8, isi: float = 2500, fs: float = 20, noise: float = 0.01, seed: int = 3, pad: float = 5000, baseline_freq: float | None = None,
    weight=(1.0, 0.2), npar=(10.1, 0.0), tmax=(930.0, 0.0), spurious: int = 0, response_times: tuple[float, float] | None = None, scale=(5.0, 1.0),
) -> DataFrame:
    """Baseline, responses of known weight to each event, responses to `spurious` hidden ones, and noise; `event` marks samples.

    weight, npar and tmax are means and sds; weights are cut at 0. The baseline is level, or low-pass noise of
    unit sd. With `response_times` (mean, sd, cut at 0) each trial has a second event. Columns: pupil, baseline,
    event, weight (of the sample's events).
    """

    def fn(rec: int) -> pd.DataFrame:
        g = np.random.default_rng([seed, rec])
        on = np.arange(1, trials + 1) * isi
        if response_times is not None:
            on = np.sort(np.concatenate([on, on + _positive_normal(g, *response_times, trials)]))
        lasting = K.kernel_duration(max(npar[0] - 3 * npar[1], 1.0), tmax[0] + 3 * tmax[1])
        t = np.arange(int((on.max(initial=0.0) + lasting + pad) * fs / 1000)) * 1000 / fs
        hidden = g.uniform(0, on.max(initial=1.0), spurious)
        every = np.concatenate([on, hidden])
        w = _positive_normal(g, *weight, len(every))
        a, b = (np.maximum(g.normal(m, s, len(every)), 1e-3) if s > 0 else np.full(len(every), m) for m, s in (npar, tmax))
        base = np.zeros(len(t))
        if baseline_freq is not None:
            slack = len(t) // 2
            base = K.lowpass(g.random(len(t) + slack), baseline_freq, fs, 2)[slack:]
            base = (base - base.mean()) / base.std()
        y = base.copy()
        for o, c, p, m in zip(every, w, a, b, strict=True):
            k = slice(*np.searchsorted(t, [o, o + lasting]))
            y[k] += c * K.pupil_kernel(t[k] - o, p, m)
        y = (y + g.normal(0, noise, len(t))) * scale[1] + scale[0]
        at = np.minimum(np.round(on * fs / 1000).astype(int), len(t) - 1)
        event, total = np.zeros(len(t), bool), np.zeros(len(t))
        event[at] = True
        np.add.at(total, at, w[: len(on)])
        return pd.DataFrame({"recording_id": rec, "i": np.arange(len(t)), "t_ms": t, "pupil": y, "baseline": base * scale[1] + scale[0], "event": event, "weight": total})

    return _per(spark, n, fn, "recording_id long, i long, t_ms double, pupil double, baseline double, event boolean, weight double")


def trials(spark: SparkSession, n: int | DataFrame = 1, ntrials: int = 100, isi: float = 2000, response_times=(1000.0, 500.0), fs: float = 1000, **settings) -> DataFrame:
    """pupil_responses with a stimulus every `isi` ms and a response to each."""
    return pupil_responses(spark, n, ntrials, isi, fs, response_times=response_times, baseline_freq=settings.pop("baseline_freq", 0.2), **settings)


def with_noise(df: DataFrame, signal: str, sd: float, seed: int = 1) -> DataFrame:
    return df.withColumn(signal, F.col(signal) + F.randn(seed) * sd)


#: Generators by name, so that a recording's settings can be kept and run again.
GENERATORS = {f.__name__: f for f in (pupil_baseline, fixations, gaze_steps, foreshortened, foreshortened_recording, pupil_responses, trials)}


@dataclass(frozen=True)
class Simulation:
    """A generator's name and settings: what to write beside a simulated recording."""

    generator: str
    settings: dict

    def run(self, spark: SparkSession, **changes) -> DataFrame:
        """The recording again, with some settings changed."""
        return GENERATORS[self.generator](spark, **(self.settings | changes))

    def call(self) -> str:
        return f"{self.generator}({', '.join(f'{k}={v!r}' for k, v in self.settings.items())})"

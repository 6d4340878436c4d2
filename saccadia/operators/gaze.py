"""Gaze: the distance between the eyes, points off the screen, and their masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.geometry import Setup, in_rectangle
from saccadia.operators.intervals import runs
from saccadia.operators.samples import by, mask_of, visible

BOTH = ["left_x", "left_y", "right_x", "right_y"]


def eye_distance(df: DataFrame, out: str = "dist", honour_mask: bool = False) -> DataFrame:
    """Adds the distance between both eyes' points in pixels; null where one is missing."""
    if missing := [s for s in BOTH if s not in df.columns]:
        raise ValueError(f"both eyes are needed; missing: {missing}")
    v = {s: visible(s) if honour_mask else F.col(s) for s in BOTH}
    return df.withColumn(out, F.sqrt((v["left_x"] - v["right_x"]) ** 2 + (v["left_y"] - v["right_y"]) ** 2))


def divergent(df: DataFrame, threshold: float = 0.99, kind: str = "percentile", honour_mask: bool = False, out: str = "diverged", dist: str = "dist") -> DataFrame:
    """Adds the distance and whether it is over `threshold` pixels, or over that quantile of its recording's distances."""
    if kind not in ("percentile", "pixel"):
        raise ValueError("kind is 'percentile' or 'pixel'")
    if kind == "percentile" and not 0 <= threshold <= 1:
        raise ValueError("a quantile is between 0 and 1")
    df = eye_distance(df, dist, honour_mask)
    limit = F.lit(float(threshold)) if kind == "pixel" else F.percentile(dist, threshold).over(by())
    return df.withColumn(out, F.coalesce(F.round(dist, 9) > F.round(limit, 9), F.lit(False)))


def mask_divergences(df: DataFrame, threshold: float = 0.99, kind: str = "percentile", honour_mask: bool = False, store_as: str | None = None) -> DataFrame:
    """Masks both eyes where they diverge; `store_as` keeps the distance as a signal, masked there and where an eye was."""
    out = divergent(df, threshold, kind, honour_mask, "_diverged", store_as or "_dist")
    old = F.lit(False)
    for s in BOTH:
        old = old | F.col(mask_of(s))
    if store_as:
        out = out.withColumn(mask_of(store_as), F.col("_diverged") | old | F.col(store_as).isNull())
    return out.withColumns({mask_of(s): F.col(mask_of(s)) | F.col("_diverged") for s in BOTH}).drop("_diverged", "_dist")


def divergences(df: DataFrame, threshold: float = 0.99, kind: str = "percentile", honour_mask: bool = False) -> DataFrame:
    """[start, end) index runs where the eyes diverge."""
    return runs(divergent(df, threshold, kind, honour_mask), F.col("diverged"))


def off_screen(eye: str, setup: Setup, honour_mask: bool = True):
    """Whether an eye's point lies off the screen; its edges are on it, and a missing point isn't off it."""
    x, y = (visible(f"{eye}_{v}") if honour_mask else F.col(f"{eye}_{v}") for v in "xy")
    return F.coalesce(~in_rectangle(x, y, 0, 0, setup.width, setup.height), F.lit(False))


def offscreen_runs(df: DataFrame, eye: str, setup: Setup, honour_mask: bool = True) -> DataFrame:
    return runs(df, off_screen(eye, setup, honour_mask))


def mask_offscreen(df: DataFrame, setup: Setup, eyes: tuple[str, ...] = ("left", "right"), honour_mask: bool = True) -> DataFrame:
    """Masks x and y of the given eyes where they are off the screen."""
    out = {}
    for e in eyes:
        off = off_screen(e, setup, honour_mask)
        out |= {mask_of(f"{e}_{v}"): F.col(mask_of(f"{e}_{v}")) | off for v in "xy"}
    return df.withColumns(out)


def correct_foreshortening(df: DataFrame, setup: Setup, eyes: tuple[str, ...] = ("left",), midpoint: tuple[float, float] | None = None, store_as: str = "pupil") -> DataFrame:
    """<eye>_<store_as>: the pupil of each eye times sqrt(dist² / d² + 1), dist in mm from a midpoint in pixels.

    The midpoint is the screen's centre if none is given. A mask goes with its pupil; where the
    gaze is missing the corrected pupil is missing and masked.
    """
    out = {}
    mx, my = midpoint or (setup.width / 2, setup.height / 2)
    for e in eyes:
        if missing := [s for s in (f"{e}_x", f"{e}_y", f"{e}_pupil") if s not in df.columns]:
            raise ValueError(f"missing: {missing}")
        x0, y0 = setup.pixels_to_mm(F.lit(float(mx)), F.lit(float(my)))
        x, y = setup.pixels_to_mm(F.col(f"{e}_x"), F.col(f"{e}_y"))
        value = F.col(f"{e}_pupil") * F.sqrt(((x - x0) ** 2 + (y - y0) ** 2) / setup.d**2 + 1)
        to = f"{e}_{store_as}"
        out |= {to: value, mask_of(to): F.col(mask_of(f"{e}_pupil")) | value.isNull()}
    return df.withColumns(out)

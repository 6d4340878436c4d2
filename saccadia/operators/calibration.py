"""Validation points of eye-tracker calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measured_points(validation: DataFrame) -> DataFrame:
    """Adds where the gaze was measured to rows of (eye, point_x, point_y, offset, diff_x, diff_y).

    The eye's name becomes lower-case; a missing one is 'unknown'.
    """
    return validation.withColumns({
        "eye": F.coalesce(F.lower("eye"), F.lit("unknown")),
        "measured_x": F.col("point_x") + F.col("diff_x"),
        "measured_y": F.col("point_y") + F.col("diff_y"),
    })


def error_stats(points: DataFrame, *by: str) -> DataFrame:
    """n, mean, population sd, max and min of the offset (in degrees) for each group."""
    o = F.col("offset")
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(o).alias("mean"), F.stddev_pop(o).alias("sd"), F.max(o).alias("max"), F.min(o).alias("min"))

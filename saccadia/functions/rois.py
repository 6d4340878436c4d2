"""Regions of interest in pixels, built from pixels, mm or angles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column

from saccadia.functions.geometry import Setup, in_circle, in_rectangle
from saccadia.functions.units import parse_angle, parse_distance


def _pixel(setup: Setup, x_mm: float, y_mm: float) -> tuple[float, float]:
    """The pixel of a point in mm from the screen's centre, y upwards."""
    return setup.width / 2 + x_mm * setup.width / setup.width_mm, setup.height / 2 - y_mm * setup.height / setup.height_mm


def _mm(setup: Setup, angle) -> float:
    if setup.d is None:
        raise ValueError("angles need the distance between eye and screen")
    return setup.d * math.tan(parse_angle(angle))


@dataclass(frozen=True)
class Circle:
    cx: float
    cy: float
    radius: float
    name: str | None = None

    def __post_init__(self):
        if self.radius < 0:
            raise ValueError("a radius is not negative")

    @classmethod
    def from_mm(cls, center, radius, setup: Setup, name: str | None = None) -> Circle:
        """On pixels that aren't square the radius is taken at their mean side."""
        side = (setup.width_mm / setup.width + setup.height_mm / setup.height) / 2
        return cls(*_pixel(setup, *map(parse_distance, center)), parse_distance(radius) / side, name)

    @classmethod
    def from_degrees(cls, center, radius, setup: Setup, name: str | None = None) -> Circle:
        """Numbers are radians, texts name their unit ('5 deg'); the radius is as at the screen's centre."""
        return cls.from_mm([_mm(setup, a) for a in center], _mm(setup, radius), setup, name)

    def contains(self, x: Column, y: Column) -> Column:
        return in_circle(x, y, self.cx, self.cy, self.radius)


@dataclass(frozen=True)
class Rectangle:
    x0: float
    y0: float
    x1: float
    y1: float
    name: str | None = None

    @classmethod
    def from_mm(cls, corner1, corner2, setup: Setup, name: str | None = None) -> Rectangle:
        return cls(*_pixel(setup, *map(parse_distance, corner1)), *_pixel(setup, *map(parse_distance, corner2)), name)

    @classmethod
    def from_degrees(cls, corner1, corner2, setup: Setup, name: str | None = None) -> Rectangle:
        """Numbers are radians, texts name their unit ('5 deg')."""
        return cls.from_mm([_mm(setup, a) for a in corner1], [_mm(setup, a) for a in corner2], setup, name)

    def contains(self, x: Column, y: Column) -> Column:
        return in_rectangle(x, y, self.x0, self.y0, self.x1, self.y1)

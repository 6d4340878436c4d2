"""Units of time, distance and angle."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted names of each unit; None is the sample index. Fixed values.
ALIASES: dict[str | None, tuple[str, ...]] = {
    "ms": ("ms", "millisecond", "milliseconds"),
    "sec": ("s", "sec", "secs", "second", "seconds"),
    "min": ("m", "min", "mins", "minute", "minutes"),
    "h": ("h", "hr", "hrs", "hour", "hours"),
    None: ("index", "indices", "idx", "sample", "samples"),
}
#: Units in a millisecond.
PER_MS = {"ms": 1.0, "sec": 1 / 1e3, "min": 1 / 6e4, "h": 1 / 3.6e6}
MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "inch": 25.4}


def normalize_unit(unit: str | None) -> str | None:
    if unit is None:
        return None
    for name, known in ALIASES.items():
        if unit.strip().lower() in known:
            return name
    raise ValueError(f"unknown unit {unit!r}")


def factor(unit: str) -> float:
    """What a time in milliseconds is multiplied by to be in `unit`."""
    return PER_MS[normalize_unit(unit)]


def to_unit(t_ms: Column, unit: str) -> Column:
    return t_ms * factor(unit)


def from_unit(t: Column, unit: str) -> Column:
    return t / factor(unit)


def unit_column(unit: Column) -> Column:
    """normalize_unit over a column of names; null for an index or an unknown name."""
    pairs = [F.lit(x) for name, known in ALIASES.items() if name for alias in known for x in (alias, name)]
    return F.create_map(*pairs)[F.lower(F.trim(unit))]


def _parse(value, units: dict[str, float], default: float) -> float:
    if isinstance(value, (int, float)):
        return float(value) * default
    m = re.fullmatch(r"\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*([A-Za-z]+)\s*", str(value))
    if not m or m[2].lower() not in units:
        raise ValueError(f"can't read {value!r}")
    return float(m[1]) * units[m[2].lower()]


def parse_distance(value) -> float:
    """Millimetres of a number (mm) or a text such as '60 cm'."""
    return _parse(value, MM, 1.0)


def parse_angle(value) -> float:
    """Radians of a number (radians) or a text such as '30 deg'."""
    deg = math.pi / 180
    return _parse(value, {"deg": deg, "degree": deg, "degrees": deg, "rad": 1.0, "radian": 1.0, "radians": 1.0}, 1.0)

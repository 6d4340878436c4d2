"""Screen and eye geometry as column expressions."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from saccadia.functions.units import parse_angle, parse_distance


@dataclass(frozen=True)
class Setup:
    """A screen of width x height pixels and mm, at distance d mm from the eye."""

    width: float
    height: float
    width_mm: float
    height_mm: float
    d: float | None = None
    dx: float = 0.0
    dy: float = 0.0
    pitch: float = 0.0
    yaw: float = 0.0
    r: float | None = None
    theta: float | None = None
    phi: float | None = None

    @classmethod
    def of(cls, width, height, width_mm, height_mm, distance=None, offset=(0, 0), tilt=(0, 0), camera=None) -> Setup:
        """distance: eye to the screen's centre; camera: (x, y, z) or {'r', 'theta', 'phi'}."""
        dx, dy = map(parse_distance, offset)
        d = None
        if distance is not None:
            rest = parse_distance(distance) ** 2 - dx * dx - dy * dy
            if rest <= 0:
                raise ValueError("the offset is longer than the distance")
            d = math.sqrt(rest)
        r = theta = phi = None
        if isinstance(camera, dict):
            r, theta, phi = parse_distance(camera["r"]), parse_angle(camera["theta"]), parse_angle(camera["phi"])
        elif camera is not None:
            x, y, z = map(parse_distance, camera)
            r = math.sqrt(x * x + y * y + z * z)
            theta, phi = math.acos(z / r), math.atan2(y, x)
        out = cls(width, height, parse_distance(width_mm), parse_distance(height_mm), d, dx, dy, parse_angle(tilt[0]), parse_angle(tilt[1]), r, theta, phi)
        out.validate()
        return out

    def validate(self) -> None:
        if min(self.width, self.height, self.width_mm, self.height_mm) <= 0 or (self.d is not None and self.d <= 0):
            raise ValueError("sizes and distances must be positive")

    def update(self, distance=None, camera=None, **changes) -> Setup:
        """The setup with some settings changed, angles and lengths as in `of`; a new distance or offset gives a new d."""
        for k in changes:
            if k in ("dx", "dy", "d", "width_mm", "height_mm", "r"):
                changes[k] = parse_distance(changes[k]) if changes[k] is not None else None
            elif k in ("pitch", "yaw", "theta", "phi"):
                changes[k] = parse_angle(changes[k]) if changes[k] is not None else None
        if distance is None and self.d is not None and {"dx", "dy"} & set(changes) and "d" not in changes:
            distance = math.sqrt(self.d**2 + self.dx**2 + self.dy**2)
        out = replace(self, **changes)
        if distance is not None or camera is not None:
            new = Setup.of(out.width, out.height, out.width_mm, out.height_mm, distance, (out.dx, out.dy), (out.pitch, out.yaw), camera)
            out = replace(out, **({"d": new.d} if distance is not None else {}), **({"r": new.r, "theta": new.theta, "phi": new.phi} if camera is not None else {}))
        out.validate()
        return out

    def camera_position(self) -> tuple[float, float, float]:
        s = self.r * math.sin(self.theta)
        return s * math.cos(self.phi), s * math.sin(self.phi), self.r * math.cos(self.theta)

    def is_complete(self) -> bool:
        return self.d is not None and self.r is not None

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Setup:
        return cls(**d)

    def pixels_to_mm(self, x: Column, y: Column, centered: bool = True) -> tuple[Column, Column]:
        cx, cy = (self.width / 2, self.height / 2) if centered else (0.0, 0.0)
        return (x - cx) * (self.width_mm / self.width), (y - cy) * (self.height_mm / self.height)

    def mm_to_pixels(self, x: Column, y: Column, centered: bool = True) -> tuple[Column, Column]:
        cx, cy = (self.width / 2, self.height / 2) if centered else (0.0, 0.0)
        return x / (self.width_mm / self.width) + cx, y / (self.height_mm / self.height) + cy

    def mm_to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(F.atan(x / self.d)), F.degrees(F.atan(y / self.d))

    def radians_to_mm(self, ax: Column, ay: Column) -> tuple[Column, Column]:
        return F.tan(ax) * self.d, F.tan(ay) * self.d

    def pixels_to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees right of and above the screen's centre."""
        mx, my = self.pixels_to_mm(x, y)
        return self.mm_to_degrees(mx, -my)

    def radians_to_pixels(self, ax: Column, ay: Column) -> tuple[Column, Column]:
        mx, my = self.radians_to_mm(ax, ay)
        return self.mm_to_pixels(mx, -my)

    def eye_frame(self, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """A screen point in mm, turned by pitch and yaw and moved to the eye's frame."""
        cp, sp, cy, sy = math.cos(self.pitch), math.sin(self.pitch), math.cos(self.yaw), math.sin(self.yaw)
        return x * cy + y * (sp * sy) + self.dx, y * cp + self.dy, -x * sy + y * (sp * cy) + self.d


def cos_alpha(x: Column, y: Column, theta: float, phi: float, r: float, d: float, eye_offset: float = 0.0) -> Column:
    """Cosine between the eye-to-camera and eye-to-target directions; x, y in mm from the centre."""
    cx, cy, cz = r * math.sin(theta) * math.cos(phi) - eye_offset, r * math.sin(theta) * math.sin(phi), r * math.cos(theta)
    tx = x - eye_offset
    camera = math.sqrt(cx * cx + cy * cy + cz * cz)
    return (tx * cx + y * cy + d * cz) / (F.sqrt(tx * tx + y * y + d * d) * camera)


def correction_factor(cos: Column, threshold: float = 0.15) -> Column:
    return F.when(cos >= threshold, 1 / cos)


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    """Inside or on the edge."""
    if radius < 0:
        raise ValueError("a radius is not negative")
    return F.hypot(x - cx, y - cy) <= radius


def in_rectangle(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Inside or on the edge, corners in any order."""
    return x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))

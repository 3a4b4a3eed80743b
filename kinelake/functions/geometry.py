"""Geometry as Column expressions: everything here stays inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A camera's 3x4 projection matrix, row-major.
Matrix = list[list[float]]


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def difference(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def reproject(p: Matrix | list[list[Column]], point: list[Column]) -> tuple[Column, Column]:
    """Image coordinates of a 3D point under the projection matrix ``p``; NULL behind a zero depth."""
    row = lambda r: point[0] * r[0] + point[1] * r[1] + point[2] * r[2] + r[3]
    depth = row(p[2])
    return F.try_divide(row(p[0]), depth), F.try_divide(row(p[1]), depth)


def reproject_distorted(k: Matrix, dist: list[float], camera_point: list[Column]) -> tuple[Column, Column]:
    """Image coordinates of a point in camera axes with radial (k1, k2) and tangential (p1, p2) distortion."""
    k1, k2, p1, p2 = dist[:4]
    x, y = F.try_divide(camera_point[0], camera_point[2]), F.try_divide(camera_point[1], camera_point[2])
    r2 = x * x + y * y
    radial = F.lit(1.0) + r2 * k1 + r2 * r2 * k2
    u = x * radial + x * y * (2 * p1) + (r2 + x * x * 2) * p2
    v = y * radial + (r2 + y * y * 2) * p1 + x * y * (2 * p2)
    return u * k[0][0] + v * k[0][1] + k[0][2], v * k[1][1] + k[1][2]


def rigid(rotation: Matrix, translation: list[float], point: list[Column]) -> list[Column]:
    return [point[0] * r[0] + point[1] * r[1] + point[2] * r[2] + t for r, t in zip(rotation, translation, strict=True)]


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance; missing dimensions count as zero, and it is infinite if all are missing."""
    squares = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    total = F.coalesce(squares[0], F.lit(0.0))
    some = squares[0].isNotNull()
    for s in squares[1:]:
        total = total + F.coalesce(s, F.lit(0.0))
        some = some | s.isNotNull()
    return F.when(some, F.sqrt(total)).otherwise(F.lit(float("inf")))


def ray(inverse_k: list[list[Column]] | Matrix, rotation: Matrix | list[list[Column]], centre: list[Column] | list[float], x: Column, y: Column) -> tuple[list[Column], list[Column]]:
    """Pluecker line of an image point: unit direction in world axes and moment (centre x direction).

    ``rotation`` turns camera into world axes; missing coordinates give NULL.
    """
    in_camera = [x * r[0] + y * r[1] + r[2] for r in inverse_k]
    world = [dot_numbers(r, in_camera) for r in rotation]
    length = norm(world)
    direction = [F.try_divide(w, length) for w in world]
    centre = [c if isinstance(c, Column) else F.lit(c) for c in centre]
    return direction, cross(centre, direction)


def dot_numbers(numbers: list, columns: list[Column]) -> Column:
    out = columns[0] * numbers[0]
    for n, c in zip(numbers[1:], columns[1:], strict=True):
        out = out + c * n
    return out


def line_distance(l0: list[Column], m0: list[Column], l1: list[Column], m1: list[Column]) -> Column:
    """|l0 . m1 + l1 . m0| of two Pluecker lines, not divided by the sine between them."""
    return F.abs(dot(l0, m1) + dot(l1, m0))


def angle_2d(points: list[list[Column]]) -> Column:
    """Degrees: slope of a segment from its second to its first point (2), signed angle at the middle (3), or between two segments (4)."""
    if len(points) == 2:
        u = difference(points[0], points[1])
        return F.degrees(F.atan2(u[1], u[0]))
    u, v = _two_segments(points)
    return F.degrees(-F.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1]))


def angle_3d(points: list[list[Column]]) -> Column:
    """Unsigned degrees at the middle of 3 points or between the segments of 4."""
    u, v = _two_segments(points)
    return F.degrees(F.atan2(norm(cross(u, v)), dot(u, v)))


def _two_segments(points: list[list[Column]]) -> tuple[list[Column], list[Column]]:
    if len(points) == 3:
        return difference(points[0], points[1]), difference(points[2], points[1])
    if len(points) == 4:
        return difference(points[1], points[0]), difference(points[3], points[2])
    raise ValueError("an angle takes 2, 3 or 4 points")


def wrapped(angle: Column, offset: float, multiplier: float, half_turn: bool = False) -> Column:
    """(angle + offset) * multiplier, wrapped to [-180, 180), or to [-90, 90) for undirected lines."""
    width = 180.0 if half_turn else 360.0
    return F.pmod((angle + offset) * multiplier + width / 2, F.lit(width)) - width / 2


def midpoint(a: list[Column], b: list[Column]) -> list[Column]:
    return [(x + y) / 2 for x, y in zip(a, b, strict=True)]


def z_up_to_y_up(x: Column, y: Column, z: Column) -> list[Column]:
    return [y, z, x]


def y_up_to_z_up(x: Column, y: Column, z: Column) -> list[Column]:
    return [z, x, y]


def rotate90(x: Column, y: Column, z: Column, axis: str) -> list[Column]:
    """A quarter turn about ``axis``: one of x, y, z with an optional sign."""
    sign = -1 if axis.startswith("-") else 1
    turn = {"x": [x, -z * sign, y * sign], "y": [z * sign, y, -x * sign], "z": [-y * sign, x * sign, z]}
    return turn[axis.lstrip("+-")]


def scaled(values: list[Column], factor: float) -> list[Column]:
    return [v * factor for v in values]


#: Factors to metres.
UNITS = {"m": 1.0, "dm": 0.1, "cm": 0.01, "mm": 0.001}


def in_metres(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in UNITS.items():
        out = F.when(unit == name, value * factor).otherwise(out)
    return out


def box_xyxy(xs: Column, ys: Column, margin: float = 0.0, width: float | None = None, height: float | None = None) -> list[Column]:
    """xmin, ymin, xmax, ymax of coordinate arrays, clipped to the frame, then widened by ``margin`` pixels."""
    low = [F.array_min(xs), F.array_min(ys)]
    high = [F.array_max(xs), F.array_max(ys)]
    if width is not None and height is not None:
        low = [F.greatest(c, F.lit(0.0)) for c in low]
        high = [F.least(c, F.lit(float(m))) for c, m in zip(high, (width, height), strict=True)]
    return [*(c - margin for c in low), *(c + margin for c in high)]


def box_ltwh(box: list[Column]) -> list[Column]:
    return [box[0], box[1], box[2] - box[0], box[3] - box[1]]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two xyxy boxes."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def euler_xyz(r: list[list[Column]]) -> list[Column]:
    """Degrees about x, y, z of a rotation matrix; x is zero where y is a right angle."""
    sy = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    free = sy > 1e-6
    x = F.when(free, F.atan2(r[2][1], r[2][2])).otherwise(F.atan2(-r[1][2], r[1][1]))
    y = F.atan2(-r[2][0], sy)
    z = F.when(free, F.atan2(r[1][0], r[0][0])).otherwise(F.lit(0.0))
    return [F.degrees(a) for a in (x, y, z)]


def natural_key(name: Column) -> list[Column]:
    """Sort keys: names without a number first, then by their last number, then by name."""
    number = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1)
    return [(number != "").cast("int"), F.when(number != "", number.cast("decimal(38,0)")), name]


def mirrored(name: Column) -> Column:
    """The name of a keypoint's partner on the other side; its own if it has none."""
    return (
        F.when(name.rlike("^R"), F.regexp_replace(name, "^R", "L"))
        .when(name.rlike("^L"), F.regexp_replace(name, "^L", "R"))
        .when(name.contains("right"), F.replace(name, F.lit("right"), F.lit("left")))
        .when(name.contains("left"), F.replace(name, F.lit("left"), F.lit("right")))
        .otherwise(name)
    )


def string_id(name: Column, digits: int = 8) -> Column:
    """A decimal id of ``digits`` digits at most from the md5 of a string."""
    # 128 bits do not fit a decimal; the remainder is taken over the two halves.
    hexed = F.md5(name.cast("binary"))
    mod = 10**digits
    half = lambda c: F.pmod(F.conv(c, 16, 10).cast("decimal(20,0)"), F.lit(mod).cast("decimal(20,0)"))
    high = half(F.substring(hexed, 1, 16)) * F.lit((1 << 64) % mod).cast("decimal(18,0)")
    return F.pmod(high + half(F.substring(hexed, 17, 16)), F.lit(mod).cast("decimal(38,0)")).cast("long")


def standardised(value: Column, mean: float, deviation: float) -> Column:
    return (value - mean) / deviation


def relative_to(point: list[Column], origin: list[Column], height: Column) -> list[Column]:
    """Coordinates from ``origin`` in body heights."""
    return [(a - b) / height for a, b in zip(point, origin, strict=True)]


def from_relative(point: list[Column], origin: list[Column], height: Column) -> list[Column]:
    return [a * height + b for a, b in zip(point, origin, strict=True)]


DEGREE = math.pi / 180

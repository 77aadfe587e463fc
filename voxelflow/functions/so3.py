"""Rotations as Columns: exponential, logarithm, quaternion; matrices are three rows of three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vector, norm

Matrix = list[list[Column]]


def exp(w: Sequence, cutoff: float = 1e-9) -> Matrix:
    """The rotation by the vector w; the identity where its length is under the cutoff."""
    angle = norm(w)
    safe = F.when(angle >= cutoff, angle)
    k = [F.coalesce(c / safe, F.lit(0.0)) for c in w]
    s, c = F.sin(angle), 1 - F.cos(angle)
    x, y, z = k
    return [
        [1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y],
        [c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x],
        [c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)],
    ]


def log(r: Sequence[Sequence]) -> Vector:
    """The rotation vector of r: half the skew part near the identity; undefined at half a turn."""
    trace = r[0][0] + r[1][1] + r[2][2]
    angle = F.when(trace > 3 - 1e-6, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (trace - 1)))))
    factor = F.when(angle < 0.001, F.lit(0.5)).otherwise(0.5 * angle / F.nullif(F.sin(angle), F.lit(0.0)))
    return [factor * (r[2][1] - r[1][2]), factor * (r[0][2] - r[2][0]), factor * (r[1][0] - r[0][1])]


def quaternion(r: Sequence[Sequence]) -> Vector:
    """(x, y, z, w) with w >= 0, from the largest of the four squared components."""
    half = lambda a: F.sqrt(F.greatest(F.lit(0.0), a)) / 2
    xx, yy, zz = r[0][0], r[1][1], r[2][2]
    largest = F.greatest(xx + yy + zz, xx, yy, zz)
    w = half(1 + xx + yy + zz)
    x, y, z = half(1 + xx - yy - zz), half(1 - xx + yy - zz), half(1 - xx - yy + zz)
    a, b, c = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    d, e, f = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    over = lambda p, q: p / (4 * F.nullif(q, F.lit(0.0)))
    cases = [
        (largest == xx + yy + zz, [over(a, w), over(b, w), over(c, w), w]),
        (largest == xx, [x, over(d, x), over(e, x), over(a, x)]),
        (largest == yy, [over(d, y), y, over(f, y), over(b, y)]),
        (F.lit(True), [over(e, z), over(f, z), z, over(c, z)]),
    ]
    pick = lambda k: F.coalesce(*(F.when(on, q[k]) for on, q in cases))
    sign = F.when(pick(3) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [sign * pick(k) for k in range(4)]


def euler(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """A constant rotation, turns about x, y, then z."""
    from math import cos, sin

    cr, sr, cp, sp, cy, sy = cos(roll), sin(roll), cos(pitch), sin(pitch), cos(yaw), sin(yaw)
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]

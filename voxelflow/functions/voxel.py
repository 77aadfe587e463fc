"""Voxel keys and octree digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def voxel_index(c: Column, size: float) -> Column:
    """Truncation toward zero after taking 1 off negatives: a coordinate on a negative cell border belongs to the cell below it."""
    q = c / F.lit(size)
    return F.when(q < 0, (q - 1).cast("long")).otherwise(q.cast("long"))


def voxel_key(point: Sequence[Column], size: float) -> list[Column]:
    return [voxel_index(c, size).alias(n) for c, n in zip(point, ("vx", "vy", "vz"), strict=True)]


def voxel_centre(key: Sequence[Column], size: float) -> list[Column]:
    return [(k + 0.5) * F.lit(size) for k in key]


def octant_digits(point: Sequence[Column], centre: Sequence[Column], size: float, layers: int) -> list[Column]:
    """The octant of the point at each layer, from the root voxel down: 4 for x above the centre, 2 for y, 1 for z; a border counts as below."""
    digits, quarter, centre = [], size / 4, list(centre)
    for _ in range(layers):
        above = [(p > c).cast("int") for p, c in zip(point, centre, strict=True)]
        digits.append(4 * above[0] + 2 * above[1] + above[2])
        centre = [c + (2 * a - 1) * F.lit(quarter) for c, a in zip(centre, above, strict=True)]
        quarter /= 2
    return digits

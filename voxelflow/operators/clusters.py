"""Point clusters: mergeable and retractable moments of points, a row for each key.

Sums run about a reference point (the voxel's centre) where there is one, since P/N - c c^T cancels far from the origin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SYM, SYM_AT, apply, dot
from ..functions.voxel import voxel_centre, voxel_key

FIRST = ("sx", "sy", "sz")
SECOND = tuple("s" + n for n in SYM)
MOMENTS = ("n", *FIRST, *SECOND)


def moments(points: DataFrame, keys: Sequence[str], about: Sequence[Column] | None = None) -> DataFrame:
    """MOMENTS by keys: ten sums, combined before the shuffle."""
    p = [F.col(c) - a for c, a in zip("xyz", about, strict=True)] if about else [F.col(c) for c in "xyz"]
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(n) for c, n in zip(p, FIRST, strict=True))]
    sums += [F.sum(p[i] * p[j]).alias(n) for n, (i, j) in zip(SECOND, SYM_AT, strict=True)]
    return points.groupBy(*keys).agg(*sums)


def voxel_moments(points: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """MOMENTS by keys and voxel, about the voxel's centre."""
    keyed = points.select("*", *voxel_key([F.col(c) for c in "xyz"], size))
    return moments(keyed, [*keys, "vx", "vy", "vz"], voxel_centre([F.col(c) for c in ("vx", "vy", "vz")], size))


def merge(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    return clusters.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in MOMENTS))


def retract(clusters: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """clusters less what gone holds of them; emptied clusters go."""
    g = gone.select(*keys, *(F.col(m).alias("__" + m) for m in MOMENTS))
    left = clusters.join(g, list(keys), "left")
    return left.select(*keys, *((F.col(m) - F.coalesce(F.col("__" + m), F.lit(0))).alias(m) for m in MOMENTS)).where("n > 0")


def with_covariance(clusters: DataFrame, prefix: str = "c", digits: int | None = None) -> DataFrame:
    """clusters with mean offsets mx, my, mz and the population covariance prefix + xx, ...; digits rounds the latter, so that decisions after it don't hang on the order of sums."""
    mean = {"m" + a: F.col(s) / F.col("n") for a, s in zip("xyz", FIRST, strict=True)}
    cov = {prefix + n: F.col("s" + n) / F.col("n") - F.col("m" + "xyz"[i]) * F.col("m" + "xyz"[j]) for n, (i, j) in zip(SYM, SYM_AT, strict=True)}
    return clusters.withColumns(mean).withColumns({k: F.round(v, digits) if digits else v for k, v in cov.items()})


def transform(clusters: DataFrame, rotation: Sequence[Sequence], shift: Sequence, keys: Sequence[str]) -> DataFrame:
    """The clusters that the moved points would have, without the points: v' = R v + N t, P' = R P R^T + R v t^T + t v^T R^T + N t t^T."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    t, r = [lit(x) for x in shift], [[lit(x) for x in row] for row in rotation]
    second = {k: F.col(n) for n, k in zip(SECOND, SYM_AT, strict=True)}
    p = [[second[min(i, j), max(i, j)] for j in range(3)] for i in range(3)]
    v = apply(r, [F.col(c) for c in FIRST])
    rp = [[dot(r[i], [p[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]
    out = [F.col("n")] + [(v[k] + F.col("n") * t[k]).alias(FIRST[k]) for k in range(3)]
    out += [(dot(rp[i], r[j]) + v[i] * t[j] + t[i] * v[j] + F.col("n") * t[i] * t[j]).alias(n) for n, (i, j) in zip(SECOND, SYM_AT, strict=True)]
    return clusters.select(*keys, *out)


def sliding(clusters: DataFrame, frame: str, size: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """MOMENTS of the last `size` frames at each frame. clusters: one row for each of keys and frame, so a window's rows are frames, not points."""
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(1 - size, 0)
    return clusters.select(*keys, frame, *(F.sum(m).over(w).alias(m) for m in MOMENTS))

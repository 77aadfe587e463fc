"""Downsampling by voxel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SYM
from ..functions.voxel import voxel_key

XYZ = ("x", "y", "z")


def _keyed(points: DataFrame, size: float) -> DataFrame:
    return points.select("*", *voxel_key([F.col(c) for c in XYZ], size))


def means(points: DataFrame, size: float, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A row for each voxel: mean position, count, and the first point's intensity in the given order. A size under a millimetre keeps the points."""
    if size < 0.001:
        return points.select(*keys, *(F.lit(None).cast("long").alias(k) for k in ("vx", "vy", "vz")), *XYZ, F.lit(1).cast("long").alias("n"), "intensity")
    return _keyed(points, size).groupBy(*keys, "vx", "vy", "vz").agg(*(F.avg(c).alias(c) for c in XYZ), F.count("*").alias("n"), F.min_by("intensity", F.struct(*order)).alias("intensity"))


def mean_covariances(points: DataFrame, size: float, keys: Sequence[str] = (), prefix: str = "v") -> DataFrame:
    """Mean position and mean covariance (prefix + xx, ...) of each voxel."""
    return _keyed(points, size).groupBy(*keys, "vx", "vy", "vz").agg(*(F.avg(c).alias(c) for c in (*XYZ, *(prefix + n for n in SYM))), F.count("*").alias("n"))


def representatives(points: DataFrame, size: float, tie: str, keys: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """The actual point nearest to the mean of each voxel; ties (to `digits`) go to the least `tie`.

    The mean comes from an aggregate that combines before the shuffle, and so does the choice; no voxel is gathered.
    """
    keyed, by = _keyed(points, size), [*keys, "vx", "vy", "vz"]
    mean = keyed.groupBy(*by).agg(*(F.avg(c).alias("__m" + c) for c in XYZ), F.count("*").alias("n"))
    d2 = sum(((F.col(c) - F.col("__m" + c)) * (F.col(c) - F.col("__m" + c)) for c in XYZ[1:]), (F.col("x") - F.col("__mx")) * (F.col("x") - F.col("__mx")))
    near = keyed.join(mean, by).groupBy(*by, "n").agg(F.min(F.struct(F.round(d2, digits).alias("d2"), F.col(tie).alias("tie"), *XYZ)).alias("p"))
    return near.select(*by, "n", F.col("p.tie").alias(tie), *(F.col("p." + c).alias(c) for c in XYZ))


def adaptive(points: DataFrame, size: float, least: int, order: Sequence[str], scan: str = "scan") -> DataFrame:
    """means by scan, at half the size for scans with fewer than `least` of them; both are planned at once, so the driver doesn't wait in between."""
    coarse = means(points, size, order, [scan])
    n = coarse.groupBy(scan).count()
    fine = means(points.join(n.where(F.col("count") < least).select(scan), scan, "left_semi"), size / 2, order, [scan])
    return coarse.join(n.where(F.col("count") >= least).select(scan), scan, "left_semi").withColumn("size", F.lit(size)).unionByName(fine.withColumn("size", F.lit(size / 2)))


def union_means(old: DataFrame, new: DataFrame, size: float, order: Sequence[str]) -> DataFrame:
    """A map's points and new ones, downsampled together."""
    return means(old.unionByName(new), size, order)

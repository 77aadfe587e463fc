"""Ordered operators on inertial readings, by session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoints(readings: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], scale: float = 1e-6) -> DataFrame:
    """Mean of each reading and the one before (mid_*), and the seconds between them (dt); the first has none and goes."""
    w = Window.partitionBy(*keys).orderBy(time)
    out = readings.withColumn("dt", (F.col(time) - F.lag(time).over(w)) * scale).withColumns({"mid_" + v: (F.col(v) + F.lag(v).over(w)) * 0.5 for v in values})
    return out.where("dt IS NOT NULL")


def static_init(readings: DataFrame, keys: Sequence[str], order: str, acc: Sequence[str], least: int = 30, standard: float = 9.8) -> DataFrame:
    """Means over the first `least` readings of a session; readings in units of g (a mean under 2) get the standard scale, and gravity is opposite to the mean."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = readings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= least)
    mean = first.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(a).alias("mean_" + a) for a in acc)).where(F.col("n") >= least)
    norm = F.sqrt(sum((F.col("mean_" + a) * F.col("mean_" + a) for a in acc[1:]), F.col("mean_" + acc[0]) * F.col("mean_" + acc[0])))
    out = mean.withColumn("scale", F.when(norm < 2, F.lit(standard)).otherwise(F.lit(1.0)))
    return out.withColumns({"g_" + a: -F.col("mean_" + a) * F.col("scale") for a in acc})


def dead_reckon(readings: DataFrame, keys: Sequence[str], time: str, acc: str, scale: float = 1e-6) -> DataFrame:
    """Speed and place along one axis, from rest: cumulative sums of the midpoint acceleration."""
    mid = midpoints(readings, keys, time, [acc], scale)
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("mid_" + acc) * F.col("dt")
    with_speed = mid.withColumn("speed", F.sum(step).over(w)).withColumn("__was", F.coalesce(F.sum(step).over(before), F.lit(0.0)))
    return with_speed.withColumn("place", F.sum(F.col("__was") * F.col("dt") + 0.5 * step * F.col("dt")).over(w)).drop("__was")


def path_length(poses: DataFrame, keys: Sequence[str], order: Sequence[str], point: Sequence[str]) -> DataFrame:
    """Number of poses and total distance by keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step: Column = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in point[1:]), (F.col(point[0]) - F.lag(point[0]).over(w)) * (F.col(point[0]) - F.lag(point[0]).over(w)))
    return poses.withColumn("__step", F.sqrt(step)).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("length"))


def travelled(poses: DataFrame, key: str, frame: str, point: Sequence[str] = ("x", "y", "z"), every: int = 10, least: float = 0.5) -> DataFrame:
    """Distance between anchors: each every-th frame that lies over `least` from the last anchor adds its distance and becomes the anchor. The fold depends on its own decisions, so it is a kernel by key."""
    x, y, z = point

    def fold(pdf):  # noqa: ANN001, ANN202
        import numpy as np

        pdf = pdf.sort_values(frame)
        total, anchor = 0.0, None
        for p in pdf[[x, y, z]].to_numpy(float)[::every]:
            if anchor is None:
                anchor = p
            elif (d := float(np.linalg.norm(p - anchor))) > least:
                total, anchor = total + d, p
        return pdf.iloc[:1][[key]].assign(travelled=total)

    return poses.select(key, frame, *point).groupBy(key).applyInPandas(fold, f"{key} long, travelled double")

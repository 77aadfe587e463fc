"""Sinks: trajectories as text, point clouds and maps as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tum_line(t: str | Column = "t", position: Sequence[str] = ("x", "y", "z"), quaternion: Sequence[str] = ("qx", "qy", "qz", "qw")) -> Column:
    """`t tx ty tz qx qy qz qw` with nine decimals, which are those of a number's shortest form: past a double's precision they are zeros."""
    return F.format_string(" ".join(["%.9f"] * 8), t if isinstance(t, Column) else F.col(t), *(F.col(c) for c in (*position, *quaternion)))


def write_tum(poses: DataFrame, path: str, mode: str = "append", **names: Sequence[str]) -> None:
    poses.select(tum_line(**names).alias("value")).write.mode(mode).text(path)


def write_points(points: DataFrame, path: str, by: Sequence[str] = (), mode: str = "append") -> None:
    points.write.mode(mode).partitionBy(*by).parquet(path)

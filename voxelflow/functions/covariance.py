"""Covariances of range sensors' points."""

from __future__ import annotations

from collections.abc import Sequence
from math import radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import SYM, SYM_AT, dot, hat, sandwich, symmetric


def beam_covariance(p: Sequence[Column], range_error: float, beam_degrees: float) -> list[Column]:
    """xx, xy, ... of a point's noise: range noise along the beam, and bearing noise across it, which grows with the range.

    With d the beam's direction, any two unit vectors across it and each other add up to I - d d^T, so no basis is built:
    V = range_error^2 d d^T + r^2 sin^2(beam) (I - d d^T), and r^2 d d^T = p p^T. It follows the point: that of R p is R V R^T.
    """
    bearing = sin(radians(beam_degrees)) ** 2
    along = F.lit(range_error**2) / dot(p, p) - F.lit(bearing)
    return [p[i] * p[j] * along + (F.lit(bearing) * dot(p, p) if i == j else F.lit(0.0)) for i, j in SYM_AT]


def off_ground(z: str) -> Column:
    """A height, 1e-4 in place of 0."""
    return F.when(F.col(z) == 0, F.lit(1e-4)).otherwise(F.col(z))


def with_body_covariance(df: DataFrame, range_error: float, beam_degrees: float, point: Sequence[str] = ("x", "y", "z"), prefix: str = "v") -> DataFrame:
    """df with prefix + xx, ..., each point's noise (`beam_covariance`). A height of 0 becomes 1e-4 first."""
    df = df.withColumn(point[2], off_ground(point[2]))
    return df.withColumns({prefix + n: v for n, v in zip(SYM, beam_covariance([F.col(n) for n in point], range_error, beam_degrees), strict=True)})


def world_covariance(rotation: Sequence[Sequence], rot_var: Sequence[Sequence[Column]], pos_var: Sequence[Sequence[Column]], point: Sequence[Column], prefix: str = "v") -> list[Column]:
    """R V R^T + [p]x V_rot [p]x^T + V_pos: a body point's covariance in the world, with that of the pose."""
    body, turn = sandwich(rotation, symmetric(prefix)), sandwich(hat(point), rot_var)
    return [body[i][j] + turn[i][j] + pos_var[i][j] for i, j in SYM_AT]

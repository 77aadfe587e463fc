"""Weighted least-squares aggregates: sums that reach the driver as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import with_eigenvalues
from ..functions.vectors import SYM, SYM_AT, apply, cross, dot, sandwich, symmetric
from .clusters import FIRST, MOMENTS, SECOND

JACOBIAN = tuple(f"j{k}" for k in range(6))


def point_to_plane(matched: DataFrame, rotation: Sequence[Sequence], shift: Sequence[float], point: Sequence[str] = ("x", "y", "z"), normal: Sequence[str] = ("nx", "ny", "nz"), centre: Sequence[str] = ("qx", "qy", "qz"), sigma: str = "sigma", floor: float = 0.0005) -> DataFrame:
    """matched body points with the residual n . (R p + t - q), its Jacobian [p x R^T n; n] and the weight 1 / (floor + sigma)."""
    p, n, q = ([F.col(c) for c in names] for names in (point, normal, centre))
    transposed = [[rotation[j][i] for j in range(3)] for i in range(3)]
    world = [w + F.lit(float(t)) for w, t in zip(apply(rotation, p), shift, strict=True)]
    out = {"residual": dot(n, [w - c for w, c in zip(world, q, strict=True)]), "weight": 1 / (F.lit(floor) + F.col(sigma))}
    out |= dict(zip(JACOBIAN, [*cross(p, apply(transposed, n)), *n], strict=True))
    return matched.withColumns(out)


def local_planes(neighbours: DataFrame, worst: float = 0.1, least_det: float = 1e-3, key: str = "id") -> DataFrame:
    """key, nx, ny, nz and worst: the plane n . a = -1 through each key's neighbours a (x, y, z), by 3x3 normal equations; left out if they don't fix it or one of them is off by over `worst`."""
    s = {m: F.sum(F.col(m[0]) * F.col(m[1])) for m in SYM} | {a: F.sum(a) for a in "xyz"}
    neighbours = neighbours.select(key, *"xyz").repartition(key)  # once for all three steps; partial sums would be larger than the points
    sums = neighbours.groupBy(key).agg(*(c.alias("s" + k) for k, c in s.items()))
    m = [[F.col("s" + "".join(sorted(a + b))) for b in "xyz"] for a in "xyz"]
    right = [-F.col("s" + a) for a in "xyz"]

    def det(columns: list[list[Column]]) -> Column:
        return dot(columns[0], cross(columns[1], columns[2]))

    solved = sums.withColumn("__det", det(m)).where(F.abs("__det") > least_det)
    solved = solved.select(key, *((det([right if k == i else m[k] for k in range(3)]) / F.col("__det")).alias(n) for i, n in enumerate(("nx", "ny", "nz"))))
    off = F.abs(dot([F.col("n" + a) for a in "xyz"], [F.col(a) for a in "xyz"]) + 1)
    return neighbours.join(solved, key).groupBy(key, "nx", "ny", "nz").agg(F.round(F.max(off), 6).alias("worst")).where(F.col("worst") <= worst)


def normal_equations(rows: DataFrame, keys: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """h00 to h55 (upper triangle of sum w j j^T), g0 to g5 (-sum w j r), cost and n: 29 sums, combined before the shuffle; more: further aggregates."""
    w, r, j = F.col("weight"), F.col("residual"), [F.col(c) for c in JACOBIAN]
    sums = [F.sum(w * j[a] * j[b]).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    sums += [(-F.sum(w * j[a] * r)).alias(f"g{a}") for a in range(6)]
    return rows.groupBy(*keys).agg(*sums, F.sum(w * r * r).alias("cost"), F.count("*").alias("n"), *more)


def degeneracy(matched: DataFrame, keys: Sequence[str] = (), normal: Sequence[str] = ("nx", "ny", "nz"), least: float = 14.0, digits: int = 6) -> DataFrame:
    """Eigenvalues of the scatter of the matched normals, and whether the least is large enough to fix a pose."""
    n = [F.col(c) for c in normal]
    scatter = matched.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(F.sum(n[i] * n[k]), digits).alias("c" + s) for s, (i, k) in zip(SYM, SYM_AT, strict=True)))
    return with_eigenvalues(scatter, digits=digits).withColumn("well_posed", F.col("l0") >= least)


def bundle_residual(factors: DataFrame, poses: DataFrame, voxel: Sequence[str], frame: str = "frame", digits: int = 9) -> DataFrame:
    """Least eigenvalue of each voxel's clusters after every frame's cluster is moved by its pose.

    factors: MOMENTS by voxel and frame (about the origin of the frame). poses: frame, r00 to r22, tx, ty, tz, a row for
    each frame of a window, which is joined by frame.
    """
    r = [[F.col(f"r{i}{k}") for k in range(3)] for i in range(3)]
    t = [F.col("t" + a) for a in "xyz"]
    both = factors.join(poses, frame)
    v = apply(r, [F.col(c) for c in FIRST])
    moved = sandwich(r, symmetric("s"))
    sums = {"n": F.col("n")} | {FIRST[k]: v[k] + F.col("n") * t[k] for k in range(3)}
    sums |= {s: moved[i][k] + v[i] * t[k] + t[i] * v[k] + F.col("n") * t[i] * t[k] for s, (i, k) in zip(SECOND, SYM_AT, strict=True)}
    total = both.select(*voxel, *(c.alias(k) for k, c in sums.items())).groupBy(*voxel).agg(*(F.sum(m).alias(m) for m in MOMENTS))
    mean = {a: F.col(s) / F.col("n") for a, s in zip("xyz", FIRST, strict=True)}
    cov = {"c" + n: F.round(F.col("s" + n) / F.col("n") - mean["xyz"[i]] * mean["xyz"[k]], digits) for n, (i, k) in zip(SYM, SYM_AT, strict=True)}
    return with_eigenvalues(total.withColumns(cov)).select(*voxel, "n", "l0", "l1", "l2")


def cost_breakdown(residuals: DataFrame, family: str, cost: str = "l0", weight: Column | float = 1.0) -> DataFrame:
    """family, n and its weighted cost: what each kind of factor adds to the whole."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return residuals.groupBy(family).agg(F.count("*").alias("n"), F.sum(F.col(cost) * weight).alias("cost"))

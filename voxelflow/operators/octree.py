"""Octree planes level by level: a node is a row (voxel, layer, path), and a level is one aggregate.

A level's points are those whose node was neither a plane nor too small above; each level aggregates moments by one
more octant digit, so there is no recursion and at most max_layer + 1 shuffles of what is left. A level's nodes are stored,
since the next level asks them which points go on; otherwise each level would aggregate those above it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import with_eigenvalues
from ..functions.vectors import SYM
from ..functions.voxel import octant_digits, voxel_centre, voxel_key
from .clusters import moments, with_covariance
from .state import stored

KEY = ["vx", "vy", "vz"]


def with_path(points: DataFrame, size: float, layers: int) -> DataFrame:
    """points with voxel keys and path, a digit for each layer below the root."""
    keyed = points.select("*", *voxel_key([F.col(c) for c in "xyz"], size))
    digits = octant_digits([F.col(c) for c in "xyz"], voxel_centre([F.col(k) for k in KEY], size), size, layers)
    return keyed.withColumn("path", F.concat(*(d.cast("string") for d in digits)) if layers else F.lit(""))


def nodes(
    points: DataFrame, size: float, max_layer: int, min_eigen: float, ratio: Sequence[float], min_points: Sequence[int],
    split_points: Sequence[int] | None = None, keys: Sequence[str] = (), digits: int = 9,
) -> DataFrame:
    """Leaf nodes: keys, voxel, layer, path, n, mean (about the voxel's centre), covariance, eigenvalues and is_plane.

    A node with min_points[layer] points or fewer is no plane and isn't split. Otherwise it is a plane if its least
    eigenvalue is under min_eigen and under ratio[layer] of the largest, and else it is split below max_layer, given
    split_points[layer] points if that is set. Decisions are taken on values rounded to `digits`.
    """
    todo = with_path(points, size, max_layer).select(*keys, *KEY, "x", "y", "z", F.col("path").alias("full"))
    done, centre = None, voxel_centre([F.col(k) for k in KEY], size)
    for layer in range(max_layer + 1):
        todo = todo.withColumn("path", F.substring("full", 1, layer) if layer else F.lit(""))
        by = [*keys, *KEY, "path"]
        level = with_eigenvalues(with_covariance(moments(todo, by, centre), digits=digits), digits=digits).withColumn("layer", F.lit(layer))
        enough = F.col("n") > min_points[layer]
        level = level.withColumn("is_plane", enough & (F.col("l0") < min_eigen) & (F.col("l0") < ratio[layer] * F.col("l2")))
        splits = enough & ~F.col("is_plane") & (F.lit(layer) < max_layer)
        if split_points:
            splits = splits & (F.col("n") >= split_points[layer])
        level = stored(level.withColumn("splits", splits)) if max_layer else level.withColumn("splits", splits)
        leaf = level.where("NOT splits").drop("splits")
        done = leaf if done is None else done.unionByName(leaf)
        if layer < max_layer:
            todo = todo.join(level.where("splits").select(*by), by, "left_semi")
    return done.select(*keys, *KEY, "layer", "path", "n", "mx", "my", "mz", *("c" + s for s in SYM), "l0", "l1", "l2", "is_plane")


def scan_nodes(points: DataFrame, size: float, max_layer: int, min_eigen: float, ratio: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """nodes for one scan: three points are enough to fit, six to split."""
    return nodes(points, size, max_layer, min_eigen, ratio, [2] * (max_layer + 1), [6] * (max_layer + 1), keys)


def good_planes(found: DataFrame, max_ratio: float = 0.12, min_quality: float = 0.5) -> DataFrame:
    """Planes fit for matching normals, with quality 1 - l0 / trace and sigma_n, its complement's root."""
    trace = F.nullif(F.col("l0") + F.col("l1") + F.col("l2"), F.lit(0.0))
    flat = F.col("l0") / F.nullif(F.col("l1"), F.lit(0.0)) <= max_ratio
    planes = found.where(F.col("is_plane") & (F.col("l1") > 1e-12) & flat)
    return planes.withColumn("quality", 1 - F.col("l0") / trace).withColumn("sigma_n", F.sqrt(F.greatest(F.lit(0.0), F.col("l0")) / trace)).where(F.col("quality") > min_quality)

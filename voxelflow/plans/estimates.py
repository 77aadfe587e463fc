"""Registered queries that iterate or fold: SQL has no counterpart, so tests hold them against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.covariance import with_body_covariance
from ..functions.vectors import SYM, r6
from ..functions.voxel import voxel_key
from ..kernels.inertial import State
from ..kernels.rotation import exp
from ..operators import clusters, estimation, octree
from ..operators.deskew import deskewed
from ..operators.state import stored
from ..sources.tables import cloud, readings
from .sensor import DIGITS, LAYERS, LEAST, RATIO, SIZE, THIN, planes_of, query


def inertial_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as small turns and accelerations about gravity, a thousandth of their time apart."""
    t = (F.col("us") - 1704067200000000) / 1e9
    return readings(spark, sf_dir).select("session", t.alias("t"), *(((F.col("value") - 50) / 1e4 * k).alias(n) for n, k in (("gx", 1), ("gy", -2), ("gz", 3))), (F.col("value") / 1e3).alias("ax"), F.sin("id").alias("ay"), F.lit(9.8).alias("az"))


@query
def preintegrate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's readings as one preintegrated motion."""
    d = estimation.preintegrated(inertial_readings(spark, sf_dir), seconds=500.0)
    value = lambda k: F.element_at("values", k + 1)
    return d.select("session", r6(F.col("dt")).alias("dt"), *(r6(value(k)).alias(f"r{k // 3}{k % 3}") for k in range(9)), *(r6(value(9 + k), 3).alias("p" + a) for k, a in enumerate("xyz")), *(r6(value(12 + k), 4).alias("v" + a) for k, a in enumerate("xyz")))


@query
def deskew_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as points, moved by each session's readings to the end of their scan; a scan is 500 units of time of a session."""
    rates = inertial_readings(spark, sf_dir)
    points = readings(spark, sf_dir).where("kind = 'view'").select("session", ((F.col("us") - 1704067200000000) / 1e9).alias("t"), "id", (F.col("value") / 10 - 5).alias("x"), F.sin("id").alias("y"), F.cos("id").alias("z"))
    turn = F.floor(F.col("t") / 500).cast("long")
    scans = points.select("session", turn.alias("scan")).distinct().select("session", "scan", (F.col("scan") * 500.0).alias("begin"), (F.col("scan") * 500.0 + 500.0).alias("end"))
    moved = deskewed(points, rates, scans, bucket=500.0)
    return moved.select("session", "scan", "id", *(r6(F.col(c), 3).alias(c) for c in "xyz"))


@query
def plane_variance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of the whole voxels with the variance of their normals and centres, from each point's noise."""
    noisy = with_body_covariance(cloud(spark, sf_dir), 0.02, 0.05)
    keyed = noisy.select("*", *voxel_key([F.col(c) for c in "xyz"], SIZE))
    p = {a: F.col(a) - (F.col("v" + a) + 0.5) * SIZE for a in "xyz"}
    b = [[2 * p["x"], 0, 0], [p["y"], p["x"], 0], [p["z"], 0, p["x"]], [0, 2 * p["y"], 0], [0, p["z"], p["y"]], [0, 0, 2 * p["z"]], [1, 0, 0], [0, 1, 0], [0, 0, 1]]
    v = [[F.col("v" + "".join(sorted(i + j))) for j in "xyz"] for i in "xyz"]
    lit = lambda c: F.lit(float(c)) if isinstance(c, int) else c
    entry = lambda i, j: sum((lit(b[i][k]) * v[k][m] * lit(b[j][m]) for k in range(3) for m in range(3) if not (isinstance(b[i][k], int) and b[i][k] == 0) and not (isinstance(b[j][m], int) and b[j][m] == 0)), F.lit(0.0))
    noise = keyed.groupBy("vx", "vy", "vz").agg(*(F.sum(entry(i, j)).alias(f"b{i}{j}") for i in range(9) for j in range(i, 9)))
    noise = noise.select("vx", "vy", "vz", F.array(*(F.col(f"b{min(i, j)}{max(i, j)}") for i in range(9) for j in range(9))).alias("cov9"))
    found = octree.nodes(cloud(spark, sf_dir), SIZE, 0, THIN, RATIO, LEAST, digits=DIGITS).where("is_plane").join(noise, ["vx", "vy", "vz"])
    planes = estimation.planes_with_variance(found.select("vx", "vy", "vz", "n", "mx", "my", "mz", *("c" + s for s in SYM), "cov9"), ["vx", "vy", "vz"])
    at = lambda k: r6(F.element_at("plane_var", k + 1), 9)
    return planes.select("vx", "vy", "vz", r6(F.col("radius")).alias("radius"), *(at(7 * k).alias(f"var{k}") for k in range(6)))


def _state_row(spark: SparkSession, x: State, **more: float) -> DataFrame:
    values = {f"r{i}{k}": float(x.r[i, k]) for i in range(3) for k in range(3)} | {"p" + a: float(x.p[k]) for k, a in enumerate("xyz")} | more
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query
def register_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pose of scan 1, moved by a known motion, against the planes of the other scans."""
    every, motion = cloud(spark, sf_dir), State(r=exp([0.01, -0.005, 0.02]), p=np.array([0.03, -0.02, 0.01]))
    planes = planes_of(every.where("scan <> 1")).select("vx", "vy", "vz", "layer", F.col("path").alias("node"), "qx", "qy", "qz", "nx", "ny", "nz", F.col("l2").alias("radius"), (F.col("l0") / F.col("n")).alias("spread"))
    body = {"b" + a: sum((F.lit(float(motion.r[k, i])) * (F.col(c) - float(motion.p[k])) for k, c in enumerate("xyz")), F.lit(0.0)) for i, a in enumerate("xyz")}
    scan = with_body_covariance(every.where("scan = 1").select(*(v.alias(k) for k, v in body.items())), 0.02, 0.05, ("bx", "by", "bz"))
    prior = State(cov=State().cov * 1e-2)
    found, posed, used = estimation.register(stored(scan), planes, prior, SIZE, LAYERS)
    return _state_row(spark, found, posed=float(posed), rounds=float(used))


@query
def adjust_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of seven scans, each disturbed a little, by bundle adjustment over the voxels they share."""
    every = cloud(spark, sf_dir).select("*", *voxel_key([F.col(c) for c in "xyz"], SIZE)).withColumn("frame", F.col("scan") - 1)
    factors = clusters.moments(every, ["vx", "vy", "vz", "frame"])
    grouped = stored(estimation.grouped_factors(factors, ["vx", "vy", "vz"], "frame", 7))
    start = [State(r=exp([0, 0, 0.002 * k]), p=np.array([0.004 * k, -0.002 * k, 0.0])) for k in range(7)]
    found, costs = estimation.bundle_adjust(grouped, start, max_iter=5)
    rows = [(k, *(float(v) for v in x.p), *(float(v) for v in x.r[0]), float(costs[0]), float(costs[-1])) for k, x in enumerate(found)]
    return spark.createDataFrame(rows, "frame long, px double, py double, pz double, r00 double, r01 double, r02 double, first_cost double, last_cost double")

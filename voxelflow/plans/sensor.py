"""Registered queries on the driver's tables: points, voxels, octrees, joins and residuals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import so3
from ..functions.covariance import with_body_covariance, world_covariance
from ..functions.eigen import with_eigenvalues, with_normals
from ..functions.vectors import SYM, dot, r6
from ..functions.voxel import voxel_key
from ..operators import clusters, downsample, inertial, joins, lifecycle, octree, points, residuals
from ..operators.state import stored
from ..sources import lidar
from ..sources.sinks import tum_line
from ..sources.tables import cloud, raw_scans, readings, small_cloud

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ID = ["scan", "i", "pk", "sk"]
TURN, SHIFT = so3.euler(0.1, -0.2, 0.3), (0.4, -0.3, 0.2)
XYZ = ("x", "y", "z")
#: Settings of the plane queries: voxel size, layers, least eigenvalue, its ratio to the largest, points above which a node counts.
SIZE, LAYERS, THIN, RATIO, LEAST = 1.0, 2, 0.05, (0.25, 0.25, 0.25), (20, 20, 15)
DIGITS = 6


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = DIGITS) -> DataFrame:
    return df.select(*keys, *(r6(F.col(v), digits).alias(v) for v in values))


def planes_of(df: DataFrame) -> DataFrame:
    """Octree planes with world centres (qx, qy, qz) and normals."""
    found = octree.nodes(df, SIZE, LAYERS, THIN, RATIO, LEAST, digits=DIGITS).where("is_plane")
    centre = {"q" + a: (F.col("v" + a) + 0.5) * SIZE + F.round("m" + a, DIGITS) for a in "xyz"}
    return with_normals(stored(found.withColumns(centre)))


@query
def voxel_plane_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: moments, covariance and eigenvalues of each voxel, and whether it holds a plane."""
    cells = with_eigenvalues(clusters.with_covariance(clusters.voxel_moments(cloud(spark, sf_dir), SIZE), digits=DIGITS), digits=DIGITS)
    return cells.select("vx", "vy", "vz", "n", *(r6(F.col(k)).alias(k) for k in ("l0", "l1", "l2")), ((F.col("n") > 20) & (F.col("l0") < THIN) & (F.col("l0") < 0.25 * F.col("l2"))).alias("is_plane"))


@query
def voxel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).select(*ID, *voxel_key([F.col(c) for c in XYZ], 0.5))


@query
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.range_filter(cloud(spark, sf_dir), 1.5).select(*ID, *XYZ)


@query
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.decimate(cloud(spark, sf_dir), 3).select(*ID)


@query
def inside_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.inside_box(cloud(spark, sf_dir), (0.5, 0.0, -0.5), 1.0).select(*ID)


@query
def display_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = points.decimate(cloud(spark, sf_dir), 3)
    return shown.select(*ID, *points.jet_colour(F.col("intensity"), 0.0, 255.0))


@query
def voxel_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker ids of the voxels, each with the number of voxels that have it, and the place and colour (by its points) of the least of them."""
    held = cloud(spark, sf_dir).groupBy(*voxel_key([F.col(c) for c in XYZ], 0.1)).agg(F.count("*").alias("n"))
    centre = [(F.col("v" + a) + 0.5) * F.lit(0.1) for a in XYZ]
    shown = held.select(points.marker_id(centre, F.lit(0)).alias("id"), *(r6(c).alias(a) for a, c in zip(XYZ, centre, strict=True)), *points.jet_colour(F.col("n").cast("double"), 1.0, 16.0))
    return points.unique_markers(shown)


@query
def sensor_to_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and their covariances by the sensor's extrinsic."""
    body = points.into_body(cloud(spark, sf_dir), TURN, SHIFT, 0.02, 0.05)
    return body.select(*ID, "intensity", *(r6(F.col(c)).alias(c) for c in XYZ), *(r6(F.col("v" + c), 9).alias("v" + c) for c in SYM))


def _decoded(kind: str, every: int = 3, blind: float = 1.5) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = lidar.decode(raw_scans(spark, sf_dir), kind, every, blind)
        return out.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("i").alias("sum_i"), r6(F.avg("x")).alias("mean_x"), r6(F.avg("intensity"), 4).alias("mean_intensity"), r6(F.sum("t_off"), 4).alias("sum_t"))

    run.__name__ = "decode_" + kind
    return query(run)


for _kind in ("livox", "velodyne", "ouster", "hesai", "robosense", "xyz"):
    _decoded(_kind)


@query
def decode_velodyne_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point; a turn is 250 ids of a scan, so that a task holds little."""
    turns = raw_scans(spark, sf_dir).withColumn("scan_id", F.floor(F.col("i") / 250).cast("long") * 1000 + F.col("scan_id"))
    return lidar.decode(turns, "velodyne_untimed", 1, 0.5).select("scan_id", "i", "x", "y", "z", r6(F.col("t_off")).alias("t_off"))


@query
def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Livox points, each one whole: decimated, filtered, padded where a scan is empty, trimmed."""
    decoded = lidar.decode(raw_scans(spark, sf_dir), "livox", 3, 2.2)
    scans = spark.range(0, 12).select(F.col("id").alias("scan_id"))
    return lidar.trim_late(lidar.pad_empty_scans(decoded, scans)).select("scan_id", "i", "x", "y", "z", "intensity", r6(F.col("t_off"), 9).alias("t_off"))


@query
def rigid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.rigid_transform(cloud(spark, sf_dir), TURN, SHIFT), ID, XYZ)


@query
def point_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_body_covariance(cloud(spark, sf_dir), 0.02, 0.05), ID, ["v" + s for s in SYM], 9)


@query
def covariance_in_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = with_body_covariance(cloud(spark, sf_dir), 0.02, 0.05)
    diagonal = lambda v: [[F.lit(v if i == k else 0.0) for k in range(3)] for i in range(3)]
    world = world_covariance(TURN, diagonal(1e-4), diagonal(4e-4), [F.col(c) for c in XYZ])
    return body.select(*ID, *(r6(c, 9).alias("w" + s) for s, c in zip(SYM, world, strict=True)))


@query
def rotation_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = so3.exp([F.col(c) for c in XYZ])
    return small_cloud(spark, sf_dir).select("id", *(r6(r[i][k]).alias(f"r{i}{k}") for i in range(3) for k in range(3)))


def _turned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[list[Column]]]:
    r = so3.exp([F.col(c) * 0.2 for c in XYZ])
    df = small_cloud(spark, sf_dir).select("id", *(r[i][k].alias(f"r{i}{k}") for i in range(3) for k in range(3)))
    return df, [[F.col(f"r{i}{k}") for k in range(3)] for i in range(3)]


@query
def rotation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, r = _turned(spark, sf_dir)
    return df.select("id", *(r6(c).alias("w" + a) for a, c in zip("xyz", so3.log(r), strict=True)))


@query
def rotation_quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, r = _turned(spark, sf_dir)
    return df.select("id", *(r6(c).alias("q" + a) for a, c in zip("xyzw", so3.quaternion(r), strict=True)))


@query
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downsample.means(cloud(spark, sf_dir), 0.25, ["i", "scan", "pk", "sk"]), ["vx", "vy", "vz", "n", "intensity"], XYZ)


@query
def voxel_downsample_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = with_body_covariance(cloud(spark, sf_dir), 0.02, 0.05)
    return rounded(downsample.mean_covariances(body, 0.5), ["vx", "vy", "vz", "n"], [*XYZ, *("v" + s for s in SYM)], 8)


@query
def adaptive_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = downsample.adaptive(cloud(spark, sf_dir), 0.5, 330, ["i", "pk", "sk"])
    return rounded(out, ["scan", "vx", "vy", "vz", "n", "intensity", "size"], XYZ)


@query
def union_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cloud(spark, sf_dir)
    return rounded(downsample.union_means(every.where("scan <> 4"), every.where("scan = 4"), 0.5, ["i", "scan", "pk", "sk"]), ["vx", "vy", "vz", "n", "intensity"], XYZ)


@query
def voxel_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downsample.representatives(small_cloud(spark, sf_dir), 1.0, "id"), ["vx", "vy", "vz", "n", "id"], XYZ)


MEANS = ["mx", "my", "mz", *("c" + s for s in SYM)]


@query
def cluster_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.voxel_moments(cloud(spark, sf_dir), 0.5), ["vx", "vy", "vz", "n"], [m for m in clusters.MOMENTS if m != "n"])


@query
def cluster_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.with_covariance(clusters.voxel_moments(cloud(spark, sf_dir), 0.5)), ["vx", "vy", "vz", "n"], MEANS)


@query
def cluster_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cloud(spark, sf_dir)
    left = clusters.retract(clusters.voxel_moments(every, 0.5), clusters.voxel_moments(every.where("scan = 1"), 0.5), ["vx", "vy", "vz"])
    return rounded(left, ["vx", "vy", "vz", "n"], [m for m in clusters.MOMENTS if m != "n"])


@query
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.merge(clusters.voxel_moments(cloud(spark, sf_dir), 0.5, ["scan"]), ["vx", "vy", "vz"]), ["vx", "vy", "vz", "n"], [m for m in clusters.MOMENTS if m != "n"])


@query
def cluster_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = clusters.transform(clusters.moments(cloud(spark, sf_dir), ["scan"]), TURN, SHIFT, ["scan"])
    return rounded(clusters.with_covariance(moved), ["scan", "n"], MEANS)


@query
def sliding_window_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = cloud(spark, sf_dir).withColumn("frame", F.floor(F.col("pk") / 20).cast("long"))
    return rounded(clusters.with_covariance(clusters.sliding(clusters.moments(frames, ["frame"]), "frame", 10)), ["frame", "n"], MEANS)


@query
def octree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.with_path(cloud(spark, sf_dir), SIZE, 3).select(*ID, "vx", "vy", "vz", "path")


NODE = ["vx", "vy", "vz", "layer", "path", "n", "is_plane"]


@query
def octree_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(octree.nodes(cloud(spark, sf_dir), SIZE, LAYERS, THIN, RATIO, LEAST, digits=DIGITS), NODE, ["l0", "l1", "l2"])


@query
def scan_octree_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = octree.nodes(cloud(spark, sf_dir), SIZE, 1, 0.02, RATIO, [2, 2], [6, 6], ["scan"], 9)
    return rounded(found, ["scan", *NODE], ["l0", "l1", "l2"])


@query
def scan_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = octree.nodes(cloud(spark, sf_dir), SIZE, 1, 0.02, RATIO, [2, 2], [6, 6], ["scan"], 9)
    return rounded(octree.good_planes(found), ["scan", "vx", "vy", "vz", "layer", "path", "n"], ["l0", "quality", "sigma_n"])


@query
def plane_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes thin enough to enter bundle adjustment."""
    found = octree.nodes(cloud(spark, sf_dir), SIZE, LAYERS, THIN, RATIO, LEAST, digits=DIGITS)
    thin = found.where(F.col("is_plane") & (F.col("l0") <= 0.12 * F.col("l1")))
    return rounded(thin, ["vx", "vy", "vz", "layer", "path", "n"], ["l0", "l1"])


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return readings(spark, sf_dir).where(F.col("kind") == kind)


@query
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest error before each click of the session."""
    out = joins.asof(_kind(spark, sf_dir, "click").select("session", "us", "id"), _kind(spark, sf_dir, "error").select("session", "us", "id", "value"), ["session"], "us", ["id", "value"], bucket=86_400_000_000)
    return out.select("session", "id", "us", "right_us", "right_id", "right_value")


@query
def asof_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.asof(_kind(spark, sf_dir, "click").select("session", "us", "id"), _kind(spark, sf_dir, "error").select("session", "us", "id", "value"), ["session"], "us", ["id", "value"], how="inner")
    return out.select("session", "id", "us", "right_us", "right_id", "right_value")


@query
def interval_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.interval_slices(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "view"), ["session"], "us", "us", [r6(F.sum("value")).alias("total"), F.min("us").alias("first_us"), F.max("us").alias("last_us")])
    return out.select("session", F.col("us").alias("end_us"), "n", "total", "first_us", "last_us")


@query
def interval_slice_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans without point times: from the stamp before to this one, the first scan left out."""
    out = joins.interval_slices(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "view"), ["session"], "us", "us", [r6(F.sum("value")).alias("total")], least=1, need_later=False, drop_first=True)
    return out.select("session", F.col("us").alias("end_us"), "n", "total")


@query
def imu_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inertial.midpoints(readings(spark, sf_dir), ["session"], "us", ["value"]), ["session", "id"], ["dt", "mid_value"])


@query
def imu_static_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = readings(spark, sf_dir).select("session", "us", (F.col("value") / 100).alias("ax"), F.sin("id").alias("ay"), (F.col("value") / 40 - 1).alias("az"))
    return rounded(inertial.static_init(mine, ["session"], "us", ["ax", "ay", "az"]), ["session", "n", "scale"], ["mean_ax", "g_ax", "g_ay", "g_az"])


@query
def dead_reckon_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inertial.dead_reckon(readings(spark, sf_dir).withColumn("acc", (F.col("value") - 50) / 1e5), ["session"], "us", "acc", 1e-8)
    return rounded(out, ["session", "id"], ["speed", "place"])


@query
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = readings(spark, sf_dir).select("session", "us", F.col("value").alias("x"), F.sin("id").alias("y"))
    return rounded(inertial.path_length(walk, ["session"], ["us"], ["x", "y"]), ["session", "n"], ["length"])


@query
def travelled_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = readings(spark, sf_dir).select("session", "us", F.col("value").alias("x"), F.sin("id").alias("y"), F.lit(0.0).alias("z"))
    return rounded(inertial.travelled(walk, "session", "us"), ["session"], ["travelled"])


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of scan 1 on the planes of the others: equal voxel, path under the plane's node, near the plane and its centre."""
    every = cloud(spark, sf_dir)
    planes = planes_of(every.where("scan <> 1")).select("vx", "vy", "vz", "layer", F.col("path").alias("node"), "qx", "qy", "qz", "nx", "ny", "nz", F.col("l2").alias("radius"), F.col("l0").alias("spread"), F.col("n").alias("plane_n"))
    mine = octree.with_path(with_body_covariance(every.where("scan = 1"), 0.02, 0.05), SIZE, LAYERS)
    both = mine.join(planes, ["vx", "vy", "vz"]).where(F.expr("substring(path, 1, layer) = node"))
    n, d = [F.col("n" + a) for a in "xyz"], [F.col(a) - F.col("q" + a) for a in "xyz"]
    vn = [dot([F.col("v" + "".join(sorted(a + b))) for b in "xyz"], n) for a in "xyz"]
    both = both.withColumn("off", F.abs(dot(n, d))).withColumn("d2", dot(d, d)).withColumn("sigma", F.col("spread") / F.col("plane_n") + dot(n, vn))
    return both.where((F.col("d2") - F.col("off") * F.col("off") <= 9 * F.col("radius")) & (F.col("off") < 3 * F.sqrt("sigma")))


@query
def voxel_equi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cloud(spark, sf_dir)
    planes = planes_of(every.where("scan <> 1")).where("layer = 0").select("vx", "vy", "vz", F.col("n").alias("plane_n"))
    return joins.voxel_match(every.where("scan = 1"), planes, SIZE).select(*ID, "vx", "vy", "vz", "plane_n")


@query
def point_plane_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_matched(spark, sf_dir), [*ID, "vx", "vy", "vz", "node"], ["off", "sigma"])


@query
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residuals.point_to_plane(_matched(spark, sf_dir), [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], (0.0, 0.0, 0.0))
    sums = residuals.normal_equations(rows)
    return sums.select("n", *(r6(F.col(c) / F.nullif(F.col("n"), F.lit(0))).alias(c) for c in sums.columns if c != "n"))


@query
def degeneracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residuals.degeneracy(_matched(spark, sf_dir)), ["n", "well_posed"], ["l0", "l1", "l2"])


@query
def bundle_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least eigenvalue of each voxel over seven frames, each moved by its own small rotation about z."""
    every = cloud(spark, sf_dir).select("scan", *XYZ, *voxel_key([F.col(c) for c in XYZ], SIZE))
    factors = clusters.moments(every, ["vx", "vy", "vz", "scan"]).withColumnRenamed("scan", "frame")
    a = F.col("id") * 0.01
    zero, one = F.lit(0.0), F.lit(1.0)
    r = [[F.cos(a), -F.sin(a), zero], [F.sin(a), F.cos(a), zero], [zero, zero, one]]
    poses = spark.range(1, 8).select(F.col("id").alias("frame"), *(r[i][k].alias(f"r{i}{k}") for i in range(3) for k in range(3)), (a * 2).alias("tx"), (a * -1).alias("ty"), zero.alias("tz"))
    return rounded(residuals.bundle_residual(factors, poses, ["vx", "vy", "vz"], digits=DIGITS), ["vx", "vy", "vz", "n"], ["l0", "l1", "l2"])


@query
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What thin and thick voxels add to the cost over the frames."""
    each = bundle_residual(spark, sf_dir).withColumn("family", F.when(F.col("l0") < THIN, "thin").otherwise("thick"))
    return rounded(residuals.cost_breakdown(each, "family"), ["family", "n"], ["cost"])


@query
def neighbour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each point, the best of the voxel means around it by a Gaussian likelihood, and how many there are."""
    mine = small_cloud(spark, sf_dir)
    cells = mine.select(*voxel_key([F.col(c) for c in XYZ], 1.0), *XYZ).groupBy("vx", "vy", "vz").agg(*(F.avg(c).alias("q" + c) for c in XYZ))
    near = joins.neighbour27(mine, cells, 1.0)
    d2 = sum(((F.col(c) - F.col("q" + c)) * (F.col(c) - F.col("q" + c)) for c in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    score = F.round(F.exp(-d2 / 1.0) / F.sqrt(F.lit(0.5)), 9)
    best = near.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct(score.alias("score"), *((-F.col(v)).alias(v) for v in ("vx", "vy", "vz")))).alias("b"))
    return best.select("id", "n", r6(F.col("b.score")).alias("score"), *((-F.col("b." + v)).alias(v) for v in ("vx", "vy", "vz")))


@query
def normal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of scan 1 against the map's planes in their voxel and those around: the nearest whose normal is within about 45 degrees."""
    every = cloud(spark, sf_dir)
    scan = octree.good_planes(octree.nodes(every.where("scan = 1"), SIZE, 0, THIN, RATIO, [20], digits=DIGITS), max_ratio=1.0)
    scan = with_normals(scan).select(*((F.col("v" + a) + 0.5 + F.round("m" + a, DIGITS)).alias(a) for a in "xyz"), *(F.col("n" + a).alias("s" + a) for a in "xyz"), "quality", "sigma_n")
    world = planes_of(every.where("scan <> 1")).where("layer = 0").select("vx", "vy", "vz", "nx", "ny", "nz", "qx", "qy", "qz")
    near = joins.neighbour27(scan, world, SIZE)
    cosine = F.abs(dot([F.col("s" + a) for a in "xyz"], [F.col("n" + a) for a in "xyz"]))
    d = [F.col(a) - F.col("q" + a) for a in "xyz"]
    fit = near.withColumn("cosine", F.round(cosine, 6)).where("cosine >= 0.7").withColumn("d2", F.round(dot(d, d), 6))
    best = fit.groupBy("px", "py", "pz", "quality", "sigma_n").agg(F.min(F.struct("d2", "vx", "vy", "vz", "cosine")).alias("b"))
    weight = 0.1 * F.col("quality") / (F.col("sigma_n") * F.col("sigma_n") + 0.01)
    return best.select("px", "py", "pz", "b.vx", "b.vy", "b.vz", r6(F.col("b.d2")).alias("d2"), r6(F.col("b.cosine")).alias("cosine"), r6(weight, 4).alias("weight"))


@query
def knn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = small_cloud(spark, sf_dir)
    return joins.knn(mine, mine, 5, 1.0).select("id", "near", r6(F.col("d2")).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query
def knn5_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane n . a = -1 of each point's five nearest, by normal equations; kept where all of them fit it."""
    mine = small_cloud(spark, sf_dir)
    five = joins.knn(mine, mine, 5, 1.0).select("id", "near").join(mine.select(F.col("id").alias("near"), *XYZ), "near")
    fit = residuals.local_planes(five)
    worst = F.round(F.col("worst") * 1e4) / 1e4  # six digits before, so ties of four are common; SQL breaks them by the product
    return fit.select("id", *(r6(F.col(n), 4).alias(n) for n in ("nx", "ny", "nz")), worst.alias("worst"))


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels and when they were last touched, a point's part key standing for the distance travelled when it came, beside the distance now (one row)."""
    seen = cloud(spark, sf_dir).select(*voxel_key([F.col(c) for c in XYZ], 0.1), F.col("pk").cast("double").alias("travelled")).groupBy("vx", "vy", "vz").agg(F.max("travelled").alias("travelled"))
    now = cloud(spark, sf_dir).agg(F.max("pk").cast("double").alias("now"))
    return seen.crossJoin(F.broadcast(now))


@query
def ttl_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels touched within the last 700 m."""
    return lifecycle.evict(_touched(spark, sf_dir), F.col("now"), limit=700.0).select("vx", "vy", "vz", "travelled")


@query
def evict_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels left after a tick that removes at most 1,000 of those untouched for 100 m."""
    return lifecycle.evict_some(_touched(spark, sf_dir), F.col("now"), ["vx", "vy", "vz"], limit=100.0)[0].select("vx", "vy", "vz", "travelled")


@query
def path_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading as a pose, those of purchases moved as an adjusted window would move them."""
    path = readings(spark, sf_dir).select("id", "session", "kind", F.col("value").alias("x"), (F.col("value") / 7).alias("y"), F.lit(0.0).alias("z"))
    window = path.where("kind = 'purchase'").select("id", (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.5).alias("y"), F.lit(1.0).alias("z"))
    return rounded(lifecycle.revised(path, window, "id"), ["id", "session"], XYZ)


@query
def session_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and sums by session and epoch; each error resets the session."""
    every = lifecycle.epochs(readings(spark, sf_dir), F.col("kind") == "error", ["session"], ["us", "id"])
    return every.groupBy("session", "epoch").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def late_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as scans of a length of their own, and whether each begins before an earlier one of its session ends."""
    scans = readings(spark, sf_dir).select("session", "id", "us", F.col("us").alias("begin"), (F.col("us") + (F.col("value") * 1e7).cast("long")).alias("end"))
    return lifecycle.in_order(scans, ["session"], ["us", "id"], tolerance=10_000).select("session", "id", "late")


@query
def plane_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cloud(spark, sf_dir)
    flat = lambda df: octree.nodes(df, 0.5, 0, THIN, RATIO, [5], digits=DIGITS).where("is_plane").select("vx", "vy", "vz", "n")
    return lifecycle.changelog(flat(every.where("scan = 1")), flat(every.where("scan = 2")), ["vx", "vy", "vz"], ["n"])


@query
def tum_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = readings(spark, sf_dir).select("id", ((F.col("us") - 1704067200000000) / 1e6).alias("t"), F.col("value").alias("x"), (F.col("value") / 7).alias("y"), F.lit(0.0).alias("z"), *(F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.6), ("qw", 0.8))))
    return poses.select("id", tum_line().alias("line"))

"""Boundary cases of operators that the driver's tables don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.functions import so3
from voxelflow.functions.covariance import with_body_covariance
from voxelflow.functions.eigen import with_eigenvalues, with_normals
from voxelflow.functions.vectors import SYM
from voxelflow.functions.voxel import voxel_key
from voxelflow.kernels.inertial import State, preintegrate
from voxelflow.kernels.rotation import exp
from voxelflow.operators import clusters, downsample, estimation, inertial, joins, lifecycle, points, residuals
from voxelflow.sources import lidar
from voxelflow.sources.config import Config
from voxelflow.sources.sinks import write_tum


def test_voxel_keys_at_borders(spark):
    rows = [(-1.0, -0.5, 0.0), (-2.0, 0.999, 1.0), (-1.5, -0.0, 2.5)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x double, y double, z double").select(*voxel_key([F.col(c) for c in "xyz"], 1.0)).collect()]
    assert got == [(-2, -1, 0), (-3, 0, 1), (-2, 0, 2)]


def test_eigenvalues_and_normals(spark):
    rng = np.random.default_rng(0)
    mats = [a @ a.T for a in rng.normal(size=(40, 3, 3))] + [np.diag([1.0, 2, 3]), np.zeros((3, 3)), np.eye(3) * 2]
    rows = [(k, *(float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for k, m in enumerate(mats)]
    out = with_normals(with_eigenvalues(spark.createDataFrame(rows, "id long, " + ", ".join(f"c{s} double" for s in SYM)))).collect()
    for r in out:
        values, vectors = np.linalg.eigh(mats[r["id"]])
        assert np.allclose([r["l0"], r["l1"], r["l2"]], values, atol=1e-9)
        if values[1] - values[0] > 1e-3:
            assert np.isclose(abs(np.dot([r["nx"], r["ny"], r["nz"]], vectors[:, 0])), 1, atol=1e-6)


def test_retract_undoes_merge(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(int(k % 3), *map(float, rng.normal(size=3))) for k in range(90)], "scan long, x double, y double, z double")
    left = clusters.retract(clusters.voxel_moments(points, 1.0), clusters.voxel_moments(points.where("scan = 0"), 1.0), ["vx", "vy", "vz"])
    want = clusters.voxel_moments(points.where("scan > 0"), 1.0)
    key = lambda r: (r["vx"], r["vy"], r["vz"])
    a, b = sorted(left.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    assert np.allclose([[r[m] for m in clusters.MOMENTS] for r in a], [[r[m] for m in clusters.MOMENTS] for r in b], atol=1e-9)


@pytest.mark.parametrize("bucket", [None, 3, 1000])
def test_asof_is_strict_and_keeps_unmatched(spark, bucket):
    left = spark.createDataFrame([(1, 1), (1, 5), (1, 6), (1, 20), (2, 4)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 7, "c")], "k long, t long, v string")
    rows = lambda df: sorted((r["k"], r["t"], r["right_v"]) for r in df.collect())
    strict = joins.asof(left, right, ["k"], "t", ["v"], bucket=bucket)
    assert sorted(((r["k"], r["t"], r["right_v"]) for r in strict.collect()), key=repr) == [(1, 1, None), (1, 20, "c"), (1, 5, "a"), (1, 6, "b"), (2, 4, None)]
    assert rows(joins.asof(left, right, ["k"], "t", ["v"], how="inner", strict=False, bucket=bucket)) == [(1, 1, "a"), (1, 5, "b"), (1, 6, "b"), (1, 20, "c")]


def test_slices_need_five_rows_and_a_later_one(spark):
    scans = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (1, 40)], "k long, t long")
    samples = spark.createDataFrame([(1, t) for t in (1, 2, 3, 9, 10, 11, 12, 13, 20, 21, 22, 23, 24, 25, 31, 32, 33, 34, 35, 36)], "k long, t long")
    out = joins.interval_slices(scans, samples, ["k"], "t", "t", [F.min("t").alias("first")])
    assert sorted((r["t"], r["n"], r["first"]) for r in out.collect()) == [(10, 5, 1), (30, 5, 21)]


def test_knn_is_exact_far_apart(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(5, 3)) + 500])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    got = {(r["id"], r["rank"]): r["near"] for r in joins.knn(df, df, 5, 0.3).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(len(p)) for k, j in enumerate(np.argsort(d[i])[:5])}


def test_padding_and_trim(spark):
    raw = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 5.0, 0), (1, 1, 1.0, 0.0, 0.0, 5.0, 120_000_000), (2, 0, 0.1, 0.0, 0.0, 5.0, 0)], "scan_id long, i long, x double, y double, z double, reflectivity double, offset_time long")
    points = lidar.decode(raw, "livox", 1, 0.1)
    assert points.count() == 2
    padded = lidar.trim_late(lidar.pad_empty_scans(points, raw.select("scan_id")))
    assert sorted((r["scan_id"], r["t_off"], r["x"]) for r in padded.collect()) == [(1, 0.0, 1.0), (2, 0.0, 0.0), (2, 0.09, 0.0)]
    assert lidar.decode(raw, "unheard of").count() == 0


def test_untimed_scan_gets_times_from_its_turn(spark):
    angles = np.radians(170 - np.arange(0, 340, 2))
    raw = spark.createDataFrame([(1, k, float(5 * np.cos(a)), float(5 * np.sin(a)), 0.0) for k, a in enumerate(angles)], "scan_id long, i long, x double, y double, z double")
    out = lidar.decode(raw, "velodyne_untimed", 1, 0.5).orderBy("i").collect()
    assert np.allclose([r["t_off"] for r in out], [2 * r["i"] / lidar.OMEGA for r in out], atol=1e-9) and len(out) > 160


def test_bytes_to_numbers(spark):
    df = spark.createDataFrame([(bytearray(np.float32(1.5).tobytes()),), (bytearray(b"abc"),), (None,)], "b binary")
    assert [r[0] for r in df.select(lidar.bytes_to_numbers("b")).collect()] == [1.5, None, None]


def test_static_init_in_units_of_gravity(spark):
    df = spark.createDataFrame([(1, t, 0.0, 0.0, 1.0) for t in range(40)] + [(2, t, 0.0, 0.0, 9.81) for t in range(40)] + [(3, 0, 0.0, 0.0, 1.0)], "s long, t long, ax double, ay double, az double")
    out = {r["s"]: (r["scale"], r["g_az"]) for r in inertial.static_init(df, ["s"], "t", ["ax", "ay", "az"]).collect()}
    assert out == {1: (9.8, pytest.approx(-9.8)), 2: (1.0, pytest.approx(-9.81))}


def test_travelled_keeps_its_anchor_until_far_enough(spark):
    df = spark.createDataFrame([(1, k, 0.04 * k, 0.0, 0.0) for k in range(41)], "s long, f long, x double, y double, z double")
    assert inertial.travelled(df, "s", "f").first()["travelled"] == pytest.approx(1.6)


def test_changelog(spark):
    a, b = (spark.createDataFrame(r, "k long, v long") for r in ([(1, 1), (2, 2), (3, 3)], [(2, 2), (3, 4), (5, 5)]))
    assert sorted(tuple(r) for r in lifecycle.changelog(a, b, ["k"], ["v"]).fillna(-1).collect()) == [(1, "DELETE", -1), (3, "MODIFY", 4), (5, "ADD", 5)]


def test_representative_ties_go_to_the_least_id(spark):
    df = spark.createDataFrame([(5, 0.2, 0.5, 0.5), (3, 0.8, 0.5, 0.5)], "id long, x double, y double, z double")
    assert downsample.representatives(df, 1.0, "id").first()["id"] == 3


def test_preintegration_in_chunks_is_the_whole(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.01, 0.03, 200))
    g, a = rng.normal(size=(200, 3)), rng.normal(size=(200, 3))
    df = spark.createDataFrame([(1, float(t[k]), *map(float, g[k]), *map(float, a[k])) for k in range(200)], "session long, t double, gx double, gy double, gz double, ax double, ay double, az double")
    row = estimation.preintegrated(df, seconds=0.5).first()
    whole = preintegrate(t, g, a, np.zeros(3), np.zeros(3))
    assert np.allclose(row["values"], estimation._pack(whole), atol=1e-12) and row["dt"] == pytest.approx(whole.dt)


def test_registered_scan_and_window_come_closer(spark):
    from voxelflow.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    row = QUERIES["adjust_window"](spark, sf).first()
    assert row["last_cost"] <= row["first_cost"]
    assert QUERIES["plane_variance_map"](spark, sf).where("var0 < 0").count() == 0
    assert QUERIES["register_scan"](spark, sf).count() == 1


def test_scan_against_bare_points(spark):
    rng = np.random.default_rng(6)
    walls = [np.insert(rng.uniform(-3, 3, (250, 2)), axis, side, axis=1) for axis in range(3) for side in (-3.0, 3.0)]
    world = np.vstack(walls)
    truth = State(r=exp(np.array([0.01, -0.02, 0.03])), p=np.array([0.05, -0.04, 0.02]))
    seen = np.vstack([np.insert(rng.uniform(-2.5, 2.5, (20, 2)), axis, side, axis=1) for axis in range(3) for side in (-3.0, 3.0)])
    body = (seen - truth.p) @ truth.r
    frame = lambda p, names: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, " + ", ".join(f"{n} double" for n in names))
    found, posed, _ = estimation.register_to_points(frame(body, ("bx", "by", "bz")), frame(world, "xyz"), State(cov=np.eye(15) * 1e-2), 1.0)
    assert posed and np.linalg.norm(found.minus(truth)[:6]) < 0.01
    assert estimation.register_to_points(frame(body, ("bx", "by", "bz")), frame(world[:50], "xyz"), State(), 1.0)[2] == 0


def test_plane_variance_by_sampling():
    rng = np.random.default_rng(4)
    points = rng.uniform(-1, 1, (300, 3)) * [1, 1, 0.01]
    noise = np.diag([1e-4, 1e-4, 4e-4])
    cov9 = sum(estimation.point_noise9(p, noise) for p in points)
    mean = points.mean(axis=0)
    _, normal, _, var = estimation.plane_variance(300, mean, np.cov(points.T, bias=True), cov9)
    seen = []
    for _ in range(400):
        q = points + rng.multivariate_normal(np.zeros(3), noise, 300)
        n = np.linalg.eigh(np.cov(q.T, bias=True))[1][:, 0]
        seen.append(n * np.sign(n @ normal))
    assert np.allclose(np.cov(np.array(seen).T)[:2, :2], np.array(var).reshape(6, 6)[:2, :2], rtol=0.25, atol=2e-7)


def test_initialisation_finds_gravity(spark):
    from voxelflow.kernels.inertial import Noise

    truth_g = np.array([0.3, -0.2, -9.79])
    t = np.arange(0, 0.101, 0.01)
    delta = preintegrate(t, np.zeros((11, 3)), np.tile(-truth_g, (11, 1)), np.zeros(3), np.zeros(3), noise=Noise())
    rng = np.random.default_rng(5)
    rows = [(axis, side, 0, f, *map(float, p)) for f in range(3) for axis in range(3) for side in (-4, 4) for p in np.insert(rng.uniform(-4, 4, (40, 2)), axis, side, axis=1)]
    points = spark.createDataFrame(rows, "vx long, vy long, vz long, frame long, x double, y double, z double")
    grouped = estimation.grouped_factors(clusters.moments(points, ["vx", "vy", "vz", "frame"]), ["vx", "vy", "vz"], "frame", 3)
    start = [State(g=np.array([0.0, 0, -9.8])) for _ in range(3)]
    states, good = estimation.initialise(lambda _: grouped, start, [delta, delta], rounds=4)
    assert good and abs(np.linalg.norm(states[0].g) - np.linalg.norm(truth_g)) < 0.05 and np.allclose(states[0].g[:2], 0, atol=1e-6)


def test_config_inverts_ratios():
    c = Config.of({"a": {"plane_eigen_value_thre": [4.0, 4.0], "dept_err": 0.01}, "unknown": 1})
    assert c.plane_ratio == (0.25, 0.25) and c.range_error == 0.01 and c.voxel_size == 1.0


def test_trajectory_file(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)], "t double, x double, y double, z double, qx double, qy double, qz double, qw double")
    write_tum(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1.500000000 1.000000000 2.000000000 3.000000000 0.000000000 0.000000000 0.000000000 1.000000000"


def test_exp_of_nothing(spark):
    assert np.allclose(exp(np.zeros(3)), np.eye(3))


def test_deskewed_points_follow_the_kernels(spark):
    """Two sessions, two scans each, turning and speeding up: each point as the kernels move it; points and readings outside the scans don't count."""
    from voxelflow.kernels.inertial import State, deskew, propagate
    from voxelflow.operators.deskew import RATES, deskewed

    rng = np.random.default_rng(9)
    scans = [(s, k, 0.1 + 0.2 * k, 0.2 + 0.2 * k, 1.0 * s, 0.5, 0.0) for s in (1, 2) for k in (0, 1)] + [(3, 0, 0.0, 0.1, 0.0, 0.0, 0.0)]
    readings = [(s, 0.01 * i, *(rng.normal(size=3) * 0.3).tolist(), *(rng.normal(size=3) + [0, 0, 9.8]).tolist()) for s in (1, 2) for i in range(60)] + [(None, 0.15, *[0.0] * 6), (1, None, *[0.0] * 6)]
    points = [(s, float(t), i, *rng.normal(size=3).tolist()) for i, (s, t) in enumerate((s, t) for s in (1, 2, 3) for t in rng.uniform(0, 0.6, 40))] + [(1, None, 999, 0.0, 0.0, 0.0)]
    frames = spark.createDataFrame(points, "session long, t double, id long, x double, y double, z double"), spark.createDataFrame(readings, "session long, t double, " + ", ".join(f"{c} double" for c in RATES)), spark.createDataFrame(scans, "session long, scan long, begin double, end double, vx double, vy double, vz double")
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    for bucket in (None, 0.15):
        got = {r["id"]: (r["session"], r["scan"], r["x"], r["y"], r["z"]) for r in deskewed(*frames, bucket=bucket, rotation=turn.tolist(), offset=[0.1, 0, 0]).collect()}
        want = {}
        for s, k, begin, end, *v in scans:
            mine = [p for p in points if p[0] == s and p[1] is not None and begin < p[1] <= end]
            rates = [r for r in readings if r[0] == s and r[1] is not None and r[1] <= end]
            rates = [r for r in rates if r[1] > begin] + [max((r for r in rates if r[1] <= begin), default=None)] if rates else []
            rates = np.array(sorted(r[1:] for r in rates if r))
            xyz = np.array([p[3:] for p in mine]).reshape(-1, 3)
            if len(rates) > 1 and len(mine):
                x, poses = propagate(State(t=begin, v=np.array(v)), rates[:, 0], rates[:, 1:4], rates[:, 4:], begin, end)
                xyz = deskew(xyz, np.array([p[1] for p in mine]), poses, x, turn, np.array([0.1, 0, 0]))
            want |= {p[2]: (s, k, *q) for p, q in zip(mine, xyz.tolist(), strict=True)}
        assert got.keys() == want.keys() and len(got) > 20
        for i, w in want.items():
            assert got[i][:2] == w[:2] and got[i][2:] == pytest.approx(w[2:], abs=1e-9)


def test_jet_colours_at_knots_beyond_the_range_and_null(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 0.1242), (3, 0.25), (4, 0.5), (5, 0.8758), (6, 1.0), (7, 9.0), (8, None)], "i int, v double")
    got = [tuple(r) for r in df.select("i", *points.jet_colour(F.col("v"), 0.0, 1.0)).orderBy("i").select("red", "green", "blue").collect()]
    assert got == [(0, 0, 128), (0, 0, 128), (0, 0, 255), (0, 128, 255), (127, 255, 127), (255, 0, 0), (128, 0, 0), (128, 0, 0), (None, None, None)]


def test_markers_with_one_id_are_one_row_with_their_count(spark):
    rows = [(0.05, 0.05, 0.05, 0), (0.05, 0.05, 0.05, 0), (0.05, 0.05, 0.05, 1), (-0.05, 0.05, 0.05, 0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, layer int")
    ids = points.unique_markers(df.select(points.marker_id([F.col(c) for c in "xyz"], F.col("layer")).alias("id"), "x"))
    plain = [abs(round(x * 1000) * 73856093 ^ 50 * 19349663 ^ 50 * 83492791 ^ layer * 2654435761) & 0x7FFFFFFF for x, _, _, layer in rows]
    assert sorted((r.id, r.nodes) for r in ids.collect()) == sorted((i, plain.count(i)) for i in set(plain))


def test_sensor_noise_keeps_its_trace_when_turned(spark):
    turn, shift = so3.euler(0.1, -0.2, 0.3), (1.0, 2.0, 3.0)
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, -1.0, 0.0)], "x double, y double, z double")
    before = with_body_covariance(df, 0.02, 0.05).selectExpr("vxx + vyy + vzz AS t").collect()
    after = points.into_body(df, turn, shift, 0.02, 0.05).selectExpr("vxx + vyy + vzz AS t").collect()
    assert [r.t for r in after] == pytest.approx([r.t for r in before])


def test_a_tick_removes_the_longest_untouched(spark):
    df = spark.createDataFrame([(k, float(k // 2)) for k in range(10)], "vx long, travelled double")
    stay, gone = lifecycle.evict_some(df, 1000.0, ["vx"], most=3, limit=998.0)
    assert sorted(r.vx for r in gone.collect()) == [0, 1, 2] and sorted(r.vx for r in stay.collect()) == list(range(3, 10))


def test_a_revised_path_changes_only_the_window(spark):
    path = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "b"), (3, None, "c")], "frame int, x double, note string")
    new = spark.createDataFrame([(2, 5.0), (3, None), (9, 7.0)], "frame int, x double")
    assert sorted(map(tuple, lifecycle.revised(path, new, values=["x"]).collect())) == [(1, 0.0, "a"), (2, 5.0, "b"), (3, None, "c")]


def test_epochs_and_late_scans(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, False), (1, 0.995, 2.0, True), (1, 1.5, 1.6, False), (1, 2.0, 2.1, True), (2, 0.0, 1.0, False)], "s int, begin double, end double, reset boolean")
    rows = lifecycle.in_order(lifecycle.epochs(df, F.col("reset"), ["s"], ["begin"]), ["s"], ["begin"]).orderBy("s", "begin").collect()
    assert [r.epoch for r in rows] == [0, 1, 1, 2, 0] and [r.late for r in rows] == [False, False, True, False, False]
    assert lifecycle.in_order(df.limit(0), ["s"], ["begin"]).count() == 0


def test_cost_by_family(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "family string, l0 double")
    assert sorted(map(tuple, residuals.cost_breakdown(df, "family", weight=0.5).collect())) == [("a", 2, 1.5), ("b", 1, 2.0)]

"""Iterative estimation: the driver holds states of a few dozen numbers, the cluster matches and sums.

Each iteration is one job that returns one row (or a few small ones); maps and factors stay distributed and stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covariance import world_covariance
from ..functions.vectors import SYM, dot
from ..kernels import bundle
from ..kernels.filter import iterate
from ..kernels.inertial import DIM, Delta, Noise, State, gravity_to_z, preintegrate
from .clusters import MOMENTS
from .joins import knn
from .octree import with_path
from .residuals import local_planes, normal_equations, point_to_plane
from .state import stored

DELTA = "session long, part long, t0 double, t1 double, dt double, values array<double>"
_FIELDS = ("r", "p", "v", "r_bg", "p_bg", "p_ba", "v_bg", "v_ba", "cov")


def _pack(d: Delta) -> list[float]:
    return [float(x) for f in _FIELDS for x in np.ravel(getattr(d, f))]


def _unpack(dt: float, values: Sequence[float]) -> Delta:
    shapes = {"p": (3,), "v": (3,), "cov": (DIM, DIM)}
    out, at = {}, 0
    for f in _FIELDS:
        shape = shapes.get(f, (3, 3))
        n = int(np.prod(shape))
        out[f] = np.array(values[at : at + n]).reshape(shape)
        at += n
    return Delta(dt=dt, **out)


def preintegrated(readings: DataFrame, session: str = "session", time: str = "t", gyro: Sequence[str] = ("gx", "gy", "gz"), acc: Sequence[str] = ("ax", "ay", "az"), seconds: float = 10.0, bias: Sequence[float] = (0.0,) * 6, scale: float = 1.0) -> DataFrame:
    """DELTA of each session, in two phases: chunks of `seconds` are folded apart, then merged in order, so that a long session isn't one task's fold.

    A chunk starts with the last reading before it, so that no interval is lost between chunks.
    """
    bg, ba = np.array(bias[:3]), np.array(bias[3:])
    at = F.floor(F.col(time) / seconds).cast("long")
    cols = [F.col(session).cast("long").alias("session"), F.col(time).cast("double").alias("t"), *(F.col(c).cast("double").alias(n) for c, n in zip((*gyro, *acc), ("gx", "gy", "gz", "ax", "ay", "az"), strict=True))]
    rows = readings.select(*cols, at.alias("part"))
    last = rows.groupBy("session", "part").agg(F.max_by(F.struct("t", "gx", "gy", "gz", "ax", "ay", "az"), "t").alias("r"))
    from pyspark.sql import Window

    carried = last.select("session", F.lead("part").over(Window.partitionBy("session").orderBy("part")).alias("part"), "r.*").where("part IS NOT NULL")

    def fold(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("t")
        d = preintegrate(pdf.t.to_numpy(), pdf[["gx", "gy", "gz"]].to_numpy(), pdf[["ax", "ay", "az"]].to_numpy(), bg, ba, scale, Noise())
        return pd.DataFrame({"session": [pdf.session.iloc[0]], "part": [pdf.part.iloc[0]], "t0": [pdf.t.iloc[0]], "t1": [pdf.t.iloc[-1]], "dt": [d.dt], "values": [_pack(d)]})

    def merge(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("part")
        d = Delta()
        for dt, values in zip(pdf["dt"], pdf["values"], strict=True):
            d = d.then(_unpack(dt, values))
        return pd.DataFrame({"session": [pdf.session.iloc[0]], "part": [0], "t0": [pdf.t0.min()], "t1": [pdf.t1.max()], "dt": [d.dt], "values": [_pack(d)]})

    parts = rows.unionByName(carried).groupBy("session", "part").applyInPandas(fold, DELTA)
    return parts.groupBy("session").applyInPandas(merge, DELTA)


def planes_with_variance(leaves: DataFrame, keys: Sequence[str], cov9: str = "cov9") -> DataFrame:
    """keys, centre, normal, radius and the 6x6 plane_var (normal, centre) of plane leaves, to first order in the points' noise.

    leaves have n, mean (mx, my, mz) and covariance (cxx, ...) and cov9, the summed 9x9 noise of (second moments, mean).
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in leaves.dtypes if k in keys) + ", centre array<double>, normal array<double>, radius double, plane_var array<double>"

    def update(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                c = np.array([[row.cxx, row.cxy, row.cxz], [row.cxy, row.cyy, row.cyz], [row.cxz, row.cyz, row.czz]])
                out.append(plane_variance(row.n, np.array([row.mx, row.my, row.mz]), c, np.array(getattr(row, cov9)).reshape(9, 9)))
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=["centre", "normal", "radius", "plane_var"])], axis=1)

    return leaves.mapInPandas(update, schema)


def plane_variance(n: int, mean: np.ndarray, cov: np.ndarray, cov9: np.ndarray) -> tuple[list, list, float, list]:
    """centre, normal, radius and 6x6 variance; the normal's derivative sums over the other directions k the part of dC between k and it, over the gap of eigenvalues."""
    values, vectors = np.linalg.eigh(cov)
    u, jac = vectors[:, 0], np.zeros((3, 9))
    for k in (1, 2):
        w = vectors[:, k]
        outer = np.outer(w, u) + np.outer(u, w)
        second = [outer[0, 0] / 2, outer[0, 1], outer[0, 2], outer[1, 1] / 2, outer[1, 2], outer[2, 2] / 2]
        mixed = -((w @ mean) * u + (u @ mean) * w)
        jac += np.outer(w, np.concatenate([second, mixed])) / (n * (values[0] - values[k]))
    var, through = np.zeros((6, 6)), jac @ cov9
    var[:3, :3], var[:3, 3:] = through @ jac.T, through[:, 6:] / n
    var[3:, :3], var[3:, 3:] = var[:3, 3:].T, cov9[6:, 6:] / n**2
    return mean.tolist(), u.tolist(), float(values[2]), var.ravel().tolist()


def point_noise9(p: np.ndarray, var: np.ndarray) -> np.ndarray:
    """The 9x9 covariance of a point's (xx, xy, xz, yy, yz, zz, x, y, z) with noise var."""
    x, y, z = p
    b = np.array([[2 * x, 0, 0], [y, x, 0], [z, 0, x], [0, 2 * y, 0], [0, z, y], [0, 0, 2 * z], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    return b @ var @ b.T


def match_planes(points: DataFrame, planes: DataFrame, x: State, size: float, layers: int) -> DataFrame:
    """Body points (bx, by, bz with covariance vxx, ...) on the planes (voxel, layer, node, nx.., qx.., radius, spread) that they fall near at pose x."""
    r, body = x.r.tolist(), [F.col("b" + a) for a in "xyz"]
    world = {a: dot([F.lit(v) for v in row], body) + F.lit(float(t)) for a, row, t in zip("xyz", r, x.p, strict=True)}
    cov = lambda m: [[F.lit(float(v)) for v in row] for row in m]
    moved = points.withColumns(world).withColumns(dict(zip(("w" + s for s in SYM), world_covariance(r, cov(x.cov[:3, :3]), cov(x.cov[3:6, 3:6]), body), strict=True)))
    both = with_path(moved, size, layers).join(planes, ["vx", "vy", "vz"]).where(F.expr("substring(path, 1, layer) = node"))
    n, d = [F.col("n" + a) for a in "xyz"], [F.col(a) - F.col("q" + a) for a in "xyz"]
    noise = [dot([F.col("w" + "".join(sorted(a + b))) for b in "xyz"], n) for a in "xyz"]
    both = both.withColumn("off", F.abs(dot(n, d))).withColumn("d2", dot(d, d)).withColumn("sigma", F.col("spread") + dot(n, noise))
    return both.where((F.col("d2") - F.col("off") * F.col("off") <= 9 * F.col("radius")) & (F.col("off") < 3 * F.sqrt("sigma")))


def register(points: DataFrame, planes: DataFrame, prior: State, size: float, layers: int, max_iter: int = 4, least_scatter: float = 14.0) -> tuple[State, bool, int]:
    """The pose of a scan against a stored map of planes: one aggregate of 29 sums and six for the normals in each iteration."""

    def match(x: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = point_to_plane(match_planes(points, planes, x, size, layers), x.r.tolist(), x.p.tolist(), point=("bx", "by", "bz"))
        return _equations(rows)

    return iterate(prior, match, max_iter, least_scatter=least_scatter)


def register_to_points(points: DataFrame, world: DataFrame, prior: State, cell: float, max_iter: int = 4, least_points: int = 100, worst: float = 0.1, id_col: str = "id") -> tuple[State, bool, int]:
    """The pose of a scan (id, bx, by, bz) against a map of bare points (id, x, y, z), before there are planes: each point's five nearest give its plane.

    The map needs `least_points`; without them the prior stays, and the scan is only to be inserted. Residuals aren't
    weighted, and the prior counts a thousandth.
    """
    if world.limit(least_points).count() < least_points:
        return prior, False, 0

    def match(x: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        body = [F.col("b" + a) for a in "xyz"]
        moved = stored(points.withColumns({a: dot([F.lit(v) for v in row], body) + F.lit(float(t)) for a, row, t in zip("xyz", x.r.tolist(), x.p.tolist(), strict=True)}))
        five = knn(moved, world, 5, cell, id_col, same=True).select("id", "near").join(world.select(F.col(id_col).alias("near"), "x", "y", "z"), "near")
        length = F.sqrt(dot([F.col("n" + a) for a in "xyz"], [F.col("n" + a) for a in "xyz"]))
        planes = local_planes(five, worst).withColumn("__len", length)
        planes = planes.select(F.col("id").alias(id_col), *((F.col("n" + a) / F.col("__len")).alias("n" + a) for a in "xyz"), (1 / F.col("__len")).alias("__d"))
        rows = stored(moved.join(planes, id_col).withColumns({"q" + a: -F.col("n" + a) * F.col("__d") for a in "xyz"}).withColumn("sigma", F.lit(0.9995)))
        return _equations(point_to_plane(rows, x.r.tolist(), x.p.tolist(), point=("bx", "by", "bz")))

    return iterate(prior, match, max_iter, prior_scale=1e-3)


def _equations(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One aggregate, so that the match runs once."""
    sums = normal_equations(rows, more=[F.sum(F.col("n" + s[0]) * F.col("n" + s[1])).alias("c" + s) for s in SYM]).first()
    if not sums["n"]:
        return np.zeros((6, 6)), np.zeros(6), np.zeros((3, 3))
    h = np.array([[sums[f"h{min(a, b)}{max(a, b)}"] for b in range(6)] for a in range(6)])
    g = np.array([sums[f"g{a}"] for a in range(6)])
    c = {s: sums["c" + s] for s in SYM}
    return h, g, np.array([[c["xx"], c["xy"], c["xz"]], [c["xy"], c["yy"], c["yz"]], [c["xz"], c["yz"], c["zz"]]])


def grouped_factors(factors: DataFrame, voxel: Sequence[str], frame: str, frames: int) -> DataFrame:
    """A row for each voxel with its clusters by frame; a window has a fixed number of frames, so rows are bounded."""
    return factors.where(F.col(frame) < frames).groupBy(*voxel).agg(F.collect_list(F.struct(frame, *MOMENTS)).alias("clusters"))


def bundle_adjust(grouped: DataFrame, states: list[State], deltas: Sequence[Delta] = (), max_iter: int = 10, gravity: bool = False) -> tuple[list[State], list[float]]:
    """Poses of a window from its voxels' clusters (`grouped_factors`, stored) and inertial deltas.

    Partitions sum their voxels' gradients and Hessians (6 numbers a frame, and their square), the cluster sums those, and
    the driver solves.
    """
    n = len(states)

    def terms(frames: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = grouped.mapInPandas(_partial(frames, n, True), "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
        total = np.zeros(1 + 6 * n + 36 * n * n)
        for at, part in parts.groupBy("at").agg(F.sum("part")).collect():  # as many rows as numbers, whatever the partitions
            total[at] = part
        return float(total[0]), total[1 : 1 + 6 * n], total[1 + 6 * n :].reshape(6 * n, 6 * n)

    def cost(frames: np.ndarray) -> float:
        return grouped.mapInPandas(_partial(frames, n, False), "sums array<double>").agg(F.sum(F.get("sums", F.lit(0)))).first()[0] or 0.0

    return bundle.adjust(states, terms, cost, deltas, gravity, max_iter)


def _partial(frames: np.ndarray, n: int, derivatives: bool) -> Callable:
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        total = None
        for pdf in batches:
            s = np.zeros((len(pdf), n, 4, 4))
            of = np.repeat(np.arange(len(pdf)), [len(found) for found in pdf["clusters"]])
            flat = np.array([tuple(c.values()) if isinstance(c, dict) else tuple(c) for found in pdf["clusters"] for c in found], float).reshape(-1, 2 + 9)
            s[of, flat[:, 0].astype(int)] = flat[:, _PLACES]
            zero, one = np.zeros((len(pdf), 4, 4)), np.ones(len(pdf))
            if derivatives:
                c, g, h = bundle.lidar_terms(s, frames, zero, one)
                part = np.concatenate([[c], g, h.ravel()])
            else:
                part = np.array([bundle.lidar_cost(s, frames, zero, one)])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [total.tolist()]})

    return run


#: Columns of a cluster row (frame, n, x, y, z, xx, xy, xz, yy, yz, zz) in its 4x4 moment matrix.
_PLACES = np.array([[5, 6, 7, 2], [6, 8, 9, 3], [7, 9, 10, 4], [2, 3, 4, 1]])


def initialise(grouped_of: Callable[[list[State]], DataFrame], states: list[State], deltas: Sequence[Delta], rounds: int = 10, steps: int = 3, tol: float = 0.01, gravity: tuple[float, float] = (9.6, 10.0)) -> tuple[list[State], bool]:
    """States of a first window with gravity: rebuild the map, adjust with gravity, until costs settle; then turn gravity to z.

    grouped_of gives the factors of the map at these states. Succeeds if gravity's length is in range.
    """
    settled = False
    for _ in range(rounds):
        states, costs = bundle_adjust(grouped_of(states), states, deltas, steps, gravity=True)
        done = len(costs) > 1 and abs(costs[0] - costs[-1]) <= tol * abs(costs[0])
        if done and settled:
            break
        if done:
            states, settled = gravity_to_z(states), True
    g = float(np.linalg.norm(states[0].g))
    return [replace(s) for s in states], gravity[0] <= g <= gravity[1]

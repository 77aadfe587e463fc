"""Nearest neighbours: dense clouds, copies and odd rows, against brute force and SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from voxelflow.kernels import nearest
from voxelflow.operators import joins, residuals
from voxelflow.operators import nearest as spread
from voxelflow.plans.oracles import ORACLES
from voxelflow.plans.registry import QUERIES

POINT = "id long, x double, y double, z double"


def brute(q, ids, p, names, k, same):
    """(id, near, d2, rank) by comparing all."""
    out = set()
    for i, a in zip(ids, q, strict=True):
        d = a - p
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        order = [j for j in np.lexsort((names, d2)) if same or names[j] != i][:k]
        out |= {(int(i), int(names[j]), float(d2[j]), r + 1) for r, j in enumerate(order)}
    return out


def frame(spark, ids, p):
    return spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, p, strict=True)], POINT)


def rows(df):
    return {(r["id"], r["near"], r["d2"], r["rank"]) for r in df.collect()}


def moved(spark, before=-1):
    """Bytes shuffled and spilled by the stages after stage `before`, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    new = [s for s in (stages.apply(k) for k in range(stages.size())) if s.stageId() > before]
    return sum(s.shuffleWriteBytes() + s.memoryBytesSpilled() for s in new), max([before, *(s.stageId() for s in new)])


def test_a_dense_cloud_moves_points_and_no_pairs(spark):
    """All points lie in one voxel of the size given."""
    p = np.random.default_rng(4).random((12_000, 3))
    df = frame(spark, range(len(p)), p)
    _, last = moved(spark)
    got = rows(joins.knn(df, df, 5, 1.0))
    assert moved(spark, last)[0] < 1000 * len(p)
    some = np.arange(0, len(p), 400)
    assert {r for r in got if r[0] % 400 == 0} == brute(p[some], some, p, np.arange(len(p)), 5, False) and len(got) == 5 * len(p)


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(5)
    for trial in range(40):
        m, n, k, same = int(rng.integers(1, 500)), int(rng.integers(1, 50)), int(rng.integers(1, 8)), bool(trial % 2)
        p, q = (rng.integers(0, 4, (m, 3)).astype(float), rng.integers(-1, 5, (n, 3)).astype(float)) if trial % 3 else (rng.normal(size=(m, 3)), rng.normal(size=(n, 3)) * 5)
        names, ids = rng.permutation(2 * m)[:m], rng.permutation(2 * m + n)[:n]
        at, d2, near = nearest.search(p, names, q, ids, np.full(n, np.inf), k, same)
        rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
        assert {(int(ids[a]), int(b), float(c), int(r)) for a, b, c, r in zip(at, near, d2, rank, strict=True)} == brute(q, ids, p, names, k, same)


@pytest.mark.parametrize("same", [False, True])
def test_many_leaves_slices_and_rounds(spark, monkeypatch, same):
    """Leaves of some eight points and slices of 20 queries; points on a sphere, so that a query at its centre goes on for rounds."""
    for name, v in (("LARGE", 8), ("SMALL", 8), ("SAMPLED", 8), ("SLICE", 20)):
        monkeypatch.setattr(spread, name, v)
    rng = np.random.default_rng(6)
    ball = rng.normal(size=(500, 3))
    p = np.vstack([ball / np.linalg.norm(ball, axis=1)[:, None], np.zeros((60, 3)), rng.integers(0, 3, (300, 3)) + 5.0, [[900.0, 0, 0]]])
    q = np.vstack([p[::2], np.zeros((50, 3)) + 0.01, [[-4000.0, 0, 0]]])
    names, ids = rng.permutation(len(p)), rng.permutation(len(p))[: len(q)]
    assert rows(joins.knn(frame(spark, ids, q), frame(spark, names, p), 5, 1.0, same=same)) == brute(q, ids, p, names, 5, same)


@pytest.mark.parametrize("many", [True, False])
def test_odd_rows_as_in_sql(spark, tmp_path, many):
    """Copies, repeated ids, unknown, NaN and infinite coordinates, and fewer points than neighbours."""
    inf, nan = float("inf"), float("nan")
    points = [(k, [k / 7, (k * k % 11) / 5, 0.25]) for k in range(40 if many else 3)] + [(100 + k, [1.0, 1.0, 1.0]) for k in range(20 if many else 0)]
    points += [(3, [0.5, 0.5, 0.5]), (4, [4 / 7, 1.0, 0.25]), (1, [1 / 7, 0.2, 0.25])]
    points += [(200, [None, 1.0, 1.0]), (201, None), (202, [nan, 0.0, 0.0]), (203, [inf, 0.0, 0.0]), (204, [inf, 1.0, 0.0]), (205, [-inf, 0.0, 0.0]), (206, [nan, None, inf]), (2, [0.0, inf, 0.0]), (None, [0.0, 0.0, 0.0])]
    ids, vectors = zip(*points, strict=True)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("knn5", "knn5_plane") if many else ("knn5",):
        found = con.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_planes_round_as_in_sql(spark):
    """Scale 0.1 has ties in the fourth digit of worst."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(ORACLES["knn5_plane"])
    names = [c[0] for c in found.description]
    assert sorted(map(tuple, QUERIES["knn5_plane"](spark, sf).select(*names).collect())) == sorted(found.fetchall())


def test_planes_shuffle_their_points_once(spark):
    rng = np.random.default_rng(7)
    n = 20_000
    df = spark.createDataFrame(pa.table({"id": np.tile(np.arange(n), 5), **dict(zip("xyz", rng.normal(size=(3, 5 * n)), strict=True))}).to_pandas(), POINT)
    _, last = moved(spark)
    assert residuals.local_planes(df, worst=1e9).count() > 0.9 * n
    assert moved(spark, last)[0] < 60 * 5 * n

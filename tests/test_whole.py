"""Registered sensor queries read their whole tables."""

from collections import defaultdict
from math import atan2, degrees

import duckdb
import numpy as np
import pytest

from voxelflow.operators import downsample
from voxelflow.plans.oracles import ORACLES
from voxelflow.plans.registry import QUERIES
from voxelflow.sources.lidar import unwrapped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spread(tmp_path_factory):
    """The smallest lineitem with ids up to 4,500."""
    at = tmp_path_factory.mktemp("spread")
    duckdb.execute(f"COPY (SELECT * REPLACE (l_orderkey * 3 AS l_orderkey) FROM '{SF}/lineitem.parquet') TO '{at}/lineitem.parquet' (FORMAT parquet)")
    return str(at)


def turn_times(points, blind):
    """(i, x, y, z, t) of the kept points of a turn, from states (turns, one turn up, rises left to ignore) by a table of the step between neighbours."""
    points = [(i, x, y, z, degrees(atan2(y, x))) for i, x, y, z in sorted(points) if abs(x) >= 0.1]
    inside = [x * x + y * y + z * z < blind * blind for _, x, y, z, _ in points]
    states, before = {}, None
    for k, p in enumerate(points):
        if before is None:
            states[k], before = (0, 0, 0), k
        elif not inside[k]:
            step = p[4] - points[before][4]
            turns, up, left = states[before]
            kind = "rise" if step > 180 else "fall" if step < -180 else "half" if step == 180 else "flat"
            states[k] = {
                (0, "rise"): (turns, 1, left - 1) if left else (turns + 1, 0, 1000), (0, "fall"): (turns, 1, left), (0, "half"): (turns, 0, left), (0, "flat"): (turns, 0, left),
                (1, "rise"): (turns, 0, left), (1, "fall"): (turns, 1, left), (1, "half"): (turns, 0, left), (1, "flat"): (turns, 1, left),
            }[up, kind]
            before = k
    out = []
    for k, (turns, up, _) in states.items():
        t = (points[0][4] - points[k][4] - 360 * (up - turns)) / 3610
        if not inside[k] and 0 <= t < 0.1:
            out.append((*points[k][:4], t))
    return out


def test_a_turning_sensor_gets_its_times_back():
    t = np.arange(0, 0.099, 1e-4)
    yaw = (170 - 3610 * t + 180) % 360 - 180
    assert np.allclose((170 - unwrapped(yaw)) / 3610, t)
    assert unwrapped(np.array([])).size == 0 and unwrapped(np.array([5.0])).tolist() == [5.0]


def test_untimed_scans_are_decoded_whole(spark, spread):
    rows = duckdb.sql(f"SELECT l_linenumber, l_orderkey, (l_quantity - 25) / 7, (l_extendedprice - 50000) / 20999.3, (l_discount - 0.05) * 130 / 3.1 FROM '{spread}/lineitem.parquet'").fetchall()
    turns = defaultdict(list)
    for scan, i, *p in rows:
        turns[i // 250 * 1000 + scan].append((i, *map(float, p)))
    want = sorted((k, *p) for k, points in turns.items() for p in turn_times(points, 0.5))
    got = sorted((r["scan_id"], r["i"], r["x"], r["y"], r["z"], r["t_off"]) for r in QUERIES["decode_velodyne_untimed"](spark, spread).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want] and max(r[1] for r in got) > 4000
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-6)


def same_as_sql(spark, name, sf=SF):
    """The query gives the rows of its SQL."""
    sql = ORACLES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    tidy = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = tidy(found.fetchall())
    assert tidy(map(tuple, QUERIES[name](spark, sf).select(*names).collect())) == want
    return [dict(zip(names, r, strict=True)) for r in want]


def test_adaptive_downsample_reads_whole_scans(spark):
    rows = same_as_sql(spark, "adaptive_downsample")
    assert sum(r["n"] for r in rows) == 6000


def test_adaptive_halves_the_size_of_scans_with_few_voxels(spark):
    points = [(1, i, 0.1 + 0.2 * i, 0.1, 0.1, float(i)) for i in range(4)] + [(2, i, 0.25 + 0.5 * i, 0.1, 0.1, float(i)) for i in range(3)]
    out = downsample.adaptive(spark.createDataFrame(points, "scan long, i long, x double, y double, z double, intensity double"), 0.5, 3, ["i"])
    assert sorted((r["scan"], r["vx"], r["n"], r["size"]) for r in out.collect()) == [(1, 0, 1, 0.25), (1, 1, 1, 0.25), (1, 2, 2, 0.25), (2, 0, 1, 0.5), (2, 1, 1, 0.5), (2, 2, 1, 0.5)]


def test_plane_changelog_fits_whole_scans(spark):
    rows = same_as_sql(spark, "plane_changelog", sf="/root/testdata/sf0.01")
    assert {r["op"] for r in rows} == {"ADD", "DELETE", "MODIFY"}


def test_union_downsample_joins_all_scans(spark):
    rows = same_as_sql(spark, "union_downsample")
    assert sum(r["n"] for r in rows) == 6000

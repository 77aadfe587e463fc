"""Each registered sensor query against its DuckDB counterpart, row for row."""

import duckdb
import pytest

from voxelflow.plans.oracles import ORACLES
from voxelflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(r[k] for k in at) for r in found.fetchall()]
    assert canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(expected)


def test_every_query_but_kernels_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"decode_velodyne_untimed", "travelled_distance", "preintegrate_sessions", "register_scan", "adjust_window", "deskew_scan", "plane_variance_map"}

"""Streams replayed with available-now triggers against the same operators in batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.operators.clusters import MOMENTS
from voxelflow.streaming.state import counted_slices, marginalise, slice_stream, voxel_map


def replay(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.table(name)


def test_marginalise_folds_then_forgets():
    fixed, window = np.zeros(len(MOMENTS)), np.ones((3, len(MOMENTS)))
    fixed, frames, left = marginalise(fixed, [1, 2, 3], window, 12, 10, 1)
    assert frames == [3] and len(left) == 1 and fixed[0] == 1  # the second frame to leave finds the fixed part full


def test_sliced_stream_counts_as_batch(spark, tmp_path):
    base = "timestamp'2024-01-01 00:00:00'"
    at = lambda s: F.expr(base) + F.make_interval(secs=s)
    spark.range(0, 20).select((F.col("id") % 2).alias("k"), at(F.col("id") * 10).alias("b"), at(F.col("id") * 10 + 10).alias("e")).write.parquet(str(tmp_path / "scans"))
    spark.range(0, 2200).select((F.col("id") % 2).alias("k"), at(F.col("id") * 0.1).alias("ts"), F.col("id").alias("v")).write.parquet(str(tmp_path / "samples"))
    scans = spark.readStream.schema("k long, b timestamp, e timestamp").parquet(str(tmp_path / "scans"))
    samples = spark.readStream.schema("k long, ts timestamp, v long").parquet(str(tmp_path / "samples"))
    out = replay(slice_stream(scans, samples, ["k"], "b", "e", "ts"), "slices", "append", tmp_path / "c1")
    batch = slice_stream(spark.read.parquet(str(tmp_path / "scans")), spark.read.parquet(str(tmp_path / "samples")), ["k"], "b", "e", "ts")
    key = lambda df: sorted((r["k"], r["e"], r["v"]) for r in df.collect())
    assert key(out) == key(batch) and len(key(batch)) == 1000
    counted = counted_slices(batch, ["k"], "e").collect()
    assert {r["n"] for r in counted} == {50} and len(counted) == 20


def test_voxel_map_stream_keeps_window_and_fixed_points(spark, tmp_path):
    rng = np.random.default_rng(0)
    for f in range(6):
        p = rng.normal(size=(30, 3))
        rows = [(0, 0, 0, f, 30, *p.sum(axis=0), *(float((p[:, i] * p[:, j]).sum()) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))))]
        rows = [tuple(float(x) if k > 4 else int(x) for k, x in enumerate(r)) for r in rows]
        spark.createDataFrame(rows, "vx long, vy long, vz long, frame long, n long, " + ", ".join(f"{m} double" for m in MOMENTS[1:])).coalesce(1).write.parquet(str(tmp_path / f"in/f={f}"))
    schema = "vx long, vy long, vz long, frame long, n long, " + ", ".join(f"{m} double" for m in MOMENTS[1:])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = replay(voxel_map(stream, size=3, most=50), "voxels", "update", tmp_path / "c2").collect()
    assert len(out) == 6
    last = max(out, key=lambda r: r["frame"])
    assert (last["n_fixed"], last["n_window"], last["active"]) == (60, 90, True)
    assert last["l0"] == pytest.approx(1.0, abs=0.5)


def test_long_scans_are_refused_or_whole(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} string" for n in names)).select("k", *(F.col(n).cast("timestamp").alias(n) for n in names))
    scans = frame([(1, "2024-01-01 00:00:00", "2024-01-01 02:00:00")], ["b", "e"])
    samples = frame([(1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:30:00")], ["ts"])
    with pytest.raises(Exception, match="longer than 1 hour"):
        slice_stream(scans, samples, ["k"], "b", "e", "ts").collect()
    assert slice_stream(scans, samples, ["k"], "b", "e", "ts", longest="2 hours").count() == 2


def test_voxel_map_forgets_voxels_that_are_not_seen(spark, tmp_path):
    """Over 12 frames, each with a new voxel, the state holds the voxels of the last few seconds only."""
    schema = "vx long, vy long, vz long, frame long, ts timestamp, n long, " + ", ".join(f"{m} double" for m in MOMENTS[1:])
    for f in range(12):
        rows = spark.range(1).selectExpr(f"{f}L vx", "0L vy", "0L vz", f"{f}L frame", f"timestamp'2024-01-01 00:00:00' + INTERVAL {10 * f} SECONDS ts", "10L n", *(f"CAST({k} AS DOUBLE) {m}" for k, m in enumerate(MOMENTS[1:], 1)))
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/f={f:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = voxel_map(stream, size=3, most=50, time="ts", ttl="25 seconds").writeStream.format("memory").queryName("forgets").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    out = spark.table("forgets").collect()
    gone = {r["vx"] for r in out if r["removed"]}
    assert max(kept) <= 6 and len(gone) >= 6 and gone == set(range(len(gone))) and not any(r["active"] for r in out if r["removed"])

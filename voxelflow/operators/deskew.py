"""De-skewing scans: readings carried through a scan give the sensor's pose at each point's time, and points move to where the sensor saw them from at the scan's end."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.inertial import State, deskew, propagate
from .joins import asof

RATES = ("gx", "gy", "gz", "ax", "ay", "az")


def in_scans(rows: DataFrame, scans: DataFrame, keys: Sequence[str] = ("session",), time: str = "t", bucket: float | None = None) -> DataFrame:
    """rows with the scan (its `scan`, `begin` and `end`) whose (begin, end] their time lies in; scans of a key don't overlap. One sorted pass: each row meets the last scan that begins before it."""
    begun = scans.select(*keys, F.col("begin").alias(time), "scan", "end")
    met = asof(rows, begun, keys, time, ["scan", "end"], how="inner", bucket=bucket)
    return met.where(F.col(time) <= F.col("right_end")).select(*rows.columns, F.col("right_scan").alias("scan"), F.col("right_" + time).alias("begin"), F.col("right_end").alias("end"))


def deskewed(points: DataFrame, readings: DataFrame, scans: DataFrame, bucket: float | None = None, rotation: Sequence[Sequence[float]] = ((1, 0, 0), (0, 1, 0), (0, 0, 1)), offset: Sequence[float] = (0, 0, 0), scale: float = 1.0) -> DataFrame:
    """points (session, t, id, x, y, z) that lie in a scan (session, scan, begin, end), moved to the scan's end: (session, scan, id, t, x, y, z).

    readings are (session, t, RATES); each scan takes those in (begin, end] and the last one up to begin. A scan starts from rest at the identity, or
    from the columns vx, vy, vz of scans; rotation and offset take the sensor to the body. A scan without
    readings, or points before its first interval, stay as they are. Rows with a null time or session lie in no scan. A
    task holds one scan; `bucket` (in units of t) splits the history of a hot session.
    """
    keys = ["session"]
    speed = [c for c in ("vx", "vy", "vz") if c in scans.columns]
    inside = in_scans(readings.select("session", "t", *RATES), scans, keys, "t", bucket).select("session", "scan", "begin", "end", "t", *RATES)
    before = asof(scans.select("session", "scan", F.col("begin").alias("t"), "begin", "end"), readings.select("session", "t", *RATES), keys, "t", list(RATES), how="inner", strict=False, bucket=bucket)
    before = before.select("session", "scan", "begin", "end", F.col("right_t").alias("t"), *(F.col("right_" + c).alias(c) for c in RATES))
    seen = in_scans(points.select("session", "t", "id", "x", "y", "z"), scans, keys, "t", bucket)
    if speed:
        seen = seen.join(scans.select("session", "scan", *speed), ["session", "scan"])
    turn, shift = np.array(rotation, float), np.array(offset, float)

    def move(key, mine, rates):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(mine):
            return pd.DataFrame(columns=["session", "scan", "id", "t", "x", "y", "z"])
        rates, p = rates.sort_values("t"), mine[["x", "y", "z"]].to_numpy(float)
        start = State(t=float(mine.begin.iloc[0]), v=mine[speed].iloc[0].to_numpy(float) if speed else np.zeros(3))
        if len(rates) > 1:
            end, poses = propagate(start, rates.t.to_numpy(float), rates[["gx", "gy", "gz"]].to_numpy(float), rates[["ax", "ay", "az"]].to_numpy(float), start.t, float(mine.end.iloc[0]), scale)
            p = deskew(p, mine.t.to_numpy(float), poses, end, turn, shift)
        return mine[["session", "scan", "id", "t"]].assign(x=p[:, 0], y=p[:, 1], z=p[:, 2])

    rates = inside.unionByName(before)
    kind = dict(seen.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in ("session", "scan", "id", "t")) + ", x double, y double, z double"
    return seen.groupBy("session", "scan").cogroup(rates.groupBy("session", "scan")).applyInPandas(move, schema)

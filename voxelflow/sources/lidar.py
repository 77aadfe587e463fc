"""Decoders of point-cloud formats: projections and filters from a raw scan table to (scan_id, i, x, y, z, intensity, t_off).

Each raw row is a point with its scan_id and index i in the scan. Decimation is on the raw index, before the range test.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "scan_id long, i long, x double, y double, z double, intensity double, t_off double"
#: Fixed values of untimed scans: degrees that the sensor turns in a second, least |x| of its points, rises taken as noise after a turn.
OMEGA, MIN_X, HOLD_OFF = 3610.0, 0.1, 1000


def _kept(every: int, blind: float, flat: bool = False) -> Column:
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    return (F.col("i") % every == 0) & ((r2 if flat else r2 + F.col("z") * F.col("z")) > blind * blind)


def _point(df: DataFrame, intensity: Column | float, t_off: Column | float) -> DataFrame:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select(F.col("scan_id").cast("long"), F.col("i").cast("long"), *(F.col(c).cast("double") for c in "xyz"), lit(intensity).cast("double").alias("intensity"), lit(t_off).cast("double").alias("t_off"))


def livox(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """offset_time in nanoseconds; reflectivity is the intensity."""
    return _point(raw.where(_kept(every, blind)), F.col("reflectivity"), F.col("offset_time") * F.lit(1e-9))


def velodyne(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Seconds in `time`, without intensity. A scan whose last point's time isn't in (0.01, 0.12) has no usable times: see velodyne_untimed."""
    last = raw.groupBy("scan_id").agg(F.max_by("time", F.struct("i", "time")).alias("__last"))
    timed = raw.join(last, "scan_id").where((F.col("__last") > 0.01) & (F.col("__last") < 0.12))
    return _point(timed.where(_kept(every, blind)), 0.0, F.col("time"))


def unwrapped(yaw: np.ndarray) -> np.ndarray:
    """Yaws (degrees in [-180, 180]) of a sensor that turns clockwise, as one falling line: a turn is taken off from each rise of over 180 on.

    The offset can change only where neighbours are half a turn or more apart. A rise begins a new turn; for HOLD_OFF more
    rises after it (points that come out of order) a rise is taken as noise, as a fall always is: the yaw is then one turn up
    until the next rise.
    """
    step = np.diff(yaw)
    at = np.flatnonzero(np.abs(step) >= 180)
    offset, turns, up, hold = [0], 0, False, 0
    for d in step[at].tolist():
        if up:
            up = d < 0
        elif d > 180 and not hold:
            turns, hold = turns + 1, HOLD_OFF
        elif abs(d) > 180:
            up, hold = True, hold - (d > 0)
        offset.append(up - turns)
    return yaw + 360.0 * np.repeat(offset, np.diff([0, *(at + 1), yaw.size]))


def velodyne_untimed(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Times from the yaw since the scan's first point (by i, then position) with |x| of MIN_X or more; a scan is one sensor turn, so a task holds little. Times out of [0, 0.1) are dropped."""

    def times(pdf):  # noqa: ANN001, ANN202
        pdf = pdf[pdf.x.abs() >= MIN_X].sort_values(["i", "x", "y", "z"])
        far = (pdf[["x", "y", "z"]].to_numpy(float) ** 2).sum(axis=1) >= blind * blind
        used = far | (np.arange(len(pdf)) == 0)  # the first point sets the zero, however near it is
        pdf, far = pdf[used], far[used]
        if len(pdf):
            yaw = unwrapped(np.degrees(np.arctan2(pdf.y, pdf.x).to_numpy(float)))
            pdf = pdf.assign(intensity=0.0, t_off=(yaw[0] - yaw) / OMEGA)
            return pdf[far & pdf.t_off.between(0, 0.1, inclusive="left") & (pdf.i % every == 0)].astype({c: float for c in "xyz"})
        return pdf.assign(intensity=0.0, t_off=0.0).astype({c: float for c in "xyz"})

    return raw.select("scan_id", "i", "x", "y", "z").groupBy("scan_id").applyInPandas(times, POINT)


def ouster(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Nanoseconds in `t`."""
    return _point(raw.where(_kept(every, blind)), F.col("intensity"), F.col("t") / F.lit(1e9))


def hesai(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Absolute seconds in `timestamp`, taken from the first point's."""
    first = raw.groupBy("scan_id").agg(F.min_by("timestamp", F.struct("i", "timestamp")).alias("__first"))
    return _point(raw.join(first, "scan_id").where(_kept(every, blind)), F.col("intensity"), F.col("timestamp") - F.col("__first"))


def robosense(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Absolute seconds in `timestamp`, from the scan's stamp scan_t0; the range test looks at x and y alone."""
    return _point(raw.where(_kept(every, blind, flat=True)), F.col("intensity"), F.col("timestamp") - F.col("scan_t0"))


def xyz(raw: DataFrame, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Positions only: no times, no filters."""
    return _point(raw, 0.0, 0.0)


DECODERS: dict[str, Callable[..., DataFrame]] = {"livox": livox, "velodyne": velodyne, "velodyne_untimed": velodyne_untimed, "ouster": ouster, "hesai": hesai, "robosense": robosense, "xyz": xyz}


def decode(raw: DataFrame, kind: str, every: int = 1, blind: float = 0.0) -> DataFrame:
    """Points of raw; an unknown kind has none."""
    if kind not in DECODERS:
        return raw.sparkSession.createDataFrame([], POINT)
    return DECODERS[kind](raw, every, blind)


def pad_empty_scans(points: DataFrame, scans: DataFrame) -> DataFrame:
    """points, with two points at the origin (at 0 and 0.09 s) for each scan_id of scans that has none."""
    empty = scans.select(F.col("scan_id").cast("long")).distinct().join(points.select("scan_id").distinct(), "scan_id", "left_anti")
    rows = empty.select("scan_id", F.posexplode(F.array(F.lit(0.0), F.lit(0.09))).alias("i", "t_off"))
    zero = [F.lit(0.0).alias(c) for c in ("x", "y", "z", "intensity")]
    return points.select("scan_id", "i", "x", "y", "z", "intensity", "t_off").unionByName(rows.select("scan_id", F.col("i").cast("long"), *zero, "t_off"))


def trim_late(points: DataFrame, cut: float = 0.11) -> DataFrame:
    """Points no later in their scan than cut."""
    return points.where(F.col("t_off") <= cut)


def bytes_to_numbers(column: str, kind: str = "float", big_endian: bool = False) -> Column:
    """The number that four (float) or eight (double) raw bytes hold."""
    dtype = np.dtype({"float": "f4", "double": "f8"}[kind]).newbyteorder(">" if big_endian else "<")

    @F.pandas_udf("double")
    def read(s):  # noqa: ANN001, ANN202
        return s.map(lambda b: None if b is None or len(b) != dtype.itemsize else float(np.frombuffer(bytes(b), dtype)[0]))

    return read(F.col(column))



"""Row-wise operators on points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.covariance import beam_covariance, off_ground
from ..functions.vectors import SYM, apply


def range_filter(points: DataFrame, blind: float) -> DataFrame:
    """Points farther than blind from the sensor."""
    return points.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") > blind * blind)


def decimate(points: DataFrame, every: int, index: str = "i", offset: int = 0) -> DataFrame:
    """Each every-th point by its index in the scan."""
    return points.where(F.col(index) % every == offset)


def inside_box(points: DataFrame, centre: Sequence[float], half: float) -> DataFrame:
    """Points in a closed cube."""
    for c, m in zip("xyz", centre, strict=True):
        points = points.where(F.col(c).between(m - half, m + half))
    return points


def rigid_transform(points: DataFrame, rotation: Sequence[Sequence], shift: Sequence) -> DataFrame:
    """R p + t in place of x, y, z."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    moved = apply(rotation, [F.col(c) for c in "xyz"])
    return points.withColumns({c: m + lit(t) for c, m, t in zip("xyz", moved, shift, strict=True)})


# Knots of the colour ramp, red, green and blue at each, and the primes of marker ids (x, y, z, layer).
JET_KNOTS = (0.0, 0.1242, 0.3747, 0.6253, 0.8758, 1.0)
JET_RED = (0.0, 0.0, 0.0, 1.0, 1.0, 0.504)
JET_GREEN = (0.0, 0.0, 1.0, 1.0, 0.0, 0.0)
JET_BLUE = (0.504, 1.0, 1.0, 0.0, 0.0, 0.0)
MARKER_PRIMES = (73856093, 19349663, 83492791, 2654435761)


def jet_colour(value: Column, low: float, high: float) -> list[Column]:
    """Red, green and blue (0 to 255, fractions cut off) from blue over green to red, by straight lines between the knots; values beyond the range take its ends, null stays null."""
    share = (value - low) / (high - low)
    v = F.when(share < 0, F.lit(0.0)).when(share > 1, F.lit(1.0)).otherwise(share)

    def ramp(heights: Sequence[float]) -> Column:
        out = None
        for (x0, y0), (x1, y1) in zip(zip(JET_KNOTS, heights, strict=True), list(zip(JET_KNOTS, heights, strict=True))[1:], strict=False):
            line = F.lit(y0) + (v - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
            out = F.when(v < x1, line) if out is None else out.when(v < x1, line)
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), out.otherwise(F.lit(heights[-1]))))
        return F.when(v.isNotNull(), F.floor(255 * at)).cast("int")

    return [ramp(JET_RED).alias("red"), ramp(JET_GREEN).alias("green"), ramp(JET_BLUE).alias("blue")]


def marker_id(centre: Sequence[Column], layer: Column) -> Column:
    """A 31-bit id of a node's centre, rounded to millimetres, and its layer; nodes may share one (`unique_markers`)."""
    mixed = F.lit(0).cast("long")
    for part, prime in zip([*(F.round(c * 1000).cast("long") for c in centre), layer.cast("long")], MARKER_PRIMES, strict=True):
        mixed = mixed.bitwiseXOR(part * F.lit(prime).cast("long"))
    return F.abs(mixed).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def unique_markers(markers: DataFrame, key: str = "id") -> DataFrame:
    """One row of each id, the least, and nodes, how many had that id; rows combine before the shuffle. On a regular grid many centres share an id: count nodes before relying on ids alone."""
    rest = [c for c in markers.columns if c != key]
    return markers.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row"), F.count("*").alias("nodes")).select(key, "nodes", *(F.col("__row")[c].alias(c) for c in rest))


def into_body(points: DataFrame, rotation: Sequence[Sequence], shift: Sequence, range_error: float, beam_degrees: float, prefix: str = "v") -> DataFrame:
    """Points and their noise covariances (prefix + xx, ...) moved from the sensor into the body by its extrinsic R, t; other columns stay."""
    turned = rigid_transform(points.withColumn("z", off_ground("z")), rotation, (0.0, 0.0, 0.0))
    noise = beam_covariance([F.col(c) for c in "xyz"], range_error, beam_degrees)  # of the turned beam: the same as turning the noise
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return turned.withColumns({prefix + s: v for s, v in zip(SYM, noise, strict=True)} | {c: F.col(c) + lit(t) for c, t in zip("xyz", shift, strict=True)})

"""Joins in time and space: as-of, interval slices, voxel lookups, neighbouring voxels, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.voxel import voxel_key
from .nearest import knn as knn

KEY = ("vx", "vy", "vz")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], how: str = "left", strict: bool = True, bucket: int | None = None) -> DataFrame:
    """left with the right values of the latest earlier time (`strict`: not an equal one); right's values are named right_*.

    Both sides are merged in one sorted pass for each key, so nothing is compared twice. bucket (in units of time) splits
    a hot key's history: each bucket is passed by itself and starts from the last value of the buckets before.
    """
    rank = 0 if strict else 1  # of left rows among equal times
    state = F.struct(F.col(time).alias("right_" + time), *(F.col(v).alias("right_" + v) for v in values))
    at = F.floor(F.col(time) / bucket).cast("long") if bucket else F.lit(0).cast("long")
    held = right.select(*keys, F.col(time), at.alias("__bucket"), state.alias("__state"))
    names = left.columns
    rows = left.select(*keys, time, at.alias("__bucket"), F.lit(None).cast(held.schema["__state"].dataType).alias("__state"), F.lit(rank).alias("__side"), F.struct(*names).alias("__row"))
    both = rows.unionByName(held.withColumn("__side", F.lit(1 - rank)).withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)))
    order = Window.partitionBy(*keys, "__bucket").orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__found", F.last("__state", ignorenulls=True).over(order)).where("__row IS NOT NULL")
    if bucket:
        last = held.groupBy(*keys, "__bucket").agg(F.max_by("__state", time).alias("__state"))
        some = rows.select(*keys, "__bucket").distinct().join(last, [*keys, "__bucket"], "full")
        before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = some.select(*keys, "__bucket", F.last("__state", ignorenulls=True).over(before).alias("__carried"))
        out = out.join(carried, [*keys, "__bucket"], "left").withColumn("__found", F.coalesce("__found", "__carried"))
    if how == "inner":
        out = out.where("__found IS NOT NULL")
    return out.select("__row.*", "__found.*")


def interval_slices(scans: DataFrame, samples: DataFrame, keys: Sequence[str], end: str, time: str, values: Sequence[Column], least: int = 5, need_later: bool = True, drop_first: bool = False) -> DataFrame:
    """A row for each scan with `least` samples or more in (previous end, end], with n and the aggregates `values` of them.

    Each sample belongs to the first scan that doesn't end before it, found in one sorted pass, so no pairs are formed.
    need_later: a scan counts only once a later sample of its key exists. drop_first: the first scan has no begin, and goes.
    """
    ends = scans.select(*keys, F.col(end).alias("__t"), F.lit(1).alias("__side"), F.col(end).alias("__end")).distinct()
    mixed = samples.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(ends.schema["__end"].dataType).alias("__end"), F.struct(*samples.columns).alias("__row"))
    both = mixed.unionByName(ends.withColumn("__row", F.lit(None).cast(mixed.schema["__row"].dataType)))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*keys)
    placed = both.withColumn("__to", F.first("__end", ignorenulls=True).over(w)).withColumn("__latest", F.max(F.when(F.col("__side") == 0, F.col("__t"))).over(every)).withColumn("__first", F.min("__end").over(every))
    placed = placed.where("__side = 0 AND __to IS NOT NULL")
    if need_later:
        placed = placed.where("__to < __latest")
    if drop_first:
        placed = placed.where("__to > __first")
    flat = placed.select(*(F.col(k).alias("__k_" + k) for k in keys), "__to", "__row.*")
    out = flat.groupBy(*("__k_" + k for k in keys), "__to").agg(F.count("*").alias("n"), *values).where(F.col("n") >= least)
    return out.select(*(F.col("__k_" + k).alias(k) for k in keys), F.col("__to").alias(end), *[c for c in out.columns if not c.startswith("__")])


def voxel_match(points: DataFrame, planes: DataFrame, size: float) -> DataFrame:
    """points joined to the planes of their voxel; planes' columns but the key must be named apart."""
    return points.select("*", *voxel_key([F.col(c) for c in "xyz"], size)).join(planes, list(KEY))


def neighbour_offsets() -> Column:
    """The 27 offsets of a voxel and its neighbours."""
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))


def neighbour27(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """points joined to cells (keyed vx, vy, vz) of their voxel and those around it: an equi-join on 27 keys for each point. points keep their voxel as px, py, pz."""
    keyed = points.select("*", *(k.alias(n) for k, n in zip(voxel_key([F.col(c) for c in "xyz"], size), ("px", "py", "pz"), strict=True)))
    spread = keyed.withColumn("__o", F.explode(neighbour_offsets()))
    spread = spread.select(*keyed.columns, *((F.col(p) + F.col("__o." + o)).alias(v) for p, o, v in zip(("px", "py", "pz"), "abc", KEY, strict=True)))
    return spread.join(cells, list(KEY))

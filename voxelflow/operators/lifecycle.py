"""Map maintenance: eviction by distance travelled, revised paths, epochs between resets, late scans, and change logs between two versions of a set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evict(voxels: DataFrame, now: Column | float, touched: str = "travelled", limit: float = 700.0) -> DataFrame:
    """Voxels touched within the last `limit` metres of travel (whole metres, rounded toward zero)."""
    now = now if isinstance(now, Column) else F.lit(now)
    return voxels.where((now - F.col(touched)).cast("long") < limit)


def evict_some(voxels: DataFrame, now: Column | float, keys: Sequence[str], most: int = 1000, touched: str = "travelled", limit: float = 700.0) -> tuple[DataFrame, DataFrame]:
    """One tick of bounded maintenance: (rows that stay, rows that go), the `most` longest untouched of those that `evict` would drop, ties by keys. The rest go in later ticks."""
    now = now if isinstance(now, Column) else F.lit(now)
    gone = voxels.where((now - F.col(touched)).cast("long") >= limit).orderBy(touched, *keys).limit(most)
    return voxels.join(F.broadcast(gone.select(*keys)), list(keys), "left_anti"), gone


def revised(path: DataFrame, adjusted: DataFrame, key: str = "frame", values: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The path with the values of adjusted (a window's frames, unique by key) in place of its own; frames that the path lacks are not added."""
    new = adjusted.select(key, F.struct(*values).alias("__new"))
    put = {v: F.when(F.col("__new").isNotNull(), F.col("__new")[v]).otherwise(F.col(v)) for v in values}
    return path.join(new, key, "left").select(*(put[c].alias(c) if c in put else F.col(c) for c in path.columns))


def epochs(rows: DataFrame, reset: Column, session: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows and epoch, the number of resets up to each in its session; state keyed by (session, epoch) starts afresh after a reset, the row of which is the first of its epoch."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("epoch", F.sum(F.when(reset, 1).otherwise(0)).over(w))


def in_order(scans: DataFrame, session: Sequence[str], order: Sequence[str], begin: str = "begin", end: str = "end", tolerance: float = 0.01) -> DataFrame:
    """scans and late: whether one begins over `tolerance` before an earlier one's end. Callers drop late rows, and count them by `observe`."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return scans.withColumn("late", F.coalesce(F.col(begin) < F.max(end).over(w) - F.lit(tolerance), F.lit(False)))


def changelog(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys and op: ADD for new keys, DELETE for gone ones, MODIFY where a value differs; unchanged rows are left out."""
    a = old.select(*keys, F.struct(*values).alias("__old"))
    b = new.select(*keys, F.struct(*values).alias("__new"))
    op = F.when(F.col("__old").isNull(), "ADD").when(F.col("__new").isNull(), "DELETE").when(~F.col("__old").eqNullSafe(F.col("__new")), "MODIFY")
    both = a.join(b, list(keys), "full").withColumn("op", op).where("op IS NOT NULL")
    return both.select(*keys, "op", *(F.col("__new")[v].alias(v) for v in values))

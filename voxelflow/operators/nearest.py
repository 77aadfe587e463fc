"""The k nearest points of each point, exactly, on leaves of a k-d tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import nearest
from .state import stored

XYZ, BASE = ("x", "y", "z"), ("bx", "by", "bz")
#: Points in a leaf at most, and at least where there are few; sampled points in a leaf of the tree; queries of a leaf that one task takes.
LARGE, SMALL, SAMPLED, SLICE = 16_384, 1_024, 64, 32_768


def knn(queries: DataFrame, base: DataFrame, k: int, size: float, id_col: str = "id", same: bool = False) -> DataFrame:
    """The k nearest base points of each query: (id, near, d2, rank), ties by id; exact.

    The cuts of the tree come from a sample, its boxes from all points. A query looks at the leaf it lies in, and then at
    every leaf that its ball reaches; so points are dealt out once a round, and no pairs are. Of equal points only those
    with the k + 1 least ids can be near others, so copies don't fill a leaf. same: a point may be its own neighbour.

    Distances to points with infinite, NaN or unknown coordinates are such themselves and come last, in this order; finite
    ones are under 1e150. Rows without an id are left out, and rows of one id look for k together. size is no longer needed:
    leaves follow the points.
    """
    named = lambda df, names: df.select(F.col(id_col).alias(names[0]), *(F.col(c).cast("double").alias(n) for c, n in zip(XYZ, names[1:], strict=True))).where(F.col(names[0]).isNotNull())
    left = stored(named(queries, ("id", *XYZ)))
    right = left.toDF("near", *BASE) if base is queries else named(base, ("near", *BASE))
    found = _searched(left.where(_whole(XYZ)), right.where(_whole(BASE)), k, same)
    few, odd = found.where(F.size("best") < k).select("id", *XYZ), left.where(~_whole(XYZ))
    special = stored(left.groupBy("id").count().where("count > 1").select("id").union(few.select("id")).union(odd.select("id")).distinct())
    flat = found.select("id", F.posexplode("best").alias("rank", "b")).select("id", "b.near", "b.d2", (F.col("rank") + 1).alias("rank"))
    if special.isEmpty():
        return flat
    some = _by_kind(right, k)
    far = few.join(F.broadcast(some.where("kind <> '000'"))).unionByName(odd.join(F.broadcast(some)))
    far = far if same else far.where("id <> near")
    x, y, z = (F.col(c) - F.col(b) for c, b in zip(XYZ, BASE, strict=True))
    pairs = far.select("id", "near", (x * x + y * y + z * z).alias("d2")).unionByName(flat.drop("rank").join(special, "id", "left_semi"))
    order = Window.partitionBy("id").orderBy(F.col("d2").asc_nulls_last(), "near")
    last = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return flat.join(special, "id", "left_anti").unionByName(last)


def _whole(names: tuple[str, ...]) -> Column:
    """Whether all coordinates are finite numbers."""
    whole = F.lit(True)
    for c in names:
        whole = whole & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return whole


def _fewest(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (near, keys) of each key's k + 1 least ids, with up to k of each; combined before the shuffle, so that a common key meets in one task as a few rows."""
    order = Window.partitionBy(*keys).orderBy("near")
    times = df.groupBy("near", *keys).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("__times"))
    kept = times.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k + 1)
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("near", *keys)


def _by_kind(right: DataFrame, k: int) -> DataFrame:
    """The least ids of each kind of point: which coordinates are finite (0), infinite, NaN or unknown. To a point that isn't finite all points of a kind are as far."""
    kinds = [F.when(F.col(b).isNull(), 4).when(F.isnan(b), 3).when(F.col(b) == float("inf"), 1).when(F.col(b) == -float("inf"), 2).otherwise(0) for b in BASE]
    ids = _fewest(right.select("near", F.concat(*(c.cast("string") for c in kinds)).alias("kind")), ["kind"], k)
    value = lambda digit: F.when(digit == "1", float("inf")).when(digit == "2", -float("inf")).when(digit == "3", float("nan")).when(digit == "0", 0.0)
    return ids.select("near", "kind", *(value(F.substring("kind", i + 1, 1)).alias(b) for i, b in enumerate(BASE)))


def _tree(right: DataFrame) -> nearest.Tree:
    """Cuts from a sample of some SAMPLED points a leaf, at most a 16th of all; boxes from all points."""
    n = right.count()
    most = min(LARGE, max(SMALL, n // (4 * right.sparkSession.sparkContext.defaultParallelism)))
    sample = right.where(F.rand(17) < SAMPLED / most).select(*BASE).toPandas()
    tree, _ = nearest.build(sample.to_numpy(float).reshape(-1, 3), SAMPLED)
    ends = [f(b).alias(f"{name}{b}") for name, f in (("lo", F.min), ("hi", F.max)) for b in BASE]
    boxes = _placed(right, tree).groupBy("leaf").agg(*ends).toPandas()
    lo, hi = (boxes[[name + b for b in BASE]].to_numpy(float).reshape(-1, 3) for name in ("lo", "hi"))
    return tree.boxed(boxes["leaf"].to_numpy(int), lo, hi)


def _placed(right: DataFrame, tree: nearest.Tree) -> DataFrame:
    @F.pandas_udf("int")
    def leaf(x, y, z):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(tree.place(np.column_stack([x, y, z])).astype(np.int32))

    return right.withColumn("leaf", leaf(*BASE))


def _searched(left: DataFrame, right: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, x, y, z, best): up to k of (d2, near) for each query, in order; all finite points, round by round."""
    right = stored(_fewest(right, list(BASE), k))
    tree = _tree(right)
    placed = _placed(right, tree)
    bound = F.when(F.size("best") >= k, F.element_at("best", k)["d2"]).otherwise(float("inf"))
    kind = f"array<struct<d2:double,near:{dict(right.dtypes)['near']}>>"

    @F.pandas_udf("int")
    def home(x, y, z):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(tree.closest(np.column_stack([x, y, z])).astype(np.int32))

    def ahead(most: int) -> Column:
        """The nearest leaves, up to `most`, that the ball reaches and that weren't visited."""

        @F.pandas_udf("array<int>")
        def leaves(x, y, z, bound, visited):  # noqa: ANN001, ANN202
            import pandas as pd

            p, bound, out = np.column_stack([x, y, z]), bound.to_numpy(float), []
            for a in range(0, len(p), 512):
                been = visited.iloc[a : a + 512]
                at, leaf, gap = tree.within(p[a : a + 512], bound[a : a + 512])
                seen = np.repeat(np.arange(len(been)), [len(v) for v in been]) * tree.leaves + np.concatenate([np.asarray(v, int) for v in been])
                new = ~np.isin(at * tree.leaves + leaf, seen)
                at, leaf, gap = at[new], leaf[new], gap[new]
                sort = np.lexsort((leaf, gap, at))
                sort = sort[nearest.firsts(at[sort], most)]
                out += nearest.lists(at[sort], len(been), leaf[sort].astype(np.int32))[0]
            return pd.Series(out, dtype=object)

        return leaves(*XYZ, bound, "visited")

    first = _looked(left.withColumn("leaf", home(*XYZ)).withColumn("bound", F.lit(float("inf"))), placed, k, same, kind)
    state = first.select("id", *XYZ, "best", F.array("leaf").alias("visited"))
    most, done = 8, None
    while True:
        state = stored(state.withColumn("todo", ahead(most)).withColumn("q", F.monotonically_increasing_id()))
        over = state.where("size(todo) = 0").select("id", *XYZ, "best")
        done = over if done is None else done.unionByName(over)
        left_over = state.where("size(todo) > 0")
        if left_over.isEmpty():
            return done
        more = _looked(left_over.select("q", "id", *XYZ, bound.alias("bound"), F.explode("todo").alias("leaf")), placed, k, same, kind)
        more = more.groupBy("q").agg(F.flatten(F.collect_list("best")).alias("more"))
        best = F.slice(F.array_sort(F.concat("best", "more")), 1, k).alias("best")
        state = left_over.join(more, "q").select("id", *XYZ, best, F.concat("visited", "todo").alias("visited"))
        most *= 8


def _looked(left: DataFrame, placed: DataFrame, k: int, same: bool, kind: str) -> DataFrame:
    """left (id, x, y, z, leaf, bound and more) with best, the k nearest points of the leaf within the bound. A leaf with many queries is worked off in slices."""
    slices = F.ceil(F.count("*") / SLICE).cast("int").alias("slices")
    need = F.broadcast(stored(left.groupBy("leaf").agg(slices)))
    left = left.join(need, "leaf").withColumn("slice", F.pmod(F.xxhash64("id", *XYZ), "slices").cast("int")).drop("slices")
    right = placed.join(need, "leaf").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    names = [c for c in left.columns if c not in ("slice", "bound")]
    near = kind.split("near:")[1][:-2]
    schema = ", ".join(f"{c} {dict(left.dtypes)[c]}" for c in names) + f", d2 array<double>, near array<{near}>"

    def look(queries, points):  # noqa: ANN001, ANN202
        out = queries[names]
        q, ids, bound = queries[list(XYZ)].to_numpy(float), queries["id"].to_numpy(), queries["bound"].to_numpy(float)
        at, d2, found = nearest.search(points[list(BASE)].to_numpy(float), points["near"].to_numpy(), q, ids, bound, k, same)
        d2, found = nearest.lists(at, len(q), d2, found)
        return out.assign(d2=d2, near=found)

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes are much work here, and would end up in few tasks
    sides = [df.repartition(parts, "leaf", "slice").groupBy("leaf", "slice") for df in (left, right)]
    both = sides[0].cogroup(sides[1]).applyInPandas(look, schema)
    return both.withColumn("best", F.arrays_zip("d2", "near").cast(kind)).drop("d2", "near")


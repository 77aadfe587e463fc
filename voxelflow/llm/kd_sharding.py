"""Shards of near equal bytes by a k-d tree over the documents' metadata.

The rows placed together are groups of equal texts; a group's point is made of its least id, its size, and its least
source and language (as their ranks among all values). All nodes of a level are split at once: one aggregate
finds each node's widest dimension (of spreads scaled to the whole), and the next ones its weighted median: the value whose
weight up to and with it is nearest to half of the node's (of two, the lesser), found in 1,024 bins, then in those of the
bin that holds it, until single values are told apart. The rows that reach the driver are a few for each node. A node at
or under the target bytes is a leaf. Leaves are much smaller than shards and go to the emptiest shard, largest first, so
shards end near equal whatever the medians were. A group of more bytes than a shard's fair share can't be kept whole: its rows
are dealt over several leaves by id.

Rows are numbered within a shard in parallel, by bucket; a group with very many rows is not gathered to be placed. Size is the
text's UTF-8 bytes (null: none) plus 1. Null ids count as -1 and null metadata comes first; ids over 2**53 are compared in double
precision; equal rows each get a slot. Metadata columns that docs lacks are left out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucket_of, join_counted, materialize, n_buckets

BINS = 1024
GROUP = ["key", "size", "crc", "salt"]


def with_rank(rows: DataFrame, name: str, rank: str, total: int) -> DataFrame:
    """rows with the place of column `name` in the order of its distinct values as `rank`, a double; null: -1. Values are sorted in range partitions, so no task sorts them all."""
    some = rows.where(F.col(name).isNotNull())
    counts = some.groupBy(name).agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange(F.col(name)).sortWithinPartitions(name).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select(name, "n", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("within")), "values")
    sizes = dict(placed.groupBy("part").count().collect())  # a row for each partition
    before = listed([float(sum(n for q, n in sizes.items() if q < p)) for p in range(max(sizes, default=0) + 1)])
    values = placed.select(name, "n", (F.get(before, F.col("part")) + F.col("within")).alias(rank))
    return join_counted(some, values, [name], total).unionByName(rows.where(F.col(name).isNull()).withColumn(rank, F.lit(-1.0)))


def listed(values: list) -> Column:
    """The values (all of one type) as an array that is folded to one literal: one string to parse, however many they are."""
    kind = {bool: "boolean", int: "bigint", float: "double"}[type(values[0])]
    return F.split(F.lit(",".join(map(repr, values)).lower()), ",").cast(f"array<{kind}>")


class Tree:
    """Nodes as parallel lists: the dimension (-1: a leaf so far), threshold and children of each; node 0 is the root."""

    def __init__(self) -> None:
        self.dim, self.threshold, self.left, self.right, self.levels = [-1], [0.0], [0], [0], 0

    def split(self, node: int, dim: int, threshold: float) -> list[int]:
        self.dim[node], self.threshold[node] = dim, threshold
        self.left[node], self.right[node] = children = [len(self.dim), len(self.dim) + 1]
        for column, empty in ((self.dim, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0)):
            column += [empty, empty]
        return children

    def node(self, dims: list[str]) -> Column:
        """The node of a point, walked from the root; the tree is a few lists of one entry a node."""
        if not self.levels:
            return F.lit(0).cast("long")
        dim, threshold, left, right = (listed(x) for x in (self.dim, self.threshold, self.left, self.right))
        at = F.array(*dims)
        pick = lambda values, n: F.get(values, n.cast("int"))
        down = lambda n, _: F.when(pick(dim, n) < 0, n).when(pick(at, pick(dim, n)) > pick(threshold, n), pick(right, n)).otherwise(pick(left, n))
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.levels)), F.lit(0).cast("long"), down)


def grow(points: DataFrame, dims: list[str], target: float) -> tuple[Tree, dict[int, int]]:
    """The tree over points (dims and weight), and the weight of each leaf."""
    tree, leaves, scale, frontier = Tree(), {}, None, [0]
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    while frontier:
        of_level = set(frontier)
        now = points.withColumn("node", tree.node(dims)).where(F.get(listed([n in of_level for n in range(len(tree.dim))]), F.col("node").cast("int")))
        stats = now.groupBy("node").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *ends).collect()
        if scale is None and stats:
            scale = {d: (stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) or 1.0 for d in dims}
        chosen = {}
        for s in stats:
            widest = max(dims, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / scale[d])
            lo, hi = s[f"lo_{widest}"], s[f"hi_{widest}"]
            if s["weight"] <= target or lo == hi:
                leaves[s["node"]] = s["weight"]
            else:
                chosen[s["node"]] = (dims.index(widest), lo, hi, s["weight"], s["n"])
        frontier = []
        for node, threshold in sorted(weighted_medians(now, dims, chosen, len(tree.dim)).items()):
            frontier += tree.split(node, chosen[node][0], threshold)
        tree.levels += bool(chosen)
    return tree, leaves


def weighted_medians(points: DataFrame, dims: list[str], nodes: dict[int, tuple[int, float, float, int, int]], size: int) -> dict[int, float]:
    """The weighted median of each node, given as (dimension, least value, greatest value, weight, points); node numbers are under size.

    Each round keeps a bin a node, the one that holds the middle, and tells its values apart once there are few.
    """
    best: dict[int, tuple[int, float]] = {}
    node = F.col("node").cast("int")
    left = {n: (dim, lo, hi, 0, points <= BINS) for n, (dim, lo, hi, _, points) in nodes.items()}
    while left:
        dim, lo, hi, below, single = (F.get(listed([left.get(n, (-1, 0.0, 0.0, 0, False))[k] for n in range(size)]), node) for k in range(5))
        total = F.get(listed([nodes[n][3] if n in nodes else 0 for n in range(size)]), node)
        value = F.get(F.array(*dims), dim.cast("int"))
        place = F.when(single, value).otherwise(F.least(F.lit(BINS - 1.0), F.floor((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * BINS).cast("double")))
        bins = points.where((dim >= 0) & value.between(lo, hi)).groupBy("node", place.alias("bin")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))
        order = Window.partitionBy("node").orderBy("bin")
        upto = bins.withColumn("upto", F.sum("w").over(order) + below).withColumn("prev", F.lag("last").over(order)).where(2 * F.col("upto") >= total)
        rows = upto.groupBy("node").agg(F.min_by(F.struct("w", "n", "first", "last", "upto", "prev"), "bin").alias("b")).select("node", "b.*").collect()
        for r in rows:
            dim, _, greatest, total, _ = nodes[r["node"]]
            for cut, weight in ((r["prev"], r["upto"] - r["w"]), (r["last"], r["upto"])):
                if cut is not None and cut < greatest:
                    best[r["node"]] = min(best.get(r["node"], (total, greatest)), (abs(2 * weight - total), cut))
            del left[r["node"]]
            if r["first"] < r["last"]:
                left[r["node"]] = (dim, r["first"], r["last"], r["upto"] - r["w"], r["n"] <= BINS)
    return {n: cut for n, (_, cut) in best.items()}


def fill_shards(leaves: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each leaf: largest first, into the emptiest."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for node, weight in sorted(leaves.items(), key=lambda x: (-x[1], x[0])):
        total, s = heapq.heappop(load)
        out[node] = s
        heapq.heappush(load, (total + weight, s))
    return out


def kd_shards(docs: DataFrame, shards: int = 16, leaves_per_shard: int = 16, metadata: tuple[str, ...] = ("source", "lang"), per_bucket: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs."""
    text, by = F.col(f"`{text_col}`").cast("string"), [m for m in metadata if m in docs.columns]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    raw = [F.col(f"`{m}`").alias(f"v{k}") for k, m in enumerate(by)]
    meta = materialize(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.xxhash64(text).alias("key"), *raw), "raw-metadata")
    rows = meta.count()
    for k in range(len(by)):
        meta = with_rank(meta, f"v{k}", f"m{k}", rows).drop(f"v{k}")
    meta = materialize(meta.withColumn("salt", F.lit(0)), "metadata")

    def grouped(rows: DataFrame) -> DataFrame:
        dims = {"d0": F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)), "d1": F.log2(F.max("size").cast("double"))}
        dims |= {f"d{k + 2}": F.min(f"m{k}") for k in range(len(by))}
        return rows.groupBy(*GROUP).agg(F.sum("size").alias("weight"), F.count("*").alias("n"), *(v.alias(k) for k, v in dims.items()))

    points = materialize(grouped(meta), "groups")
    total = points.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    target = max(1.0, total / (shards * leaves_per_shard))
    heavy = [tuple(r) for r in points.where(F.col("weight") * shards > total).where("n > 1").select("key", "size", "crc", F.ceil(F.col("weight") / F.lit(target)).cast("int").alias("parts")).collect()]  # fewer than shards
    if heavy:
        salt = F.lit(0)
        for key, size, crc, parts in heavy:
            salt = F.when((F.col("key") == key) & (F.col("size") == size) & (F.col("crc") == crc), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(salt)
        meta = meta.withColumn("salt", salt)
        points = materialize(grouped(meta), "groups")
    dims = [c for c in points.columns if c[0] == "d" and c[1:].isdigit()]
    tree, leaves = grow(points, dims, target)
    shard_of = fill_shards(leaves, shards)
    placed = points.select(*GROUP, "n", F.get(listed([shard_of.get(n, 0) for n in range(len(tree.dim))]), tree.node(dims).cast("int")).cast("int").alias("shard"))
    out = join_counted(meta, placed, GROUP, rows).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", bucket_of(F.col("doc_id"), F.col("crc"), n=n_buckets(rows // shards, per_bucket)).alias("bucket"))
    out = materialize(out, "sharded")
    sizes = out.groupBy("shard", "bucket").count()
    before = sizes.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return out.withColumn("within", within).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).alias("slot"))

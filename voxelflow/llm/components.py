"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, materialize

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b, of one type that has an order) to (node, root): root is the least node of node's component; only nodes with an edge appear.

    Each round links every node's larger neighbours to its least one (large star), then its smaller ones (small star);
    the edges end as one star for each component. Minima are combined before each shuffle, and the edges of a node with many
    of them aren't shuffled by it (`join_counted`); rounds are written to the shared folder, so lineage stays short. The
    driver sees one count and one checksum a round.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, total = None, edges.count()
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "n", F.least("m", "a").alias("m"))
        large = join_counted(both, least, ["a"], 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, total = now, now[0]
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")

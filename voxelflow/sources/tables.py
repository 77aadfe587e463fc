"""Views of the driver's tables as sensor data: a point cloud, readings by session, and a small cloud for neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: (scan, i, pk, sk) is the key. The divisors keep averages off the decimal ties at which engines round apart."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_linenumber AS BIGINT) AS scan", "l_orderkey AS i", "l_partkey AS pk", "l_suppkey AS sk",
        "(l_quantity - 25) / 7 AS x", "(l_extendedprice - 50000) / 20999.3 AS y", "(l_discount - 0.05) * 130 / 3.1 AS z",
        "CAST(l_suppkey % 256 AS DOUBLE) AS intensity", "CAST(round(l_tax * 100) AS BIGINT) * 15000000 AS offset_ns",
    )


def raw_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud with every sensor's time columns, as the decoders read them."""
    t = F.col("offset_ns") * F.lit(1e-9)
    return cloud(spark, sf_dir).select(
        F.col("scan").alias("scan_id"), "i", "pk", "sk", "x", "y", "z", "intensity", F.col("intensity").alias("reflectivity"), F.col("offset_ns").alias("offset_time"), F.col("offset_ns").alias("t"), t.alias("time"), (F.lit(1000.0) + t).alias("timestamp"), F.lit(1000.0).alias("scan_t0")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (session, ts, us, kind, value, id); us is microseconds."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS session", "CAST(ts AS TIMESTAMP) AS ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "event_type AS kind", "value", "event_id AS id"
    )


def small_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three dimensions of embeddings, times 10."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "CAST(label AS BIGINT) AS frame", *(f"CAST(embedding[{k}] AS DOUBLE) * 10 AS {c}" for k, c in enumerate("xyz"))
    )

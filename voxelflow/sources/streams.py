"""Streaming sources over growing folders of Parquet files, with fixed schemas and bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMU = "session_id long, ts timestamp, t_sec double, gx double, gy double, gz double, ax double, ay double, az double"
POINTS = "scan_id long, scan_t0 double, i long, x double, y double, z double, intensity double, reflectivity double, offset_time long, t long, time double, timestamp double"


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def points_stream(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    return read_stream(spark, folder, POINTS, **options)


def imu_stream(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    return read_stream(spark, folder, IMU, **options)

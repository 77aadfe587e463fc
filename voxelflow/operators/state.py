"""State tables: what later steps look up is written once to the shared folder, so that its lineage and plan end there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the folder of spark.checkpoint.dir, which lost executors can't take along.

    Only a local master may lack the setting; it gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="voxelflow-"))
    return df.checkpoint()

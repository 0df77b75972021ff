"""Tables written to the shared folder to cut lineage in iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="probeframe-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` under :func:`scratch_root` and returns a scan of it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

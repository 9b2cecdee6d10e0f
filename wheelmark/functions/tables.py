"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir; a temporary folder where that is unset and the master is local, as in tests."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/wheelmark/{context.applicationId}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Lineage ends there: what follows is planned from a scan, and lost executors cost no recomputation before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

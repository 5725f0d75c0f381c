"""Tables that a job keeps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def job_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    return f"{job_folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str, *by: str) -> DataFrame:
    """The rows, written and read again: what several fits share is computed once and survives lost executors. by: columns of few values that later reads go by."""
    path = new_path(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tenura-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession) -> str:
    """Where this application's scratch tables are; delete it with promote.discard once results are written."""
    return f"{shared_folder(spark)}/facts/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and reread."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Strict readers: schemas come from the contract and are never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.contracts import FAMILIES


def read_family(spark: SparkSession, family: str, *paths: str) -> DataFrame:
    """Headed CSV of one family; a bad row or a drifted header fails the job. Compressed files are decoded by suffix."""
    header = spark.read.text(paths[0]).limit(1).collect()
    check_header(header[0][0] if header else "", FAMILIES[family])
    return (
        spark.read.schema(FAMILIES[family])
        .options(header=True, mode="FAILFAST", enforceSchema=False, sep=",", quote="", escape="")
        .csv(list(paths))
    )


def check_header(line: str, schema: T.StructType) -> None:
    """Raise when a file's header isn't the contract's."""
    if line.strip().split(",") != schema.fieldNames():
        raise ValueError(f"header drift: {line!r}, expected {','.join(schema.fieldNames())!r}")


def read_partitioned(spark: SparkSession, root: str) -> DataFrame:
    """Parquet with its partition folders as columns."""
    return spark.read.parquet(root)


def read_leaf(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet of one folder, without columns from its path."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df, once its names and types are those expected, in order."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [(f.name, f.dataType.simpleString()) for f in expected]
    if have != want:
        raise ValueError(f"schema drift: {have} instead of {want}")
    return df


def read_versions(spark: SparkSession, *roots: str) -> DataFrame:
    """The deliveries of one family as one relation; each may lack columns of the others, which are null there."""
    parts = [spark.read.parquet(root) for root in roots]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_controls(spark: SparkSession, path: str, value: str = "expected_value") -> DataFrame:
    """Values by control_id of a headed CSV file, expected ones or (actual_value) those of another engine; raises where an id is missing or there twice."""
    rows = spark.read.schema(f"control_id string, measure_id string, {value} double").options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    bad = rows.groupBy("control_id").agg(F.count("*").alias("n")).filter("n > 1 OR control_id IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"control {bad[0]['control_id']!r} is missing or repeated")
    return rows


def source_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path and length of each matching file, without reading their content."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def pilot(df: DataFrame, rows: int, path: str) -> DataFrame:
    """The first rows of a source written as Parquet, to project the size of the whole."""
    df.limit(rows).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def projected_gib(pilot_bytes: int, pilot_rows: int, source_rows: int) -> float:
    return pilot_bytes / max(pilot_rows, 1) * source_rows / 2**30

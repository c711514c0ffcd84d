"""Sinks: counted writes, staged promotion, replay detection and reports."""

from __future__ import annotations

import contextlib
import hashlib
import json
import shutil
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


#: Rows of a Parquet row group.
ROW_GROUP = 100_000


def counted_write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Zstandard Parquet in a new folder, in row groups of ROW_GROUP rows at most; the rows that its footers tell.

    An Observation would count in the same job, but leaves the session with a manager
    that fitted models can't be serialized with.
    """
    writer = df.write.option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP).mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def promote(spark: SparkSession, stage: str, output: str, before_publish: Callable[[], None] | None = None) -> None:
    """Put a finished stage in the place of output; on failure the old output is back.

    before_publish runs between moving the old output away and publishing, where
    tests inject failures.
    """
    fs, path = _fs(spark, stage)
    backup = f"{output}.previous"
    fs.delete(path(backup), True)
    had = fs.exists(path(output))
    if had and not fs.rename(path(output), path(backup)):
        raise OSError(f"{output} can't be moved away")
    try:
        if before_publish:
            before_publish()
        if not fs.rename(path(stage), path(output)):
            raise OSError(f"{stage} can't be published")
    except BaseException:
        if had:
            fs.rename(path(backup), path(output))
        raise
    fs.delete(path(backup), True)


def discard(spark: SparkSession, stage: str) -> None:
    fs, path = _fs(spark, stage)
    fs.delete(path(stage), True)


def fingerprint(contract: str, files: Iterable[tuple[str, int, int]]) -> str:
    """SHA-256 over a contract and (name, bytes, modification time) of its sources, in any order."""
    digest = hashlib.sha256(contract.encode())
    for name, size, modified in sorted(files):
        digest.update(f"\n{name}\t{size}\t{modified}".encode())
    return digest.hexdigest()


def source_files(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """Name, bytes and modification time of a manifest's files, from metadata alone."""
    fs, path = _fs(spark, pattern)
    found = fs.globStatus(path(pattern)) or []
    return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found]


def replayed(spark: SparkSession, output: str, expected: str) -> bool:
    """Whether output was built from the sources of this fingerprint and is whole."""
    fs, path = _fs(spark, output)
    if not fs.exists(path(f"{output}/controls.json")):
        return False
    text = "\n".join(r[0] for r in spark.read.text(f"{output}/controls.json").collect())  # one small report
    with contextlib.suppress(ValueError):
        report = json.loads(text)
        return report.get("fingerprint") == expected and all(fs.exists(path(f"{output}/{t}/_SUCCESS")) for t in report.get("tables", {}))
    return False


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A JSON document through the file system of its path."""
    fs, make = _fs(spark, path)
    out = fs.create(make(path), True)
    try:
        out.write(bytearray((json.dumps(report, sort_keys=True, indent=1, default=str) + "\n").encode()))
    finally:
        out.close()


def read_report(spark: SparkSession, path: str) -> dict:
    """A JSON document that write_report wrote, through the file system of its path."""
    fs, make = _fs(spark, path)
    source = fs.open(make(path))
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def build(spark: SparkSession, output: str, tables: dict[str, DataFrame], fingerprint_: str, partitions: dict[str, tuple[str, ...]] | None = None, gate: Callable[[dict[str, int]], None] | None = None, further: Callable[[str], None] | None = None) -> dict:
    """Write all tables below a stage, and what further writes there, check their counts, and promote; a known fingerprint is a no-op."""
    if replayed(spark, output, fingerprint_):
        return {"status": "unchanged", "fingerprint": fingerprint_}
    stage = f"{output}.stage-{fingerprint_[:12]}"
    discard(spark, stage)
    try:
        rows = {name: counted_write(df, f"{stage}/{name}", (partitions or {}).get(name, ())) for name, df in tables.items()}
        if gate:
            gate(rows)
        if further:
            further(stage)
        report = {"status": "built", "fingerprint": fingerprint_, "tables": rows}
        write_report(spark, report, f"{stage}/controls.json")
        promote(spark, stage, output)
    except BaseException:
        discard(spark, stage)
        raise
    return report


def require_space(folder: str, reserve: int) -> None:
    """Raise when a local folder's disk has less than the reserve left."""
    free = shutil.disk_usage(folder).free
    if free < reserve:
        raise OSError(f"{free} bytes are free, {reserve} are kept in reserve")


def allocated(spark: SparkSession, folder: str) -> int:
    """Bytes below a folder."""
    fs, path = _fs(spark, folder)
    return fs.getContentSummary(path(folder)).getLength()


def require_ceiling(spark: SparkSession, folder: str, ceiling: int) -> int:
    used = allocated(spark, folder)
    if used > ceiling:
        raise OSError(f"{folder} holds {used} bytes, more than {ceiling}")
    return used

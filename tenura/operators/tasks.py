"""What runs as Python inside tasks: the package on the executors, and arrays added over all of them."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Partitions whose arrays the driver adds itself.
FEW = 32


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, where it isn't in an archive of the job already."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId not in _shipped and root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="tenura-")) / "tenura.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over the Arrow batches of each partition."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(b for b in batches if b.num_rows), schema)


def added_blocks(blocks: RDD, of: Callable[[Any], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of the whole-number arrays of(block), of this shape: exact, in whatever order they come.

    Tasks add up their own blocks. Beyond FEW partitions their rows are added by
    first index in tasks again; the driver gets one array.
    """

    def own(found: Iterator[Any]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for block in found:
            part = of(block)
            total = part if total is None else total + part
        if total is not None:
            yield from enumerate(total)

    parts = blocks.mapPartitions(own)
    if (n := blocks.getNumPartitions()) > FEW:
        parts = parts.reduceByKey(np.add, min(n, FEW))
    out = np.zeros(shape, np.int64)
    for i, sums in parts.collect():  # a row for each first index, and partition where those are few
        out[i] += sums
    return out

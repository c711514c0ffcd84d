"""What the text operators share: scratch tables, batch mapping and word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A worker's memo tables stop growing here; later words are computed each time.
MEMO_LIMIT = 400_000
#: Bytes of an Arrow batch between Spark and a worker, unless the session sets it: a task holds a batch several times, on both sides.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode, as in tests, a temporary one where that is unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tenura-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{shared_dir(spark)}/tenura/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once results that were read from them are written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and reread: cuts lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, where it isn't in an archive of the job already."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if context.applicationId not in _shipped and root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="tenura-")) / "tenura.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def trim() -> None:
    """Give freed memory back to the system: a reused worker would keep it, beside whatever runs next on its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c, "malloc_trim"):  # glibc
        _c.malloc_trim(0)


_c = ctypes.CDLL(None)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn applied to each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return map_partitions(df, run, schema)


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn applied to the Arrow batches of each partition of df, for what is summed or searched over a whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(b for b in batches if b.num_rows)
        trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def best_rows(df: DataFrame, by: str, order: list[Column], k: int, spread: Column, salts: int = 32) -> DataFrame:
    """The first k rows of each group in this order, with their rank: first within salts of a group, so that no task gets all of one."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    within = W.partitionBy(by, "salt").orderBy(*order)
    some = salted.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k).drop("salt", "rank")
    return some.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


_held: dict[str, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What make returned for this key, until another key comes: a worker keeps one operator's tables at a time."""
    if _held.get("key") != key:
        _held.clear()
        trim()
        _held.update(key=key, value=make())
    return _held["value"]


def whole_text(column: str = "text"):
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


_LETTERS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _LETTERS.findall(text.lower())


class Memo(dict):
    """A bounded word table: unknown words are computed by make, and remembered while there is room."""

    def __init__(self, make: Callable[[str], int], limit: int = MEMO_LIMIT):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


def hash64(word: str) -> int:
    """A signed 64-bit hash of a word, the same in every process."""
    raw = word.encode("utf-8", "surrogatepass")
    low, high = zlib.crc32(raw), zlib.crc32(raw, 0x9E3779B9)
    return mix_int((high << 32) | low)


def mix_int(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def mix(x: np.ndarray) -> np.ndarray:
    """The same finaliser on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lists_of(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))

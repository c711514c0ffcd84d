"""A scan of the bytes of a written bundle for private names and real tokens.

Files are cut into chunks that overlap by a token's length, so that the scan of one
large file is spread too; gzip files, which can't be cut, are unpacked as a stream. Every
place of a chunk is looked up in a Bloom filter of the tokens, as 12 raw bytes and as 24
hexadecimal digits; what passes is joined with the tokens themselves, so that a digest
or any other string that only looks like a token is no finding. Spark reads a file of
2 GB at most in this way and refuses a larger one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators.tasks import mapped

TOKEN_BYTES = 12
CHUNK_BYTES = 4 << 20
#: Bits of the filter for each token, up to FILTER_BYTES in all; a fuller filter lets more pass to the join.
BITS, FILTER_BYTES, HASHES = 16, 64 << 20, 5
_HEX_RUN = re.compile(rb"[0-9a-fA-F]{24,}")
_GZIP = b"\x1f\x8b"


class Filter:
    """A Bloom filter of tokens by their first 8 bytes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 8)

    @staticmethod
    def places(heads: np.ndarray, size: np.uint64) -> Iterator[np.ndarray]:
        x = heads
        for _ in range(HASHES):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            x = x ^ (x >> np.uint64(29))
            yield x % size

    def passed(self, heads: np.ndarray) -> np.ndarray:
        """The indexes of heads that may be a token's."""
        at = np.arange(len(heads))
        for k, place in enumerate(self.places(heads, self.size)):
            own = place[at] if k else place
            at = at[(self.bits[own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(at):
                break
        return at


def filter_of(tokens: DataFrame) -> Filter:
    """The filter of a relation's tokens, put together from the parts of its partitions."""
    n = max(1, tokens.count())
    size = min(FILTER_BYTES, 1 << max(6, math.ceil(math.log2(n * BITS / 8))))

    def run(batches):
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            heads = np.frombuffer(b"".join(t[:8] for t in batch.column(0).to_pylist() if t), "<u8")
            found += [p >> np.uint64(3) << np.uint64(3) | p & np.uint64(7) for p in Filter.places(heads, np.uint64(size * 8))]
        places = np.unique(np.concatenate(found))
        at, bit = (places >> np.uint64(3)).astype(np.int64), np.left_shift(1, places & np.uint64(7)).astype(np.int64)
        cells, first = np.unique(at, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bitwise_or.reduceat(bit, first) if len(cells) else bit)], ["cell", "bits"])

    bits = np.zeros(size, np.uint8)
    cells = mapped(tokens.select("subscriber_token"), run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    found = cells.toPandas()  # FILTER_BYTES rows at most
    bits[found["cell"]] = found["bits"]
    return Filter(bits)


def candidates(chunk: bytes, known: Filter) -> list[bytes]:
    """Tokens that may be in a chunk, as raw bytes or in hexadecimal."""
    out = []
    if len(chunk) >= TOKEN_BYTES:
        cells = np.frombuffer(chunk, np.uint8)
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(cells, 8)).view("<u8").ravel()[: len(chunk) - TOKEN_BYTES + 1]
        out += [chunk[i : i + TOKEN_BYTES] for i in known.passed(heads).tolist()]
    for run in _HEX_RUN.finditer(chunk):
        text = run[0]
        parts = [bytes.fromhex(text[i : i + 24].decode()) for i in range(len(text) - 23)]
        heads = np.frombuffer(b"".join(p[:8] for p in parts), "<u8")
        out += [parts[i] for i in known.passed(heads).tolist()]
    return out


def unpacked(content: bytes, overlap: int, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, bool, bool]]:
    """A gzip file's bytes, all its members, as (chunk, first, last); what is no gzip behind its first bytes comes as it is.

    Each chunk but the first begins with the last overlap + 1 bytes of the one before.
    """
    buffer, first = b"", True
    for part in _inflated(content, size):
        buffer += part
        if len(buffer) > max(size, 2 * overlap + 2):
            yield buffer, first, False
            buffer, first = buffer[-(overlap + 1) :], False
    yield buffer, first, True


def _inflated(content: bytes, size: int) -> Iterator[bytes]:
    rest = content
    while rest:
        decoder, data = zlib.decompressobj(31), rest
        try:
            while data and not decoder.eof:
                yield decoder.decompress(data, size)
                data = decoder.unconsumed_tail
        except zlib.error:
            yield rest
            return
        rest = decoder.unused_data


def named(word: re.Pattern | None, chunk: bytes, first: bool, last: bool, overlap: int) -> list[bytes]:
    """Names that begin in a chunk's own part: behind the byte that it begins with for context, and before the overlap, which the next chunk has too."""
    if word is None:
        return []
    begin, end = 0 if first else 1, len(chunk) if last else len(chunk) - overlap
    return [m[1] for m in word.finditer(chunk, begin) if m.start() < end]


def scanned(spark: SparkSession, folder: str, names: frozenset[str], tokens: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, kind, found, hits): names (whole words) and tokens of the relation in the files below a folder, packed or not."""
    word = re.compile(rb"(?<![0-9A-Za-z_])(" + b"|".join(sorted(re.escape(n.encode()) for n in names)) + rb")(?![0-9A-Za-z_])") if names else None
    overlap = max([2 * TOKEN_BYTES - 1, *(len(n.encode()) + 1 for n in names)])
    held = spark.sparkContext.broadcast(filter_of(tokens))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    packed = F.substring("content", 1, 2) == F.lit(_GZIP)
    starts = F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long")))
    pieces = files.select("path", "content", "length", packed.alias("packed"), F.explode(starts).alias("start"))
    first = F.col("start") == 0
    # a byte of the chunk before, for context, and the overlap with the next one
    cut = F.expr(f"substring(content, CAST(greatest(start, 1) AS INT), {chunk_bytes + overlap} + IF(start = 0, 0, 1))")
    last = F.col("start") + chunk_bytes + overlap >= F.col("length")
    chunks = pieces.select("path", "packed", F.when(F.col("packed"), F.col("content")).otherwise(cut).alias("chunk"), first.alias("first"), last.alias("last")).repartition(F.col("path"), F.xxhash64("chunk"))

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, is_packed, chunk, is_first, is_last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in unpacked(chunk, overlap, chunk_bytes) if is_packed else [(chunk, is_first, is_last)]:
                    rows += [(path, "name", n) for n in named(word, *part, overlap)]
                    rows += [(path, "token", t) for t in candidates(part[0], held.value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["path", "kind", "found"])

    found = mapped(chunks, run, "path string, kind string, found binary").groupBy("path", "kind", "found").agg(F.count("*").alias("hits"))
    real = found.filter("kind = 'token'").join(tokens.select(F.col("subscriber_token").alias("found")).distinct(), "found", "left_semi")
    return found.filter("kind = 'name'").select("path", "kind", F.col("found").cast("string").alias("found"), "hits").unionByName(real.select("path", "kind", F.lower(F.hex("found")).alias("found"), "hits"))

"""Packing into token windows (operator 3) by best-fit decreasing.

Each document becomes its ids and the separator id. Overlong documents are first
cut into full windows; the rests are packed, longest first, into the open window
with the least room that still holds them, found in a segment tree indexed by
remaining room. Pieces are dealt by hash to buckets of about BUCKET_PIECES, which
are packed apart, so that no task sees the whole and padding stays at that of the
last few windows of each bucket.

The ids are those of the tokenizers file. Texts of long-settled scripts are
encoded by tiktoken with ranks that are read from the same file, about four times
faster with equal ids; texts with special strings or other characters go to
tokenizers itself.

Defined results: null counts as empty (one piece, the separator); repeated rows
give their own pieces; further columns are left alone; sequences are padded to
the window, except where their fill is a power of two.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import held, map_batches, stored, table
from tenura.llm.tokens import tokenizer, vocabulary

WINDOW = 1024
SEPARATOR = 0
BUCKET_PIECES = 100_000

#: How this kind of file writes bytes as characters: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How the byte-level pre-tokenizer splits text (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin, Greek, Cyrillic, Hebrew, Arabic, general punctuation, kana, CJK and Hangul: characters on whose class all Unicode versions agree.
_OTHER = re.compile("[^\x00-ɏΑ-ΡΣ-ώА-яא-תء-ي‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]|<\\|")


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes to id, from a byte-level tokenizers file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    rest = (b for b in range(256) if b not in set(_PRINTABLE))
    byte_of = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in found["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}


def fast_encoding(path: str):
    """A tiktoken encoding with the file's ids."""
    import tiktoken

    return held(("packing", path), lambda: tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={}))


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a text as unsigned 32-bit integers, without the separator."""
    if _OTHER.search(text):
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast_encoding(path).encode_ordinary(text), dtype="<u4")


def pieces(docs: DataFrame, path: str, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """Each document's full windows and its rest, with the checksum of their ids."""

    def run(batch: pa.RecordBatch):
        counts, starts, lengths, sums, totals = [], [], [], [], []
        for value in batch.column("text"):
            ids = np.append(token_ids(path, value.as_py() or ""), np.array([separator], dtype="<u4")).astype("<u4")
            at = range(0, len(ids), window)
            counts.append(len(at))
            starts += at
            for k in at:
                part = ids[k : k + window]
                lengths.append(len(part))
                sums.append(zlib.crc32(part.tobytes()))
                totals.append(len(ids))
        of = np.repeat(np.arange(batch.num_rows), counts)
        longs = [pa.array(np.array(x, dtype=np.int64)) for x in (starts, lengths, sums, totals)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class RoomTree:
    """Open windows by remaining room; the tightest with at least a given room is found in log(window) steps."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: dict[int, list[int]] = {}

    def put(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the open window with the least room of at least need; it is taken out."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each of these lengths, which come in decreasing order."""
    tree, windows = RoomTree(window), 0
    to, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for k, need in enumerate(lengths.tolist()):
        if need == window:
            to[k], windows = windows, windows + 1
            continue
        room, which = tree.take(need) or (window, -1)
        if which < 0:
            which, windows = windows, windows + 1
        to[k], offset[k] = which, window - room
        if room > need:
            tree.put(room - need, which)
    return to, offset


def pack(docs: DataFrame, path: str, window: int = WINDOW, separator: int = SEPARATOR, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """One row per piece with its sequence, its offset there, and the sequence's fill and padded length."""
    cut = stored(pieces(docs, path, window, separator))
    buckets = max(1, -(-cut.count() // bucket_pieces))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = group.column("length").to_numpy()
        to, offset = best_fit(lengths, window)
        fill = np.bincount(to, weights=lengths).astype(np.int64)[to]
        padded = np.where(fill & (fill - 1), window, fill)
        bucket = group.column("bucket").to_numpy()
        columns = [group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        columns += [pa.array(x) for x in (to * buckets + bucket, offset, fill, padded)]
        return pa.table(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to"])

    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to")
    return dealt.groupBy("bucket").applyInArrow(place, ", ".join(f"{n} long" for n in names))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))

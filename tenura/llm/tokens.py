"""Token counts (operator 5), with overlap resynchronisation for huge documents.

A text up to HUGE_BYTES is cut at ASCII white space, which the vocabulary's
pre-tokenizer drops, so that no token can cross such a cut; a worker remembers
the count of each piece. A longer text is encoded in overlapping chunks with
offsets: two neighbours are spliced where both have a token end at the same
white space and agree on RUN tokens on either side; where no such place is found
the overlap is doubled, at last up to the whole rest of the text.

Defined results: null counts as empty (0 bytes, 0 tokens); special strings
inside a text are handled as the library's default does; repeated rows and null
ids each give their row; further columns are left alone.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tenura.llm.common import MEMO_LIMIT, held, map_batches, table

#: Longer texts are encoded in chunks.
HUGE_BYTES = 65_536
#: Characters of a chunk, of the first overlap, and tokens that must agree on both sides of a splice.
CHUNK, OVERLAP, RUN = 16_384, 512, 6
LIMIT_TOKENS = 2048
#: Longer pieces are counted each time and not remembered.
PIECE_BYTES = 64

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, loaded once in each process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(tok, text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends (in characters of the whole text) of text, which begins at the character at."""
    e = tok.encode(text, add_special_tokens=False)
    spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
    return np.array(e.ids, dtype=np.int64), spans[:, 0], spans[:, 1]


def splice(left: tuple, right: tuple, text: str, run: int = RUN) -> int | None:
    """A position in the overlap where both encodings may be joined, or None.

    Before it both have the same run of tokens, and after it too; at it the text
    has white space, over which no token reaches.
    """
    (li, ls, le), (ri, rs, re_) = left, right
    if not len(li) or not len(ri):
        return None
    begin = int(np.searchsorted(ls, rs[0]))
    where = {(int(s), int(e), int(i)): k for k, (s, e, i) in enumerate(zip(rs, re_, ri, strict=True))}
    agree = 0
    for k in range(begin, len(li) - run):
        j = where.get((int(ls[k]), int(le[k]), int(li[k])))
        agree = agree + 1 if j is not None else 0
        if agree >= run and text[int(le[k])].isspace():
            ahead = slice(j + 1, j + 1 + run)
            mine = slice(k + 1, k + 1 + run)
            if len(ri[ahead]) == run and np.array_equal(li[mine], ri[ahead]) and np.array_equal(ls[mine], rs[ahead]) and np.array_equal(le[mine], re_[ahead]):
                return int(le[k])
    return None


def count_huge(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a long text, from overlapping chunks."""
    total, at, begin = 0, 0, 0  # text before begin is counted
    left = encoded(tok, text[:chunk], 0)
    end = min(chunk, len(text))
    while end < len(text):
        width = overlap
        while True:
            at = max(begin, end - width)
            far = min(len(text), at + max(chunk, 2 * width))
            right = encoded(tok, text[at:far], at)
            cut = splice(left, right, text)
            if cut is not None or at == begin:
                break
            width *= 2
        if cut is None:  # the whole uncounted text is in right
            if far == len(text):
                left, end = right, far
                break
            chunk *= 2
            left, end = encoded(tok, text[begin : begin + chunk], begin), min(len(text), begin + chunk)
            continue
        total += int(np.count_nonzero((left[1] >= begin) & (left[2] <= cut)))
        begin, left, end = cut, right, far
    return total + int(np.count_nonzero(left[1] >= begin))


def count_batch(path: str, texts: list[bytes]) -> np.ndarray:
    """Token counts of UTF-8 texts."""
    tok, memo = tokenizer(path), held(("tokens", path), dict)
    if len(memo) > MEMO_LIMIT:
        memo.clear()
    pieces = [x.split() if len(x) <= HUGE_BYTES else () for x in texts]
    new = list(set(chain.from_iterable(pieces)).difference(memo))
    extra: dict[bytes, int] = {}
    for begin in range(0, len(new), 4096):
        part = new[begin : begin + 4096]
        for piece, e in zip(part, tok.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
            (memo if len(piece) <= PIECE_BYTES else extra)[piece] = len(e)
    if extra:
        counted = [sum(memo[p] if p in memo else extra[p] for p in x) for x in pieces]
    else:
        counted = [sum(map(memo.__getitem__, x)) for x in pieces]
    for k, x in enumerate(texts):
        if len(x) > HUGE_BYTES:
            counted[k] = count_huge(tok, x.decode())
    return np.array(counted, dtype=np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        n = np.concatenate([count_batch(path, texts[i : i + 512]) for i in range(0, len(texts), 512)])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))

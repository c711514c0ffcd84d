"""Benchmark decontamination (operator 8) by latent semantic retrieval.

1. Document frequencies of the benchmark's terms over all documents give IDF
   weights; a word that no item holds weighs as much as the rarest. The same pass
   writes how often the terms occur in each window.
2. Items are cut into passages of PASSAGE words, STEP apart (shorter ones stay
   whole). The TF-IDF rows of these passages and of windows of all documents are
   factored by a randomised SVD, both with the same total weight. Up to GRAM_TERMS
   terms, tasks add up A'A by pairs of terms in one pass; with more they return
   A'(A Q) as partial sums by term in each round. The driver orthonormalises a matrix
   of at most TERMS rows.
3. Windows of documents, as long as passages and STEP apart too, are compared with
   all passages by their cosine in the latent space; pairs of CANDIDATE or more go
   on. Only windows are projected that lie in a stretch with HELD of the weight of the
   rarer half of some passage's words, which running sums over an index of those tell.
4. A pair is checked by the longest common subsequence. The document holds the item
   where REACH passage lengths of it have PART of a passage in order; or where the
   words around have SHARE of the item and ANSWER of its answer (its last sentence), or
   VERBATIM of the item; or RUN words of it in a row, or SHORT_RUN that are RUN_SHARE of
   it; or, in any order of its parts, TRIPLES of its word triples; or PLACED of the
   weight of its words, SHORT words at least, within DRIFT places of where one shift
   of the item puts them (neighbours that change places, many words replaced). Items
   of fewer than SHORT words must be held word by word.

Items are searched in blocks of ITEM_BLOCK, each within one broadcast of bounded
size; with several blocks each is one pass, of which only the hits are joined to the
documents.

Defined results: null texts hold nothing; items without a word match nothing; an
empty benchmark leaves all documents clean; items of equal text are all named;
repeated rows each give their row; further columns are left alone.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.llm.common import hash64, held, map_batches, map_partitions, stored, table, whole_text

#: Terms are hashed to so many rows at most; latent dimensions, and further ones for the range finder; power iterations.
TERMS, LATENT, SPARE, ROUNDS = 65_536, 128, 16, 2
#: Terms up to which A'A is summed once, as a dense half square in each task; its rows that are added up together, and tasks whose sums one group holds.
GRAM_TERMS, GRAM_ROWS, GRAM_TASKS = 4_096, 32, 64
#: Documents that are cut into windows together, and windows of them that are handed on together.
CUT_DOCS, CUT_WINDOWS = 512, 8_192
#: Words of a passage and of a window, and between the beginnings of two.
PASSAGE, STEP = 16, 4
#: Words of the windows of documents that are factored; how often a term occurs there fits a byte.
DOC_WINDOW = 4 * PASSAGE
#: Cosine in the latent space of a window and a passage.
CANDIDATE = 0.55
#: What a stretch must hold to be projected: this share of the weight of the rarer half of a passage, within so many times its length.
HELD, REACH = 0.3, 1.5
#: Words before and behind a window that are checked with it, and the share of a passage's words that must be among them.
SLACK, COMMON = 4, 0.43
#: Shares that make a document hold an item: of a passage; of the item and its answer; of the item alone; of its word triples.
PART, SHARE, ANSWER, VERBATIM, TRIPLES = 0.75, 0.6, 0.5, 0.85, 0.5
#: Words in a row that make a document hold an item: so many, or fewer that are such a share of the item.
RUN, SHORT_RUN, RUN_SHARE = 10, 7, 0.45
#: Share of an item's weight that makes a document hold it where its words lie so many places off at most.
PLACED, DRIFT = 0.4, 2
#: Items of fewer words must be held word by word.
SHORT = 8
#: Pairs of word and item, and windows, that are looked at together; pairs of terms that are added up together.
PAIRS, WINDOWS, GRAM_PAIRS = 1_000_000, 1024, 100_000
ITEM_BLOCK = 20_000
#: Hits that may be broadcast when several blocks of items are searched; more are joined by a shuffle.
BROADCAST_HITS = 100_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Characters that are no part of words: ASCII ones, and those of the Latin-1, general and CJK punctuation blocks.
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\r\x0b\x0c")
_WIDE = re.compile("[\x85\xa0-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u1680\u2000-\u206f\u3000-\u3003\u3008-\u3011]")


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words, without the marks in and around them, as UTF-8."""
    low = (text or "").lower()
    if not low.isascii():
        low = _WIDE.sub(lambda m: " " if m[0].isspace() else "", low)
    return low.encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def answer_words(text: str | None) -> list[bytes]:
    """The words of the last sentence that has any, where there are several; else all."""
    parts = [w for w in map(item_words, _SENTENCE.split((text or "").strip())) if w]
    return parts[-1] if parts else []


class Vocabulary:
    """The items' terms: words by number, and each one's hashed row (below size), -1 for other words. It grows with the benchmark, not with the documents."""

    def __init__(self, words: set[bytes], terms: int = TERMS):
        self.size = min(terms, max(1, len(words)))
        self.numbers = {w: k for k, w in enumerate(sorted(words))}
        self.rows = np.array([hash64(w.decode("utf-8", "surrogatepass")) % self.size for w in self.numbers] + [-1], np.int32)

    def numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's words, -1 for words outside."""
        words = item_words(text)
        return np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))

    def terms(self, text: str) -> np.ndarray:
        """The rows of a text's words, -1 for words outside."""
        return self.rows[self.numbered(text)]


def document_frequencies(counts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each row occurs, and the number of documents, from the sums that the tasks of counted() left."""
    summed_up = counts.filter("documents IS NOT NULL").select(F.posexplode("documents").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(size + 1, np.int64)
    for row in summed_up.toLocalIterator():  # one row a term, bounded by TERMS
        df[row["term"]] = row["n"]
    return df[:size], int(df[size])


def tfidf(terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and weights of a passage, scaled to unit length together with its words outside the vocabulary."""
    inside = terms[terms >= 0]
    rows, tf = np.unique(inside, return_counts=True)
    weights = tf * idf[rows]
    norm = np.sqrt((weights**2).sum() + np.count_nonzero(terms < 0) * idf.max(initial=0.0) ** 2)
    return rows, weights / norm if norm else weights


def beginnings(n: int, length: int = PASSAGE, step: int = STEP) -> list[int]:
    """Where the passages of n words begin; the last one ends with them."""
    return sorted({*range(0, max(1, n - length + 1), step), max(0, n - length)})


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of so many of the values each, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def bytes_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells with so many of the values each, one after the other."""
    offsets = (np.concatenate([[0], np.cumsum(counts)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def bytes_of(cells: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values in binary cells, one after the other, and how many each has."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    width = np.dtype(kind).itemsize
    return np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // width


def window_counts(texts: list[np.ndarray], length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of so many words, end to end, of texts given as terms: terms and how often each occurs there; then of all windows that hold a term the number of terms, of words outside, and the text."""
    lengths = np.array([len(x) for x in texts], np.int64)
    counts = -(-lengths // length)
    first = np.cumsum(counts) - counts
    terms = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    window = np.repeat(first, lengths) + ranges(lengths) // length
    inside, n = terms >= 0, int(counts.sum())
    cells, tf = np.unique(window[inside] * size + terms[inside], return_counts=True)
    of, rows = np.divmod(cells, size)
    sizes, outside = np.bincount(of, minlength=n), np.bincount(window[~inside], minlength=n)
    some = sizes > 0
    return rows, tf, sizes[some], outside[some], np.repeat(np.arange(len(texts)), counts)[some]


def counted(items: DataFrame, docs: DataFrame, vocabulary) -> DataFrame:
    """The terms of the passages of all items and of windows of all documents, stored once in a row a window; and for each task
    over documents a row with the number of those that hold each term, the last being that of all documents.

    Weights are put in where rows are read (weighing()), so that documents are cut into words once for both.
    """

    def packed(own: bool, rows: np.ndarray, tf: np.ndarray, sizes: np.ndarray, outside: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, len(sizes), CUT_WINDOWS):
            windows = slice(at, at + CUT_WINDOWS)
            n, cells = len(sizes[windows]), slice(ends[at], ends[min(at + CUT_WINDOWS, len(sizes))])
            lists = [bytes_array(rows[cells].astype(np.int32), sizes[windows]), bytes_array(tf[cells].astype(np.uint8), sizes[windows])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own)), *lists, pa.array(outside[windows].astype(np.int32)), pa.nulls(n, pa.list_(pa.int64()))], schema=_COUNTS)

    def of_items(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = map(vocabulary.value.terms, batch.column("text").to_pylist())
        cut = [terms[at : at + PASSAGE] for terms in texts for at in beginnings(len(terms))]
        return packed(True, *window_counts(cut, PASSAGE, vocabulary.value.size)[:4])

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("decontaminate", "fit"), lambda: None)  # what the worker keeps of other operators goes
        size = vocabulary.value.size
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CUT_DOCS):
                texts = [vocabulary.value.terms(t) for t in batch.column("text").slice(at, CUT_DOCS).to_pylist()]
                rows, tf, sizes, outside, text = window_counts(texts, DOC_WINDOW, size)
                held_by = np.unique(np.repeat(text, sizes) * size + rows) % size
                total[:size] += np.bincount(held_by, minlength=size)
                total[size] += len(texts)
                yield from packed(False, rows, tf, sizes, outside)
        yield pa.RecordBatch.from_pylist([{"own": False, "documents": total}], _COUNTS)

    schema, texts = "own boolean, rows binary, tf binary, outside int, documents array<long>", whole_text().alias("text")
    return stored(map_batches(items.select(texts), of_items, schema).unionByName(map_partitions(docs.select(texts), of_documents, schema)))


_COUNTS = pa.schema([("own", pa.bool_()), ("rows", pa.binary()), ("tf", pa.binary()), ("outside", pa.int32()), ("documents", pa.list_(pa.int64()))])

#: What a batch of a matrix has, some windows at a time: their terms and weights, one after the other, and how many of them each has.
Cells = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The cells of a matrix with a row of lists (rows, weights) a window."""
    rows, weights = (batch.column(k).flatten().to_numpy() for k in ("rows", "weights"))
    yield rows, weights, np.diff(batch.column("rows").offsets.to_numpy()).astype(np.int64)


def weighing(counts: DataFrame, idf) -> tuple[DataFrame, Cells]:
    """The matrix to factor, from counted(), and its cells: tfidf() of each passage and window, each side (items, documents) with half of the weight."""
    n = {r["own"]: r["n"] for r in counts.groupBy("own").agg(F.count("rows").alias("n")).collect()}
    scale = (max(1, n.get(False, 0)) / max(1, n.get(True, 0))) ** 0.5

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, sizes = bytes_of(batch.column("rows"), np.int32)
        tf, _ = bytes_of(batch.column("tf"), np.uint8)
        of = np.repeat(np.arange(len(sizes)), sizes)
        weights = tf * idf.value[rows]
        norms = np.sqrt(np.bincount(of, weights**2, len(sizes)) + batch.column("outside").to_numpy() * idf.value.max(initial=0.0) ** 2)
        scales = np.where(batch.column("own").to_numpy(zero_copy_only=False), scale, 1.0)
        yield rows, weights * (scales / np.where(norms > 0, norms, 1.0))[of], sizes

    return counts.filter("rows IS NOT NULL").drop("documents"), cells


def passages(items: DataFrame, docs: DataFrame, vocabulary, idf) -> DataFrame:
    """The matrix to factor as a whole, a row (rows, weights) a passage or window."""
    matrix, cells = weighing(counted(items, docs, vocabulary), idf)

    def lists(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, weights, sizes in cells(batch):
            yield pa.RecordBatch.from_arrays([list_array(rows, sizes), list_array(weights, sizes)], ["rows", "weights"])

    return map_batches(matrix, lists, "rows array<int>, weights array<double>")


class PairSums:
    """A'A of some windows without what lies below its diagonal: row by row from the diagonal on, half a square of the terms."""

    def __init__(self, terms: int):
        self.terms = terms
        lengths = np.arange(terms, -1, -1)
        self.begins = np.cumsum(lengths) - lengths
        self.ahead = self.begins - np.arange(terms + 1)  # where column 0 of a row would lie
        self.total = np.zeros(self.begins[terms])

    def add(self, rows: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> None:
        """Add each pair of a window's terms once, GRAM_PAIRS of them at a time."""
        ends = np.repeat(np.cumsum(sizes), sizes)
        # each term with itself and those behind it in its row
        counts = ends - np.arange(len(rows))
        upto = np.cumsum(counts)
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GRAM_PAIRS, side="right")))
            i = np.repeat(np.arange(at, end), counts[at:end])
            j = i + ranges(counts[at:end])
            np.add.at(self.total, self.ahead[rows[i]] + rows[j], weights[i] * weights[j])
            at = end

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each GRAM_ROWS rows the number, and the non-zero cells with their sums, counted as in whole rows."""
        for first in range(0, self.terms, GRAM_ROWS):
            begin, end = self.begins[[first, min(first + GRAM_ROWS, self.terms)]]
            found = begin + np.flatnonzero(self.total[begin:end])
            if len(found):
                row = np.searchsorted(self.begins, found, side="right") - 1
                yield first // GRAM_ROWS, (row - first) * self.terms + found - self.ahead[row], self.total[found]


def gram_blocks(matrix: DataFrame, terms: int, cells_of: Cells = listed) -> DataFrame:
    """A'A without what lies below its diagonal, stored as blocks of GRAM_ROWS rows: tasks add up each pair of a row's terms once, Spark adds the non-zero cells of the tasks.

    Beyond GRAM_TASKS tasks, those of so many are added up first, so that no group grows with all of them.
    """
    schema = "block int, part int, cells binary, sums binary"

    def partial(block: int, part: int, cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"block": block, "part": part, "cells": cells.astype(np.int32).tobytes(), "sums": sums.tobytes()}], _CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("decontaminate", "fit"), lambda: None)
        total, part = PairSums(terms), TaskContext.get().partitionId() // GRAM_TASKS
        for cells in chain.from_iterable(map(cells_of, batches)):
            total.add(*cells)
        for block, found, sums in total.blocks():
            yield partial(block, part, found, sums)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(GRAM_ROWS * terms)
        for cells, sums in zip(group.column("cells"), group.column("sums"), strict=True):
            total[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer())
        found = np.flatnonzero(total)
        return pa.Table.from_batches([partial(group.column("block")[0].as_py(), group.column("part")[0].as_py(), found, total[found])])

    parts = map_partitions(matrix, run, schema)
    if matrix.rdd.getNumPartitions() > GRAM_TASKS:
        parts = parts.groupBy("block", "part").applyInArrow(add, schema)
    return stored(parts.groupBy("block").applyInArrow(add, schema))


_CELLS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())])


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of partial() of all tasks, an array of this shape each, added up by blocks of 256 rows in Spark."""

    def run(batches):
        total = partial(batches)
        blocks = range(0, len(total), 256)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([total[k : k + 256].ravel() for k in blocks], pa.list_(pa.float64()))], ["block", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in group.column("sums")], axis=0)
        return pa.table([group.column("block").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], names=["block", "sums"])

    parts = map_partitions(rows, run, "block long, sums array<double>").groupBy("block").applyInArrow(add, "block long, sums array<double>")
    out = np.zeros(shape)
    for row in parts.toLocalIterator():
        part = np.array(row["sums"]).reshape(-1, shape[1])
        out[row["block"] : row["block"] + len(part)] = part
    return out


def product(blocks: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'A Q from the blocks of gram_blocks(): the driver holds matrices of Q's shape alone."""
    shared = blocks.sparkSession.sparkContext.broadcast(q)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        base = shared.value
        total, terms = np.zeros_like(base), len(base)
        for batch in batches:
            for block, cells, sums in zip(*(batch.column(c) for c in ("block", "cells", "sums")), strict=True):
                own = np.zeros(GRAM_ROWS * terms)
                own[np.frombuffer(cells.as_buffer(), np.int32)] = np.frombuffer(sums.as_buffer())
                first = block.as_py() * GRAM_ROWS
                own = own.reshape(GRAM_ROWS, terms)[: terms - first, first:]
                total[first : first + len(own)] += own @ base[first:]
                # the cells across the diagonal, which itself counts once
                np.fill_diagonal(own, 0.0)
                total[first:] += own.T @ base[first : first + len(own)]
        return total

    out = summed(blocks.select("block", "cells", "sums"), partial, q.shape)
    shared.unpersist()
    return out


def gram(matrix: DataFrame, terms: int) -> np.ndarray:
    """A'A as a whole, for few terms."""
    return product(gram_blocks(matrix, terms), np.eye(terms))


def gathered(matrix: DataFrame, q: np.ndarray, square: bool, cells_of: Cells = listed) -> np.ndarray:
    """A'(A Q), or (A Q)'(A Q) if square."""
    shared = matrix.sparkSession.sparkContext.broadcast(q)
    shape = (q.shape[1] if square else len(q), q.shape[1])

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        base, total = shared.value, np.zeros(shape)
        for rows, weights, sizes in chain.from_iterable(map(cells_of, batches)):
            ends = np.cumsum(sizes)
            for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                own, w = rows[begin:end], weights[begin:end]
                y = w @ base[own]
                if square:
                    total += np.outer(y, y)
                else:
                    total[own] += w[:, None] * y
        return total

    out = summed(matrix, partial, shape)
    shared.unpersist()
    return out


def latent_space(matrix: DataFrame, terms: int, k: int = LATENT, spare: int = SPARE, rounds: int = ROUNDS, cells_of: Cells = listed) -> np.ndarray:
    """The leading right singular vectors of the matrix, all of its rows, by randomised subspace iteration."""
    width, blocks = min(terms, k + spare), gram_blocks(matrix, terms, cells_of) if terms <= GRAM_TERMS else None
    times = lambda q: gathered(matrix, q, False, cells_of) if blocks is None else product(blocks, q)
    q, _ = np.linalg.qr(np.random.default_rng(20).standard_normal((terms, width)))
    for _ in range(rounds + 1):
        q, _ = np.linalg.qr(times(q))
    values, vectors = np.linalg.eigh(gathered(matrix, q, True, cells_of) if blocks is None else q.T @ times(q))
    best = np.argsort(values)[::-1][: min(k, width)]
    return (q @ vectors[:, best]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """The length of the longest common subsequence, a bit for each word of a."""
    where: dict = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << k)
    full, row = (1 << len(a)) - 1, 0
    for w in b:
        x = row | where.get(w, 0)
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; those without length stay."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(norms > 1e-9, norms, 1.0)[:, None]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def window_length(n: int) -> int:
    """Words of the windows for an item of n words: the next power of two, PASSAGE at most."""
    return min(PASSAGE, 1 << max(0, n - 1).bit_length())


def needed(n: int, share: float) -> int:
    """How many of n words are this share; of fewer than SHORT all are needed."""
    return n if n < SHORT else math.ceil(share * n)


def longest_run(a: list, b: list) -> int:
    """The most words in a row that a and b share."""
    where: dict = {}
    for k, w in enumerate(a):
        where.setdefault(w, []).append(k)
    best, before = 0, {}
    for w in b:
        now = {k: before.get(k - 1, 0) + 1 for k in where.get(w, ())}
        best, before = max(best, max(now.values(), default=0)), now
    return best


def in_place(item: np.ndarray, region: np.ndarray, weights: np.ndarray, least: float = PLACED, drift: int = DRIFT) -> float:
    """The share of the weight of an item's words that a region holds within drift places of where one shift puts them; 0 below least or SHORT words.

    Item and region are word numbers, -1 for words without one. Words held count once on
    either side, so that the lesser of both sides' weights is taken.
    """
    total = weights[item].sum()
    order = np.argsort(item, kind="stable")
    low, high = np.searchsorted(item[order], region), np.searchsorted(item[order], region, side="right")
    counts = np.where(region >= 0, high - low, 0)
    j = np.repeat(np.arange(len(region)), counts)
    i = order[ranges(counts) + low[j]]
    by_shift = np.argsort(j - i, kind="stable")
    i, j = i[by_shift], j[by_shift]
    shift, mass = j - i, weights[item[i]]
    # each band of shifts begins at one that occurs; repeated words count too often here, so this is a bound
    begins = np.flatnonzero(np.diff(shift, prepend=shift[:1] - 1)) if len(shift) else np.zeros(0, np.int64)
    ends = np.searchsorted(shift, shift[begins] + 2 * drift, side="right")
    sums = np.concatenate([[0.0], np.cumsum(mass)])
    bound, best = sums[ends] - sums[begins], 0.0
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < max(best, least * total) - 1e-9:
            break
        band = slice(begins[k], ends[k])
        own, held_at = np.unique(i[band]), np.unique(j[band])
        if min(len(own), len(held_at)) >= SHORT:
            best = max(best, min(weights[item[own]].sum(), weights[region[held_at]].sum()))
    return float(best / total) if total > 0 and best >= least * total - 1e-9 else 0.0


class Searcher:
    """Candidate search and checks of one block of items."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray):
        self.ids = [i for i, _ in items]
        self.words, self.answers = [item_words(t) for _, t in items], [answer_words(t) for _, t in items]
        self.triples = [set(zip(w, w[1:], w[2:], strict=False)) for w in self.words]
        self.vocabulary = vocabulary
        # one more row, of zeros, for words outside
        self.term_vectors = np.concatenate([space * idf[:, None].astype(np.float32), np.zeros((1, space.shape[1]), np.float32)])
        numbers = [np.fromiter((vocabulary.numbers[w] for w in words), np.int64, len(words)) for words in self.words]
        self.numbers = numbers
        self.passages = [(k, at) for k, words in enumerate(self.words) if words for at in beginnings(len(words))]
        self.lengths = np.array([window_length(len(w)) for w in self.words], np.int64)
        # passages and their latent vectors by the length of the windows that they are compared with
        of = np.array([self.lengths[k] for k, _ in self.passages], np.int64)
        self.groups = {int(length): np.flatnonzero(of == length) for length in np.unique(of)}
        vectors = [self.term_vectors[vocabulary.rows[numbers[k][at : at + PASSAGE]]].sum(axis=0) for k, at in self.passages]
        vectors = unit(np.array(vectors, np.float32).reshape(-1, space.shape[1]))
        self.vectors = {length: vectors[own].T.copy() for length, own in self.groups.items()}
        # -2 fills up passages, and is no word
        self.passage_words = np.full((len(self.passages), PASSAGE), -2, np.int32)
        for row, (k, at) in enumerate(self.passages):
            part = numbers[k][at : at + PASSAGE]
            self.passage_words[row, : len(part)] = part
        self._index_rare_words(numbers, idf)

    def _index_rare_words(self, numbers: list[np.ndarray], idf: np.ndarray) -> None:
        """The items by the rarer half of each passage's words, and how much of their weight within how many words a stretch needs."""
        weights = np.append(idf[self.vocabulary.rows[:-1]], 0.0)
        self.mass, self.reach = np.zeros(len(numbers)), np.ones(len(numbers), np.int64)
        words, items = [], []
        for k, own in enumerate(numbers):
            n = min(len(own), PASSAGE)
            self.reach[k] = max(1, int(REACH * n))
            rare: set[int] = set()
            masses = []
            for at in beginnings(len(own)) if n else ():
                part = own[at : at + PASSAGE]
                order = part[np.lexsort((part, -weights[part]))][: -(-n // 2)]
                rare.update(order.tolist())
                masses.append(weights[order].sum())
            self.mass[k] = HELD * min(masses, default=0.0)
            words += sorted(rare)
            items += [k] * len(rare)
        order = np.argsort(np.array(words, np.int64), kind="stable")
        self.rare_items, self.weights = np.array(items, np.int64)[order], weights
        self.rare_counts = np.bincount(np.array(words, np.int64), minlength=len(self.vocabulary.numbers) + 1)  # 0 at the end, for -1
        self.rare_begins = np.cumsum(self.rare_counts) - self.rare_counts

    def stretches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and item of the stretches with enough weight of an item's rarer words, in the joined words of texts that begin at first."""
        counts = self.rare_counts[words]
        at = np.repeat(np.arange(len(words)), counts)
        items = self.rare_items[ranges(counts) + self.rare_begins[words[at]]]
        # one order of item and place; a stretch ends with its text
        places = items * (len(words) + 1) + at
        places.sort()
        items, at = np.divmod(places, len(words) + 1)
        until = np.minimum(at + self.reach[items], first[np.searchsorted(first, at, side="right")])
        last = np.searchsorted(places, items * (len(words) + 1) + until)
        total = np.concatenate([[0.0], np.cumsum(self.weights[words[at]])])
        k = np.flatnonzero(total[last] - total[:-1] >= self.mass[items] - 1e-6)
        return at[k], at[last[k] - 1] + 1, items[k]

    def windows(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, latent vectors) of the windows around stretches, some at a time."""
        begins, ends, items = self.stretches(words, first)
        rows = np.append(self.vocabulary.rows[words], np.full(PASSAGE, -1, np.int32))
        for length in self.groups:
            of = self.lengths[items] == length
            begin, end, step = begins[of], ends[of], max(1, length * STEP // PASSAGE)
            # the windows that hold a stretch, or lie in one longer than they are
            text = first[np.searchsorted(first, begin, side="right") - 1]
            low = np.maximum(np.minimum(end - length, begin) - text - step + 1, 0)
            high = np.maximum(np.maximum(end - length, begin) - text, 0)
            low, high = -(-low // step), high // step
            k = np.repeat(np.arange(len(begin)), high - low + 1)
            places = np.unique(text[k] + (ranges(high - low + 1) + low[k]) * step)
            for part in range(0, len(places), WINDOWS):
                own = places[part : part + WINDOWS]
                cells = own[:, None] + np.arange(length)
                found = np.where(cells < first[np.searchsorted(first, own, side="right")][:, None], rows[cells], -1)
                vectors = np.zeros((len(own), self.term_vectors.shape[1]), np.float32)
                for column in range(length):
                    vectors += self.term_vectors[found[:, column]]
                yield length, own, vectors

    def candidates(self, numbers: list[np.ndarray]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """For each text and item the pairs (first word of the window, number of the passage) whose cosine is high enough."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        total = sum(self.rare_counts[x].sum() for x in numbers)
        if total > PAIRS and len(numbers) > 1:
            half = len(numbers) // 2
            later = self.candidates(numbers[half:])
            return self.candidates(numbers[:half]) | {k + half: found for k, found in later.items()}
        if not total:
            return out
        first = np.cumsum([0, *map(len, numbers)])
        words = np.concatenate(numbers)
        for length, places, vectors in self.windows(words, first):
            window, passage = np.nonzero(unit(vectors) @ self.vectors[length] >= CANDIDATE)
            passage = self.groups[length][passage]
            own = self.share_words(words, places[window], passage)
            window, passage = window[own], passage[own]
            texts = np.searchsorted(first, places[window], side="right") - 1
            for text, at, p in zip(texts.tolist(), (places[window] - first[texts]).tolist(), passage.tolist(), strict=True):
                out.setdefault(text, {}).setdefault(self.passages[p][0], []).append((at, p))
        return out

    def share_words(self, words: np.ndarray, places: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Which pairs of window and passage share the words, COMMON of the passage's, that any check needs near by."""
        out = np.zeros(len(places), bool)
        around = np.arange(-SLACK, PASSAGE + SLACK)
        for part in range(0, len(places), 4 * WINDOWS):
            p = passage[part : part + 4 * WINDOWS]
            near = words[np.clip(places[part : part + 4 * WINDOWS, None] + around, 0, len(words) - 1)]
            shared = (self.passage_words[p][:, :, None] == near[:, None, :]).any(axis=2).sum(axis=1)
            out[part : part + 4 * WINDOWS] = shared >= COMMON * (self.passage_words[p] >= 0).sum(axis=1)
        return out

    def check(self, words: list[bytes], numbers: np.ndarray, i: int, pairs: list[tuple[int, int]]) -> float:
        """The best share of item i that a region around these windows holds, 0 where no check is passed."""
        item, best, seen = self.words[i], 0.0, -1
        for at, p in sorted(pairs):
            part = item[self.passages[p][1] :][:PASSAGE]
            if len(item) < SHORT:
                best = max(best, float(any(words[k : k + len(item)] == item for k in range(max(0, at - len(item)), at + PASSAGE))))
                continue
            near = words[max(0, at - SLACK) : at + PASSAGE + SLACK]
            if not best and common_subsequence(part, near) >= needed(len(part), PART):
                best = len(part) / len(item)
            if at >= seen:  # from any window within an item's length of it the whole item is seen
                seen = at + PASSAGE
                around = slice(max(0, at - len(item)), seen + len(item))
                best = max(best, self._share(i, words[around]) or in_place(self.numbers[i], numbers[around], self.weights))
        return best

    def _share(self, i: int, region: list[bytes]) -> float:
        """The share of item i that a region holds in order, or as word triples; 0 below the limits."""
        item, answer, triples = self.words[i], self.answers[i], self.triples[i]
        if len(triples & set(zip(region, region[1:], region[2:], strict=False))) >= TRIPLES * len(triples):
            return 1.0 if item == region else max(TRIPLES, common_subsequence(item, region) / len(item))
        held_words, least = common_subsequence(item, region), min(RUN, max(SHORT_RUN, RUN_SHARE * len(item)))
        share = held_words / len(item)
        # words in a row are in order, so fewer in order than needed leave no such run
        if held_words >= least and longest_run(item, region) >= least:
            return share
        held_too = share >= VERBATIM or share >= SHARE and common_subsequence(answer, region) >= ANSWER * len(answer)
        return share if held_too else 0.0

    def search(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """(item id, share) of the items that each text holds."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        numbers = [self.vocabulary.numbered(t) for t in texts]
        for k, items in self.candidates(numbers).items():
            words = item_words(texts[k])
            shares = ((self.ids[i], self.check(words, numbers[k], i, pairs)) for i, pairs in items.items())
            out[k] = sorted((i, s) for i, s in shares if s > 0)
        return out


def fit(docs: DataFrame, items: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray] | None:
    """Vocabulary, IDF weights and latent space; None where the items hold no word."""
    spark = docs.sparkSession

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column("text") for w in item_words(t.as_py())}), pa.binary())], ["word"])

    found = {bytes(r["word"]) for r in map_batches(items.select(whole_text().alias("text")), run, "word binary").distinct().toLocalIterator()}
    if not found:
        return None
    vocabulary = spark.sparkContext.broadcast(Vocabulary(found))
    counts = counted(items, docs, vocabulary)
    df, n = document_frequencies(counts, vocabulary.value.size)
    idf = np.log((n + 1.0) / (df + 1.0)) + 1e-3
    matrix, cells = weighing(counts, spark.sparkContext.broadcast(idf))
    return Vocabulary(found), idf, latent_space(matrix, len(idf), cells_of=cells)


def item_blocks(items: DataFrame, size: int = ITEM_BLOCK):
    """The items in blocks of at most size rows, in the order of a hash."""
    n = items.count()
    blocks = -(-n // size)
    own = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    if blocks <= 1:
        yield [(r["item_id"], r["text"]) for r in own.collect()]
        return
    numbered = stored(own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))))
    for k in range(2 * blocks):
        yield [(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == k).collect()]


FIELDS = [T.StructField("items", T.ArrayType(T.LongType())), T.StructField("share", T.DoubleType()), T.StructField("contaminated", T.BooleanType())]


def searched(docs: DataFrame, block: list[tuple[int, str]], fitted) -> DataFrame:
    """docs with items, share and contaminated of one block of items."""
    spark, mark = docs.sparkSession, uuid.uuid4().hex  # the mark tells this search from others of a reused worker
    shared = spark.sparkContext.broadcast(block)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        searcher = held(("decontaminate", mark), lambda: Searcher(shared.value, *fitted.value))
        hits: list[list[tuple[int, float]]] = []
        for at in range(0, batch.num_rows, 256):
            hits += searcher.search([t or "" for t in batch.column("text").slice(at, 256).to_pylist()])
        added = [
            pa.array([sorted(i for i, _ in h) for h in hits], pa.list_(pa.int64())),
            pa.array([max((s for _, s in h), default=0.0) for h in hits], pa.float64()),
            pa.array([bool(h) for h in hits], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(f.name for f in FIELDS)])

    return map_batches(docs, run, T.StructType([*docs.schema, *FIELDS]))


def contaminated(docs: DataFrame, items: DataFrame, block_size: int = ITEM_BLOCK) -> DataFrame:
    """docs with items (ids of the benchmark items held, ascending), share (of the item held best) and contaminated added."""
    docs = docs.drop(*(f.name for f in FIELDS))
    nothing = {"items": F.array().cast("array<long>"), "share": F.lit(0.0), "contaminated": F.lit(False)}
    found = fit(docs, items)
    if found is None:
        return docs.withColumns(nothing)
    fitted = docs.sparkSession.sparkContext.broadcast(found)
    blocks = [b for b in item_blocks(items, block_size) if b] if items.count() <= block_size else None
    if blocks is not None:
        return searched(docs, blocks[0], fitted)
    digest = F.sha2(whole_text(), 256)
    texts = docs.select("text")
    hits = reduce(DataFrame.unionByName, (stored(searched(texts, b, fitted).filter("contaminated").select(digest.alias("digest"), "items", "share")) for b in item_blocks(items, block_size) if b))
    each = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    hits = stored(hits.groupBy("digest").agg(each.alias("items"), F.max("share").alias("share")))
    few = hits.count() <= BROADCAST_HITS
    mark = f"digest_{uuid.uuid4().hex}"
    hits = hits.select(F.col("digest").alias(mark), "items", "share")
    joined = docs.withColumn(mark, digest).join(F.broadcast(hits) if few else hits, mark, "left").drop(mark)
    return joined.withColumns({"contaminated": F.col("items").isNotNull(), "items": F.coalesce("items", nothing["items"]), "share": F.coalesce("share", F.lit(0.0))}).select(*docs.columns, *(f.name for f in FIELDS))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "items", "share", "contaminated")

"""Approximate nearest neighbours by collision counting (operator 13).

1. A vector's value under each of PROJECTIONS random directions is one number. A task
   takes its rows in segments and sorts, for each direction, a segment's values.
2. Around a query's own value a window of half width HALF_WIDTH * r is opened in every
   sorted array; a row that lies in it collides once. Virtual rehashing: r grows by
   GROWTH, and each round adds only the rows by which the windows have grown.
3. Rows that collide THRESHOLD times or more are verified by their exact distance,
   which lowers the query's bound: the k-th distance found in this task so far.
   A query ends once r has reached its bound.
4. The best rows of the tasks are merged, within salts of a query first.

A row at distance r collides with a fixed probability under each direction, whatever
the data, so that of the rows within r a share of MISS at most stays below the
threshold: at the end this holds for every row within the bound, hence for each true
neighbour. The first bound of a query is its k-th exact distance in a bounded sample of
rows (BOUND_ROWS). No count of candidates ends a search.

Queries are handled in passes of QUERY_BYTES, whose size is counted first; a pass reads
all rows once, without a shuffle of them.

Defined results: vectors that are null, empty, zero, hold null or non-finite entries,
or have another length than the most frequent one take no part, nor do rows without
vec_id; rows that share a vec_id are one item, at the smallest distance of its rows,
and never each other's candidates; with fewer than k candidates all are returned; empty
tables give no rows; further columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import best_rows, map_partitions, stored, table
from tenura.llm.vectors import dimensions, finite, matrix, not_zero

NEIGHBOURS = 10
PROJECTIONS, HALF_WIDTH, MISS, SEED = 128, 1.13, 0.02, 13
#: The first radius as a share of the first bound, and by what it grows.
FIRST, GROWTH = 0.25, 1.5
#: Rows of a segment; queries whose collisions are counted at a time.
SEGMENT_ROWS, QUERY_ROWS = 16_384, 128
#: Rows that give the first bounds; bytes of query vectors in one pass.
BOUND_ROWS, QUERY_BYTES = 4096, 64 << 20


def threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """The most collisions that a row at the radius reaches with a probability of 1 - miss."""
    p = math.erf(half_width / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(width: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((projections, width))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances, each row by itself, so that equal vectors have equal distances."""
    apart = rows - query
    return np.sqrt((apart * apart).sum(axis=1))


def nearest_ids(found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest different ids, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, found))
    found, ids = found[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return found[first], ids[first]


class Segment:
    """Some rows and, by direction, their sorted values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, along: np.ndarray):
        self.ids, self.vectors = ids, vectors
        values = along @ vectors.T
        self.order = np.argsort(values, axis=1).astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each sorted array."""
        half = half[:, None] + 1e-9 * (1 + np.abs(at))  # equal vectors' values differ by rounding
        lower, upper = (at - half).T, (at + half).T
        begin = np.array([np.searchsorted(v, x, "left") for v, x in zip(self.values, lower, strict=True)]).T
        return begin, np.array([np.searchsorted(v, x, "right") for v, x in zip(self.values, upper, strict=True)]).T

    def search(self, queries: Queries, some: slice, needed: int, k: int) -> None:
        """Lower the bounds and better the neighbours of some queries by what this segment holds."""
        own = range(*some.indices(len(queries.ids)))
        at, n = queries.at[some], len(self.ids)
        counts = np.zeros((len(own), n), np.int16)
        open_ = {i: None for i in range(len(own))}
        radius = FIRST * queries.bounds[some]
        while open_:
            active = np.fromiter(open_, np.int64)
            begins, ends = self.windows(at[active], HALF_WIDTH * radius[active])
            for i, begin, end in zip(active.tolist(), begins, ends, strict=True):
                last, q = open_[i], own[i]
                if last is None:
                    parts = [o[a:b] for o, a, b in zip(self.order, begin, end, strict=True)]
                else:
                    parts = [o[a:b] for o, a, b in zip(self.order, begin, last[0], strict=True)]
                    parts += [o[a:b] for o, a, b in zip(self.order, last[1], end, strict=True)]
                open_[i] = begin, end
                row = counts[i]
                row += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                chosen = np.flatnonzero(row >= needed)
                row[chosen] = np.iinfo(np.int16).min  # verified once
                chosen = chosen[self.ids[chosen] != queries.ids[q]]
                if len(chosen):
                    queries.offer(q, distances(self.vectors[chosen], queries.vectors[q]), self.ids[chosen], k)
                if radius[i] >= queries.bounds[q]:
                    del open_[i]
                else:
                    radius[i] = min(radius[i] * GROWTH, queries.bounds[q])


class Queries:
    """Query vectors with their bounds and the neighbours found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, along: np.ndarray):
        self.ids, self.vectors, self.bounds = ids, vectors, bounds.copy()
        self.at = (along @ vectors.T).T
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def offer(self, q: int, found: np.ndarray, ids: np.ndarray, k: int) -> None:
        near = found <= self.bounds[q]
        if near.any():
            had = self.found[q]
            self.found[q] = best = nearest_ids(np.concatenate((had[0], found[near])), np.concatenate((had[1], ids[near])), k)
            if len(best[0]) == k:
                self.bounds[q] = min(self.bounds[q], best[0][-1])


def segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, up to the rows of a segment at a time."""
    held: list[pa.RecordBatch] = []

    def joined():
        return np.concatenate([b.column("vec_id").to_numpy() for b in held]), np.concatenate([matrix(b.column("vector"), width) for b in held])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SEGMENT_ROWS:
            yield joined()
            held = []
    if held:
        yield joined()


def taking_part(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """vec_id and vector, in doubles, of the rows that take part."""
    doubles = F.transform(column, lambda c: c.cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite(column) & not_zero(column) & (F.size(column) == width))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("vector"))


def bounded(queries: DataFrame, rows: DataFrame, width: int, k: int, bound_rows: int) -> DataFrame:
    """The different queries with the k-th distance to a sample of rows, infinite where it has fewer; written."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(bound_rows).toPandas()  # bounded by bound_rows
    ids = sample["vec_id"].to_numpy(np.int64)
    held = rows.sparkSession.sparkContext.broadcast((ids, np.array(sample["vector"].tolist(), np.float64).reshape(-1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        for batch in batches:
            out = []
            for own, vector in zip(batch.column("vec_id").to_pylist(), matrix(batch.column("vector"), width), strict=True):
                others = ids != own
                near, _ = nearest_ids(distances(vectors[others], vector), ids[others], k)
                out.append(near[-1] if len(near) == k else math.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["vec_id", "vector", "bound"])

    return stored(map_partitions(queries.distinct(), run, "vec_id long, vector array<double>, bound double"))


def search_pass(rows: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the neighbours that each task has found for these queries, whose vectors are broadcast."""
    own = queries.toPandas()  # about QUERY_BYTES
    vectors = np.array(own["vector"].tolist(), np.float64).reshape(-1, width)
    held = rows.sparkSession.sparkContext.broadcast((own["vec_id"].to_numpy(np.int64), vectors, own["bound"].to_numpy(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        along, needed = directions(width), threshold()
        queries = Queries(*held.value, along)
        for ids, vectors in segments(batches, width):
            segment = Segment(ids, vectors, along)
            for begin in range(0, len(queries.ids), QUERY_ROWS):
                segment.search(queries, slice(begin, begin + QUERY_ROWS), needed, k)
        for begin in range(0, len(queries.ids), 1000):
            some = queries.found[begin : begin + 1000]
            ids = np.repeat(queries.ids[begin : begin + 1000], [len(x[0]) for x in some])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([x[1] for x in some])), pa.array(np.concatenate([x[0] for x in some]))], ["query_id", "vec_id", "score"])

    return map_partitions(rows, run, "query_id long, vec_id long, score double")


FOUND = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, column: str = "embedding", bound_rows: int = BOUND_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and distance of the k nearest rows found for each row of queries."""
    width = dimensions(vectors.filter(finite(column) & not_zero(column) & F.col("vec_id").isNotNull()), column)
    if not width:
        return vectors.sparkSession.createDataFrame([], FOUND)
    rows, asked = taking_part(vectors, column, width), bounded(taking_part(queries, column, width), taking_part(vectors, column, width), width, k, bound_rows)
    passes = -(-asked.count() * width * 8 // query_bytes)
    own, parts = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, passes))), []
    for p in range(passes):
        part = search_pass(rows, asked.filter(own == p), width, k)
        parts.append(part if passes == 1 else stored(part))
    if not parts:
        return vectors.sparkSession.createDataFrame([], FOUND)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    nearest_rows = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = best_rows(nearest_rows, "query_id", [F.col("score").asc(), F.col("vec_id").asc()], k, F.col("vec_id"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))

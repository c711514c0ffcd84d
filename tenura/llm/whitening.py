"""Embedding whitening by cyclic Jacobi rotations (operator 11).

Each entry c of a vector becomes the whole number x = floor(64 c) + 1000000.

1. The fit list, each different x-vector once, is made by a distinct() that
   collapses copies before the shuffle, and is written.
2. Tasks add up the exact sums S by dimension, then the scatter of x - S/n: each
   task centres its rows before it multiplies them, and adds them to one matrix.
   The matrices are added by row index in as many tasks as there are partitions.
3. The driver gets the d x d covariance, whatever the number of rows, and rotates it
   by cyclic Jacobi: every sweep annihilates each pair once, in rounds of disjoint
   pairs, until each off-diagonal entry is below the rounding of its own two
   diagonals. That relative bound is what keeps small eigenvalues accurate.
4. Eigenvalues are sorted, the first components are broadcast, and every row is
   projected. The covariance of the whitened fit list is measured, not assumed.

Defined results: vectors that are null, empty, or hold null or non-finite entries are
dropped, and so are those of another length than the most frequent one; 64 c is held
within 4e18 in size, so that x is a long; each repeated row gives its rows, a null
vec_id too; an eigenvalue that rounding can't tell from 0 (constant or dependent
dimensions, a single vector) has no whitened values (null) and doesn't count for the
identity error; without any eigenvalue explained and identity error are null; an
empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import map_partitions, stored, table
from tenura.llm.vectors import dimensions, finite, matrix

COMPONENTS = 16
#: x = floor(SCALE * c) + SHIFT, with SCALE * c held within LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 4e18
#: The driver holds a matrix of this width at most, 128 MB.
MOST_DIMENSIONS = 4096
EPSILON = float(np.finfo(np.float64).eps)
SWEEPS = 40


def whole_numbers(column: str) -> Column:
    """The x-vector of a vector."""
    scaled = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(column, lambda c: F.floor(scaled(c)).cast("long") + F.lit(SHIFT).cast("long"))


def jacobi(symmetric: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors, as columns, of a symmetric matrix."""
    a, d = np.array(symmetric, dtype=np.float64), len(symmetric)
    vectors, places = np.eye(d), np.arange(d + d % 2)
    half = len(places) // 2
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(places) - 1):
            left, right = places[:half], places[half:][::-1]
            p, q = np.minimum(left, right), np.maximum(left, right)
            p, q = p[q < d], q[q < d]
            off = np.abs(a[p, q]) > EPSILON * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if off.any():
                rotated = True
                _rotate(a, vectors, p[off], q[off])
            places = np.concatenate((places[:1], places[-1:], places[1:-1]))
        if not rotated:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    return values[order], vectors * np.where(largest < 0, -1.0, 1.0)


def _rotate(a: np.ndarray, vectors: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Annihilate a[p, q] for disjoint pairs at once."""
    entry, at_p, at_q = a[p, q], a[p, p], a[q, q]
    theta = (at_q - at_p) / (2 * entry)
    tangent = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
    cosine = 1 / np.hypot(tangent, 1.0)
    sine = tangent * cosine
    for m in (a, vectors):
        m[:, p], m[:, q] = cosine * m[:, p] - sine * m[:, q], sine * m[:, p] + cosine * m[:, q]
    rows_p, rows_q = a[p, :], a[q, :]
    a[p, :], a[q, :] = cosine[:, None] * rows_p - sine[:, None] * rows_q, sine[:, None] * rows_p + cosine[:, None] * rows_q
    a[p, q] = a[q, p] = 0.0
    a[p, p], a[q, q] = at_p - tangent * entry, at_q + tangent * entry


@dataclass(frozen=True)
class Centre:
    """The mean S/n of the fit list, as its whole part and the rest."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts are subtracted exactly, before anything is rounded."""
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S) squared, of each row."""
        y, rest = x - self.whole, np.array([s % self.n for s in self.sums], dtype=object)
        most, largest = int(np.abs(y).max(initial=0)), max(rest, default=0)
        fits = len(self.sums) * most * max(most, largest) < 1 << 62
        y, r = (y, rest.astype(np.int64)) if fits else (y.astype(object), rest)
        constant = sum(int(v) ** 2 for v in rest)
        squares, products = (y * y).sum(axis=1), (y * r).sum(axis=1)
        return [self.n * (self.n * int(s) - 2 * int(p)) + constant for s, p in zip(squares, products, strict=True)]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: components are the columns of axes, by falling eigenvalue; null where rounding hides one."""

    centre: Centre
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    usable: np.ndarray
    identity_error: float | None

    @property
    def scaled(self) -> np.ndarray:
        """The whitening matrix; columns of components without an eigenvalue are not a number."""
        return self.axes / np.sqrt(np.where(self.usable, self.eigenvalues, np.nan))


def fit_list(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """Each different x-vector once, written."""
    return stored(vectors.filter(F.size(column) == width).select(whole_numbers(column).alias("x")).distinct())


def column_sums(fit: DataFrame, width: int) -> Centre | None:
    """n and S of the fit list, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            x = matrix(batch.column("x"), width)
            fits = int(np.abs(x).max()) * len(x) < 1 << 62
            total = [t + int(s) for t, s in zip(total, (x if fits else x.astype(object)).sum(axis=0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total)), pa.array([n] * width, pa.int64())], ["i", "total", "n"])

    parts = map_partitions(fit, run, "i int, total string, n long")
    rows = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # a row for each dimension
    return Centre(rows[0]["n"], tuple(int(r["total"]) for r in sorted(rows))) if rows else None


def scatter(fit: DataFrame, width: int, of) -> np.ndarray:
    """The sum of z'z over the rows z = of(x) of the fit list, and below it the sum of z."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = of(matrix(batch.column("x"), width))
            own = np.vstack((z.T @ z, z.sum(axis=0)))
            total = own if total is None else total + own
        if total is not None:
            yield as_rows(range(len(total)), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                own = row.values.to_numpy()
                total[i] = total[i] + own if i in total else own
        if total:
            yield as_rows(list(total), np.array(list(total.values())))

    def as_rows(index, rows: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["i", "row"])

    schema = "i int, row array<double>"
    parts = map_partitions(fit, products, schema).repartition("i")
    return np.array([r["row"] for r in sorted(map_partitions(parts, added, schema).collect())])  # a row for each dimension


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all finite vectors of a table; None where it has none."""
    found = vectors.filter(finite(column))
    width = dimensions(found, column)
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{width} dimensions, {MOST_DIMENSIONS} at most")
    if not width:
        return None
    rows = fit_list(found, column, width)
    centre = column_sums(rows, width)
    sums = scatter(rows, width, centre.centred)
    covariance, drift = sums[:-1] / centre.n, sums[-1] / centre.n
    values, axes = jacobi((covariance + covariance.T) / 2)
    values, axes = values[:components], axes[:, :components]
    size = (np.diag(covariance)[:, None] * axes**2).sum(axis=0)
    usable = values > width * EPSILON * size
    trace = float(np.trace(covariance))
    explained = [float(v) / trace if trace > 0 else None for v in values]
    model = Whitening(centre, axes, values, explained, usable, None)
    return Whitening(centre, axes, values, explained, usable, identity_error(rows, model, drift))


def identity_error(rows: DataFrame, model: Whitening, drift: np.ndarray) -> float | None:
    """The largest entry by which the covariance of the whitened fit list differs from the identity; drift is what rounding left of its mean."""
    if not model.usable.any():
        return None
    scaled, centre = model.scaled[:, model.usable], model.centre
    found = scatter(rows, len(centre.sums), lambda x: (centre.centred(x) - drift) @ scaled)[:-1] / centre.n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """vec_id, deviation (null beyond 38 digits) and whitened values of every finite vector of the model's length."""
    width = len(model.centre.sums)
    held = vectors.sparkSession.sparkContext.broadcast((model.centre, model.scaled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, scaled = held.value
        for batch in batches:
            x = matrix(batch.column("x"), width)
            values = centre.centred(x) @ scaled
            deviations = [Decimal(v) if v < 10**38 else None for v in centre.deviations(x)]
            flat = pa.array(values.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    rows = vectors.filter(finite(column) & (F.size(column) == width)).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(column).alias("x"))
    return map_partitions(rows, run, "vec_id long, deviation decimal(38,0), whitened array<double>")


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each finite vector and component; deviation is null where it is no long."""
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    explained = F.array(*(F.lit(v).cast("double") for v in model.explained))
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))

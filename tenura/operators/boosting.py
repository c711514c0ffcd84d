"""Gradient boosting of trees over histograms, for a 0/1 target.

Rows become bins once: a numeric feature is cut at percentiles, a coded one has a bin
for each of its codes, and the last bin is for what is missing or unknown. A tree grows
leaf by leaf, the best gain first. One job adds up the gradients of all leaves whose
children may be needed, by feature and bin; a sibling's sums are the difference.

The sums are of whole numbers (gradients times 2^32), so that the same trees come of
any layout of the rows. They lie in partitions of about ROWS rows, however many tasks
the table came from: a fit has hundreds of jobs, whose time is that of their tasks. The
binned rows are written once as blocks; after FLUSH trees the blocks are persisted with
their score anew, and a task adds the trees since then. What the driver holds are sums
by leaf, feature and bin, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenura.operators.scratch import written
from tenura.operators.tasks import added_blocks, mapped, ship

BINS, MISSING = 256, 255
#: Of gradients as whole numbers.
UNIT = 1 << 32
#: Trees after which the rows are persisted with their score anew.
FLUSH = 10
#: Rows of a partition while a model is fitted.
ROWS = 50_000
#: A code with fewer rows in a leaf isn't put to the left; the ratio that codes are ordered by is damped by so much.
LEAST_SUPPORT, DAMPING = 10, 10.0
LEAST_HESSIAN = 1e-3


@dataclass(frozen=True)
class Parameters:
    iterations: int = 80
    rate: float = 0.08
    leaves: int = 15
    least_rows: int = 100
    l2: float = 0.1


@dataclass(frozen=True)
class Binning:
    """Edges of numeric features and codes of the others; a value up to edge i is in bin i."""

    numeric: tuple[str, ...]
    coded: tuple[str, ...]
    edges: list[list[float]]
    codes: list[list[int]]

    @property
    def is_coded(self) -> np.ndarray:
        return np.array([False] * len(self.numeric) + [True] * len(self.coded))

    def columns(self) -> list[Column]:
        return [F.col(c).cast("double").alias(c) for c in (*self.numeric, *self.coded)]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Rows x features; columns are doubles, not a number where missing."""
        out = np.full((len(columns[0]), len(columns)), MISSING, np.uint8)
        for k, values in enumerate(columns):
            there = ~np.isnan(values)
            if k < len(self.numeric):
                out[there, k] = np.searchsorted(self.edges[k], values[there], "left")
            else:
                codes = np.array(self.codes[k - len(self.numeric)], dtype=float)  # sorted
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, values), len(codes) - 1)
                    out[:, k] = np.where(there & (codes[at] == values), at, MISSING)
        return out


def binning(rows: DataFrame, numeric: tuple[str, ...], coded: tuple[str, ...]) -> Binning:
    """Edges midway between neighbouring percentiles, and the 255 most frequent codes."""
    grid = F.array(*(F.lit(k / (BINS - 2)) for k in range(BINS - 1)))
    plain = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    found = rows.agg(*(F.percentile_approx(plain(c), grid, 10_000).alias(c) for c in numeric)).first()
    edges = []
    for c in numeric:
        values = np.unique(found[c] or [])
        edges.append(((values[:-1] + values[1:]) / 2).tolist())
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("code")) for c in coded)))
    counts = rows.select(pairs.alias("x")).select("x.*").filter("code IS NOT NULL").groupBy("name", "code").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("name").orderBy(F.col("n").desc(), "code"))
    kept = counts.withColumn("place", place).filter(F.col("place") < BINS).collect()  # 255 for each feature at most
    return Binning(tuple(numeric), tuple(coded), edges, [sorted(r["code"] for r in kept if r["name"] == c) for c in coded])


@dataclass
class Tree:
    """Nodes as parallel lists; the bins of mask go to the left, and a leaf has no left node."""

    feature: list[int] = field(default_factory=lambda: [0])
    mask: list[list[int]] = field(default_factory=lambda: [[]])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, leaf: int, split: Split, left: float, right: float) -> tuple[int, int]:
        a = len(self.feature)
        for value in (left, right):
            self.feature.append(0)
            self.mask.append([])
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(value)
        self.feature[leaf], self.mask[leaf], self.left[leaf], self.right[leaf] = split.feature, np.flatnonzero(split.mask).tolist(), a, a + 1
        return a, a + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at, todo = np.zeros(len(bins), np.int64), [(0, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                at[rows] = node
            elif len(rows):
                mask = np.zeros(BINS, bool)
                mask[self.mask[node]] = True
                goes_left = mask[bins[rows, self.feature[node]]]
                todo += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass(frozen=True)
class Split:
    """A leaf's best split: its gain, the bins that go left, and (gradient, hessian, rows) of both sides."""

    gain: float
    feature: int
    mask: np.ndarray
    left: tuple[float, float, int]
    right: tuple[float, float, int]

    @property
    def smaller_left(self) -> bool:
        return self.left[2] <= self.right[2]


def best_split(sums: np.ndarray, coded: np.ndarray, p: Parameters) -> Split | None:
    """The split of most gain from a leaf's sums, features x bins x (gradient, hessian, rows); None where none is allowed."""
    best = None
    whole = sums[0].sum(axis=0)
    score = lambda g, h: g * g / (h + p.l2)
    for f in range(len(sums)):
        own = sums[f]
        missing = own[MISSING]
        if coded[f]:
            used = np.flatnonzero(own[:, 2] >= LEAST_SUPPORT)
            order = used[np.argsort(own[used, 0] / (own[used, 1] + DAMPING), kind="stable")]
            ways = [(order, np.zeros(3))]
        else:
            order = np.flatnonzero(own[:MISSING, 2] > 0)
            ways = [(order, np.zeros(3))] + ([(order, missing)] if missing[2] else [])
        for way, (order, start) in enumerate(ways):
            if not len(order):
                continue
            left = start + np.cumsum(own[order], axis=0)
            right = whole - left
            allowed = (np.minimum(left[:, 2], right[:, 2]) >= p.least_rows) & (np.minimum(left[:, 1], right[:, 1]) >= LEAST_HESSIAN)
            if not allowed.any():
                continue
            gain = np.where(allowed, score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(whole[0], whole[1]), -np.inf)
            k = int(gain.argmax())
            if gain[k] > 0 and (best is None or gain[k] > best.gain):
                mask = np.zeros(BINS, bool)
                if coded[f]:
                    mask[order[: k + 1]] = True
                else:
                    mask[: order[k] + 1] = True
                    mask[MISSING] = way == 1 or not missing[2] and left[k, 2] > right[k, 2]
                best = Split(float(gain[k]), f, mask, tuple(left[k]), tuple(right[k]))
    return best


def grow(histograms: Callable[[Tree, list], list[np.ndarray]], coded: np.ndarray, p: Parameters) -> Tree:
    """A tree by best-first splits. histograms(tree, wanted) gives the sums of leaves (leaf, None) or of a leaf's smaller child (leaf, split)."""
    tree = Tree()
    (root,) = histograms(tree, [(0, None)])
    value = lambda side: -p.rate * side[0] / (side[1] + p.l2)
    tree.value[0] = value(root[0].sum(axis=0))
    sums, splits, children = {0: root}, {0: best_split(root, coded, p)}, {}
    for leaves in range(2, p.leaves + 1):
        open_ = {leaf: s for leaf, s in splits.items() if s}
        if not open_:
            break
        leaf = max(open_, key=lambda k: (open_[k].gain, -k))
        split = open_[leaf]
        if leaves < p.leaves and leaf not in children:
            wanted = [(k, s) for k, s in open_.items() if k not in children]
            for (k, s), small in zip(wanted, histograms(tree, wanted), strict=True):
                large = sums[k] - small
                children[k] = (small, large) if s.smaller_left else (large, small)
        nodes = tree.split(leaf, split, value(split.left), value(split.right))
        del splits[leaf]
        if leaves < p.leaves:
            for node, own in zip(nodes, children.pop(leaf), strict=True):
                sums[node], splits[node] = own, best_split(own, coded, p)
    return tree


@dataclass(frozen=True)
class Boosted:
    """A fitted model: the score of a row is a start and the sum of its trees' values."""

    bins: Binning
    start: float
    trees: list[Tree]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.start + sum((t.scores(bins) for t in self.trees), np.zeros(len(bins)))

    def with_margin(self, rows: DataFrame) -> DataFrame:
        """rows with the column margin."""
        ship(rows.sparkSession)
        held = rows.sparkSession.sparkContext.broadcast(self)

        def margin(*columns):
            model = held.value
            return type(columns[0])(model.scores(model.bins.binned([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])))

        import pandas as pd

        margin.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return rows.withColumn("margin", F.pandas_udf(margin, "double")(*self.bins.columns()))

    def as_dict(self) -> dict:
        return {"numeric": self.bins.numeric, "coded": self.bins.coded, "edges": self.bins.edges, "codes": self.bins.codes, "start": self.start, "trees": [vars(t) for t in self.trees]}

    @classmethod
    def from_dict(cls, own: dict) -> Boosted:
        return cls(Binning(tuple(own["numeric"]), tuple(own["coded"]), own["edges"], own["codes"]), own["start"], [Tree(**t) for t in own["trees"]])


#: Bins (rows x features), target and score of some rows.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def with_bins(rows: DataFrame, bins: Binning, target: str, n: int) -> DataFrame:
    """Bins and target of every row of n, as blocks in partitions of about ROWS rows; written."""

    def run(batches):
        for batch in batches:
            found = bins.binned([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 1)])
            y = batch.column(batch.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["bins", "y"])

    own = rows.select(*bins.columns(), F.col(target).cast("double").alias("y")).repartition(max(1, -(-n // ROWS)))
    return written(mapped(own, run, "bins binary, y binary"))


def scored(table: DataFrame, start: float, groups: list[list[Tree]], features: int) -> RDD:
    """The blocks with their score after these trees, persisted when they are first read."""

    def block(row) -> Block:
        bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, features)
        score = np.full(len(bins), start)
        for trees in groups:
            score = score + sum(t.scores(bins) for t in trees)
        return bins, np.frombuffer(row["y"]), score

    return table.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def leaf_sums(blocks: RDD, trees: list[Tree], features: int, tree: Tree, wanted: list) -> list[np.ndarray]:
    """Features x bins x (gradient, hessian, rows) of each wanted leaf or smaller child, over all rows."""

    def of(block: Block) -> np.ndarray:
        bins, y, score = block
        score = score + sum((t.scores(bins) for t in trees), np.zeros(len(bins)))
        chance = 1 / (1 + np.exp(-score))
        gradient, hessian = chance - y, chance * (1 - chance)
        weights = [np.rint(gradient * UNIT), np.rint(hessian * UNIT)]
        leaf, places = tree.leaves(bins), BINS * np.arange(features)
        out = np.zeros((len(wanted), features, BINS, 3), np.int64)
        for k, (node, split) in enumerate(wanted):
            chosen = np.flatnonzero(leaf == node)
            if split is not None:
                chosen = chosen[split.mask[bins[chosen, split.feature]] == split.smaller_left]
            at = (bins[chosen] + places).ravel()
            for c, weight in enumerate(weights):
                # whole numbers of at most 2^32, and few rows in a block: exact in a double
                out[k, :, :, c] = np.bincount(at, np.repeat(weight[chosen], features), features * BINS).reshape(features, BINS)
            out[k, :, :, 2] = np.bincount(at, minlength=features * BINS).reshape(features, BINS)
        return out.reshape(len(wanted) * features, BINS * 3)

    total = added_blocks(blocks, of, (len(wanted) * features, BINS * 3)).reshape(len(wanted), features, BINS, 3)
    return [np.concatenate((own[..., :2] / UNIT, own[..., 2:].astype(float)), axis=-1) for own in total]


def fit(rows: DataFrame, numeric: tuple[str, ...], coded: tuple[str, ...], target: str, parameters: Parameters = Parameters()) -> Boosted:
    """A model of the 0/1 target; a target of one value alone gives a model without trees."""
    n = rows.agg(F.count(target).alias("n"), F.sum(F.col(target).cast("double")).alias("yes")).first()
    yes, no = n["yes"] or 0.0, n["n"] - (n["yes"] or 0.0)
    bins = binning(rows, numeric, coded)
    if not yes or not no:
        return Boosted(bins, float(np.log((yes + 1) / (no + 1))), [])
    start = float(np.log(yes / no))
    features, groups = len(numeric) + len(coded), [[]]
    table = with_bins(rows, bins, target, n["n"])
    blocks = scored(table, start, [], features)
    for k in range(parameters.iterations):
        since = groups[-1]
        since.append(grow(lambda tree, wanted: leaf_sums(blocks, since, features, tree, wanted), bins.is_coded, parameters))  # noqa: B023
        if len(since) == FLUSH and k + 1 < parameters.iterations:
            blocks.unpersist()
            blocks = scored(table, start, list(groups), features)
            groups.append([])
    blocks.unpersist()
    return Boosted(bins, start, [t for trees in groups for t in trees])

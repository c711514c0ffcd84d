"""Exact quantiles of any group, however large, without a task that holds one.

Small groups are sorted where they are gathered. Of a large one the wanted rank is
bracketed: a sketch of percentiles names two values around it, and exact counts of
what lies below, at, between and above them tell which of these parts has the rank.
The search goes on within that part alone. A part never holds the values that bound
it, so that every step leaves fewer different values, and about 3 of GRID rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators.scratch import written

#: Rows of a group or bracket that may be sorted in one place.
SMALL = 50_000
#: Percentiles of a sketch, and its accuracy.
GRID, ACCURACY = 256, 4_000
#: Brackets that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Quantile:
    """A share of a group's values: the value at its nearest rank, or between the two ranks around its place."""

    share: str
    nearest: bool = False

    def ranks(self, n: Column) -> list[Column]:
        """The ranks, from 1, in exact arithmetic: one, or the two around the place."""
        share = F.lit(Decimal(self.share))
        if self.nearest:
            return [F.greatest(F.ceil(share * n).cast("long"), F.lit(1).cast("long"))]
        below = F.floor(share * (n - 1)).cast("long") + 1
        return [below, F.least(below + 1, n)]

    def value(self, n: Column, at) -> Column:
        """The quantile from at(rank), the value of a rank."""
        values = [at(rank) for rank in self.ranks(n)]
        if self.nearest:
            return values[0]
        place = F.lit(Decimal(self.share)) * (n - 1)
        part = (place - F.floor(place)).cast("double")
        return F.when(part == 0, values[0]).otherwise(values[0] + (values[1] - values[0]) * part)


MEDIAN = Quantile("0.5")


def exact_quantiles(df: DataFrame, by: list[str], column: str, wanted: dict[str, Quantile], nan_counts: bool = True, small: int = SMALL) -> DataFrame:
    """by, values (how many aren't null), nans, and each quantile of column.

    Nulls are no values. NaN is the largest value, or none where nan_counts is False;
    a group without values has null quantiles. Null keys are a group.
    """
    value = F.col(column)
    nan = F.isnan(value) if df.schema[column].dataType.typeName() in ("float", "double") else F.lit(False)
    rows = df.select(*by, value.alias("value"), nan.alias("nan"), F.lit(0).alias("whole"))
    keys = by or ["whole"]
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("value").isNotNull() & ~F.col("nan")).alias("numbers"), F.count_if(F.coalesce("nan", F.lit(False))).alias("nans"))
    sizes = written(sizes.withColumn("values", F.col("numbers") + F.when(F.lit(nan_counts), F.col("nans")).otherwise(0)))
    n = F.col("values")
    ranks = F.array_distinct(F.array(*(r for q in wanted.values() for r in q.ranks(n))))
    places = sizes.filter("numbers > 0").select(*keys, F.explode(ranks).alias("rank"), F.col("numbers").alias("n")).filter("rank <= n")
    found = values_at(rows.filter("value IS NOT NULL AND NOT nan").select(*keys, "value"), keys, places, small)
    lists = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # a few for each group
    joined = _joined(sizes, lists, keys, "left")
    at = lambda rank: F.when(rank > F.col("numbers"), F.lit(float("nan"))).otherwise(F.try_element_at("at", rank))
    out = {name: F.when(n > 0, q.value(n, at)) for name, q in wanted.items()}
    return joined.select(*by, "values", "nans", *(c.alias(name) for name, c in out.items()))


def values_at(values: DataFrame, by: list[str], places: DataFrame, small: int = SMALL) -> DataFrame:
    """by, rank and the value of that rank, from 1, in a group; places has by, rank and n, the group's size.

    values has by and value, without null and NaN.
    """
    keys = [*by, "rank"]
    places = written(places.select(*keys, F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    open_ = places.filter(F.col("inside") > small)
    found = [_sorted(_joined(values, places.filter(F.col("inside") <= small), by), keys)]
    if open_.isEmpty():
        return found[0]
    rows = _joined(values, open_, by).select(*keys, "value", "below", "inside")
    while True:
        parts = written(_parts(_joined(rows, written(_cuts(rows, keys)), keys), keys))
        found.append(parts.filter("low = high").select(*keys, F.col("low").alias("value")))
        left = parts.filter("low < high")
        if left.isEmpty():
            break
        within = F.col("value").between(F.col("low"), F.col("high"))
        rows = written(_joined(rows.select(*keys, "value"), left, keys).filter(within).select(*keys, "value", "below", "inside"))
        found.append(_sorted(rows.filter(F.col("inside") <= small), keys))
        rows = rows.filter(F.col("inside") > small)
        if left.filter(F.col("inside") > small).isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with few's columns by equal keys, where null equals null; few is broadcast where its size allows."""
    other = few.select(*(F.col(k).alias(f"of_{k}") for k in keys), *(c for c in few.columns if c not in keys))
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys))
    return rows.join(other, same, how).drop(*(f"of_{k}" for k in keys))


def _sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The value at each rank of brackets that are small."""
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("values"), F.first("below").alias("below"))
    return lists.select(*keys, F.element_at("values", (F.col("rank") - F.col("below")).cast("int")).alias("value"))


def _cuts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two values around each rank, from a sketch of its bracket."""
    grid = F.percentile_approx("value", F.array(*(F.lit(k / GRID) for k in range(GRID + 1))), ACCURACY)
    sketch = rows.groupBy(*keys).agg(grid.alias("grid"), F.first("below").alias("below"), F.first("inside").alias("inside"))
    at = F.floor((F.col("rank") - F.col("below")) * GRID / F.col("inside")).cast("int")
    cut = lambda place: F.element_at("grid", F.greatest(F.lit(1), F.least(F.lit(GRID + 1), place)))
    return sketch.select(*keys, cut(at).alias("left"), cut(at + 3).alias("right"))


def _parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, below, inside, low and high of the part that has the rank: below the cuts, at one, between them, or above."""
    v, left, right = F.col("value"), F.col("left"), F.col("right")
    part = F.when(v < left, 0).when(v == left, 1).when(v < right, 2).when(v == right, 3).otherwise(4)
    counts = rows.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("below").alias("below"))
    lists = counts.groupBy(*keys).agg(F.first("below").alias("start"), F.array_sort(F.collect_list(F.struct("part", "n", "low", "high"))).alias("parts"))  # five at most
    before = F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0).cast("long"), lambda total, p: total + p["n"])
    placed = lists.select(*keys, "start", "parts", F.posexplode("parts").alias("k", "own")).withColumn("below", F.col("start") + before)
    has = (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("own.n"))
    return placed.filter(has).select(*keys, "below", F.col("own.n").alias("inside"), "own.low", "own.high")

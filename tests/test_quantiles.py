import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import quantiles
from tenura.operators.quantiles import MEDIAN, Quantile, exact_quantiles

WANTED = {"median": MEDIAN, "low": Quantile("0.025"), "high": Quantile("0.975"), "p95": Quantile("0.95", True), "least": Quantile("0", True), "most": Quantile("1")}


def check(got, values):
    values = np.sort(np.array(values, dtype=float))
    assert got["values"] == len(values)
    for name, share in (("median", 0.5), ("low", 0.025), ("high", 0.975), ("most", 1.0)):
        assert got[name] == pytest.approx(np.quantile(values, share), rel=1e-12, nan_ok=True)
    assert got["p95"] == pytest.approx(values[max(1, -(-95 * len(values) // 100)) - 1], nan_ok=True) and got["least"] == pytest.approx(values[0], nan_ok=True)


@pytest.mark.parametrize("small", [3, 40, 50_000])
def test_against_sorting(spark, small):
    rng = np.random.default_rng(small)
    groups = {
        "spread": rng.normal(size=700) * 10.0 ** rng.integers(-200, 200, 700), "ties": rng.integers(0, 3, 900).astype(float), "same": np.full(300, 2.5),
        "one": np.array([7.0]), "two": np.array([1.0, 4.0]), "mixed": np.concatenate((np.zeros(500), rng.normal(size=80))), None: np.arange(60.0),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [("spread", None), ("nulls", None), ("nulls", None), ("nan", math.nan), ("nan", 1.0), ("nan", None), ("only nan", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", WANTED, small=small).collect()}
    assert set(got) == {*groups, "nulls", "nan", "only nan"}
    for g, values in groups.items():
        check(got[g], values)
    assert got["nulls"]["values"] == 0 and got["nulls"]["median"] is None
    assert (got["nan"]["values"], got["nan"]["nans"]) == (2, 1) and math.isnan(got["nan"]["median"]) and math.isnan(got["nan"]["p95"]) and got["nan"]["least"] == 1
    skipped = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", WANTED, False, small).collect()}
    assert skipped["nan"]["median"] == 1 and skipped["only nan"]["median"] is None and skipped["only nan"]["nans"] == 1


def test_a_million_different_values_in_one_group(spark):
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, 1).otherwise(2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 3.0).alias("v"))
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", WANTED, small=1000).collect()}
    rows = df.toPandas()
    for g in (1, 2):
        check(got[g], rows["v"][rows["g"] == g])


def test_no_group_meets_in_one_task(spark, monkeypatch):
    """Of a group beyond SMALL only brackets are gathered, so that no list is longer."""
    gathered, plain = [], quantiles._sorted
    monkeypatch.setattr(quantiles, "_sorted", lambda rows, keys: gathered.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) or plain(rows, keys))
    df = spark.range(30_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    got = exact_quantiles(df, [], "v", {"median": MEDIAN}, small=200).first()
    assert got["median"] == pytest.approx(float(np.median(df.toPandas()["v"]))) and max(gathered) <= 200 and len(gathered) > 1


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, ["g"], "v", WANTED).count() == 0 and exact_quantiles(empty, [], "v", WANTED).count() == 0

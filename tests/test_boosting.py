import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators import boosting, tasks
from tenura.operators.boosting import BINS, MISSING, Parameters

SMALL = Parameters(iterations=4, leaves=6, least_rows=12)


def rows_of(spark, n=700, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c, kind = rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.normal(size=n), rng.integers(-1, 9, n)
    logit = 2 * (a > 0.3) - 1.5 * np.isin(kind, (2, 5, 7)) + (b == 3) * 1.2 - 0.4
    a[rng.random(n) < 0.2] = np.nan
    logit += np.isnan(a) * 1.5
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    data = [(None if np.isnan(x) else float(x), float(v), float(w), int(k), int(t)) for x, v, w, k, t in zip(a, b, c, kind, y, strict=True)]
    return spark.createDataFrame(data, "a double, b double, c double, kind int, y int"), data


def plain_gains(bins, gradient, hessian, coded, p):
    """The best gain of each feature, by trying every split on the rows themselves."""
    score = lambda rows: gradient[rows].sum() ** 2 / (hessian[rows].sum() + p.l2)
    everything = np.ones(len(bins), bool)
    best = []
    for f in range(bins.shape[1]):
        x, sides = bins[:, f], []
        if coded[f]:
            values = [v for v in np.unique(x) if (x == v).sum() >= boosting.LEAST_SUPPORT]
            values.sort(key=lambda v: gradient[x == v].sum() / (hessian[x == v].sum() + boosting.DAMPING))
            sides = [np.isin(x, values[: k + 1]) for k in range(len(values))]
        else:
            for t in np.unique(x[x != MISSING]):
                sides += [(x <= t) & (x != MISSING), (x <= t) | (x == MISSING)]
        gains = [score(s) + score(~s) - score(everything) for s in sides if min(s.sum(), (~s).sum()) >= p.least_rows]
        best.append(max(gains, default=-np.inf))
    return best


def plain_fit(bins, y, coded, p):
    """Scores by the same boosting on arrays, leaf by leaf, every leaf's rows summed anew."""
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(p.iterations):
        chance = 1 / (1 + np.exp(-score))
        g, h = chance - y, chance * (1 - chance)
        leaves = [np.ones(len(y), bool)]
        while len(leaves) < p.leaves:
            found = []
            for k, rows in enumerate(leaves):
                sums = np.zeros((bins.shape[1], BINS, 3))
                for f in range(bins.shape[1]):
                    for c, w in enumerate((g, h, np.ones(len(y)))):
                        sums[f, :, c] = np.bincount(bins[rows, f], w[rows], BINS)
                split = boosting.best_split(sums, coded, p)
                if split:
                    assert split.gain == pytest.approx(max(plain_gains(bins[rows], g[rows], h[rows], coded, p)), rel=1e-6)
                    found.append((split.gain, -k, split))
            if not found:
                break
            _, k, split = max(found, key=lambda x: x[:2])
            rows = leaves[-k]
            left = split.mask[bins[:, split.feature]]
            leaves[-k] = rows & left
            leaves.append(rows & ~left)
        for rows in leaves:
            score[rows] += -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
    return score


def test_against_plain_boosting(spark):
    df, data = rows_of(spark)
    model = boosting.fit(df.repartition(5), ("a", "b", "c"), ("kind",), "y", SMALL)
    columns = [np.array([np.nan if r[k] is None else r[k] for r in data]) for k in range(4)]
    bins = model.bins.binned(columns)
    assert (bins[:, 0] == MISSING).sum() == np.isnan(columns[0]).sum() and len(model.bins.edges[1]) == 5
    want = plain_fit(bins, np.array([r[4] for r in data]), model.bins.is_coded, SMALL)
    assert model.scores(bins) == pytest.approx(want, abs=1e-6)
    got = [r["margin"] for r in model.with_margin(df).collect()]
    assert sorted(got) == pytest.approx(sorted(want), abs=1e-6)
    used = {f for t in model.trees for f, left in zip(t.feature, t.left, strict=True) if left >= 0}
    assert {0, 3} <= used and all(len(t.value) <= 2 * SMALL.leaves - 1 for t in model.trees)


def test_the_same_trees_of_any_layout(spark, monkeypatch):
    df, _ = rows_of(spark)
    models = [boosting.fit(df.repartition(n), ("a", "b", "c"), ("kind",), "y", SMALL).as_dict() for n in (1, 7)]
    monkeypatch.setattr(tasks, "FEW", 2)
    monkeypatch.setattr(boosting, "FLUSH", 2)
    models.append(boosting.fit(df.repartition(9), ("a", "b", "c"), ("kind",), "y", SMALL).as_dict())
    assert models[0] == models[1]
    assert [t["mask"] for t in models[0]["trees"]] == [t["mask"] for t in models[2]["trees"]]
    again = boosting.Boosted.from_dict(models[0])
    assert again.as_dict() == models[0]


def test_unknown_codes_and_one_class(spark):
    df, _ = rows_of(spark)
    model = boosting.fit(df, ("a",), ("kind",), "y", SMALL)
    odd = spark.createDataFrame([(None, None, 0), (float("nan"), 999, 1), (1e300, -77, 1)], "a double, kind int, y int")
    found = [r["margin"] for r in model.with_margin(odd).collect()]
    assert found[0] == found[1] and np.isfinite(found).all()
    one = boosting.fit(df.withColumn("y", F.lit(1)), ("a",), ("kind",), "y", SMALL)
    assert one.trees == [] and one.with_margin(df).filter("margin > 0").count() == df.count()
    empty = boosting.fit(df.limit(0), ("a",), ("kind",), "y", SMALL)
    assert empty.trees == [] and empty.start == 0.0


def test_a_fit_has_few_tasks_however_the_rows_come(spark, monkeypatch):
    df, _ = rows_of(spark)
    seen = []
    plain = boosting.added_blocks
    monkeypatch.setattr(boosting, "added_blocks", lambda blocks, *more: seen.append(blocks.getNumPartitions()) or plain(blocks, *more))
    want = boosting.fit(df.repartition(60), ("a", "b", "c"), ("kind",), "y", SMALL).as_dict()
    assert set(seen) == {1}
    monkeypatch.setattr(boosting, "ROWS", 20)
    monkeypatch.setattr(tasks, "FEW", 2)
    seen.clear()
    assert boosting.fit(df.repartition(3), ("a", "b", "c"), ("kind",), "y", SMALL).as_dict() == want
    assert min(seen) > 2

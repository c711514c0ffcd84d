import math
import re

import numpy as np
import pytest

from tenura.llm import lexical_search, nearest, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, salt int, rank int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1, 2) for i, v in rows], VECTORS)


def floats(vectors):
    return [[float(np.float32(c)) for c in v] for v in vectors]


ODD = [(None, [1.0, 2.0, 3.0]), (91, None), (92, [1.0, None, 2.0]), (93, [1.0, math.nan, 2.0]), (94, [1.0, math.inf, 2.0]), (95, []), (96, [1.0]), (97, [0.0, 0.0, 0.0])]


def plain_whitening(kept):
    """x of the kept vectors, the different ones, their mean, and NumPy's eigenvalues of their covariance."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1], axes[:, ::-1]


def check_whitening(model, rows, kept):
    x, fit, values, axes = plain_whitening([v for _, v in kept])
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    assert model.centre.n == n and list(model.centre.sums) == sums
    k = len(model.eigenvalues)
    assert np.allclose(model.eigenvalues, values[:k], rtol=1e-9, atol=1e-9 * values[0])
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
    assert len(rows) == len(kept)
    for (i, _), own in zip(kept, x, strict=True):
        deviation = sum((n * int(c) - s) ** 2 for c, s in zip(own, sums, strict=True))
        match = [r for r in got[i] if int(r["deviation"]) == deviation]
        assert match
        for j in np.flatnonzero(model.usable):
            plain = (own - fit.mean(axis=0)) @ model.axes[:, j] / math.sqrt(values[j])
            assert any(abs(r["whitened"][j] - plain) < 1e-6 * max(1, abs(plain)) for r in match)
    for j in np.flatnonzero(model.usable):
        near = np.flatnonzero(np.abs(values - values[j]) < 1e-6 * values[0])  # an axis, up to its sign, or within those of equal eigenvalues
        assert np.linalg.norm(axes[:, near].T @ model.axes[:, j]) == pytest.approx(1, abs=1e-6)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    kept = [(i, v) for i, v in enumerate(floats(rng.normal(size=(200, 3)) * [1, 5, 0.2]))]
    kept += [(500 + i, kept[0][1]) for i in range(70)] + [(7, kept[7][1]), (None, [1.0, 2.0, 3.0]), (97, [0.0, 0.0, 0.0])]
    docs = table_of(spark, kept + [r for r in ODD if r[0] not in (None, 97)])
    model = whitening.fit(docs)
    check_whitening(model, whitening.whiten(docs, model).collect(), kept)
    assert model.identity_error < 1e-9 and sum(model.explained) == pytest.approx(1)


def test_whitening_hides_no_dependence(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-40, 40, size=(60, 2)) / 64
    kept = [(i, v) for i, v in enumerate(floats(np.column_stack((base, base[:, 0], np.full(60, 0.5)))))]
    docs = table_of(spark, kept)
    model = whitening.fit(docs)
    assert model.usable.tolist() == [True, True, False, False] and model.identity_error < 1e-9
    rows = whitening.whiten(docs, model).collect()
    assert all(r["whitened"][2] is None and r["whitened"][0] is not None for r in rows)
    check_whitening(model, rows, kept)


def test_whitening_of_few_and_huge(spark):
    assert whitening.fit(table_of(spark, [])) is None and whitening.fit(table_of(spark, [(1, None), (2, [])])) is None
    one = table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    model = whitening.fit(one)
    assert model.centre.n == 1 and model.identity_error is None and model.explained == [None, None]
    assert [(int(r["deviation"]), r["whitened"]) for r in whitening.whiten(one, model).collect()] == [(0, [None, None])] * 2
    big = [(i, [3e12 * (i + 1), 1e30 if i else -1e30, 0.25]) for i in range(3)]
    model = whitening.fit(table_of(spark, big))
    rows = {r["vec_id"]: r for r in whitening.whiten(table_of(spark, big), model).collect()}
    x = [[math.floor(min(max(64 * c, -4e18), 4e18)) + 1_000_000 for c in v] for v in floats([v for _, v in big])]
    sums = [sum(c) for c in zip(*x, strict=True)]
    wide = [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert [rows[i]["deviation"] for i in range(3)] == [None if w >= 10**38 else w for w in wide]


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    # graded by 12 orders of magnitude: small eigenvalues keep their digits
    scale = 10.0 ** -rng.uniform(0, 6, d)
    base = rng.normal(size=(4 * d, d))
    a = scale[:, None] * (base.T @ base) * scale
    values, axes = whitening.jacobi(a)
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12) and np.allclose(a @ axes, axes * values, atol=1e-12 * values[0])
    unscaled = np.linalg.eigvalsh(base.T @ base)
    assert (values > 0).all() and np.log(values).sum() == pytest.approx(np.log(unscaled).sum() + 2 * np.log(scale).sum(), abs=1e-8)
    if d == 2:
        trace, det = a[0, 0] + a[1, 1], a[0, 0] * a[1, 1] - a[0, 1] ** 2
        assert values[1] == pytest.approx(2 * det / (trace + math.sqrt(trace * trace - 4 * det)), rel=1e-10)


DOCS = "doc_id long, text string, item_id long, term string, n long, score long, salt int"
ITEMS = "item_id long, text string, doc_id long"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(_LOWER) for t in _TERM.findall(text or "")]


def plain_ranking(docs, items, k):
    """Every document scored for every item."""
    rows = [(i, plain_terms(t)) for i, t in docs]
    texts, length = sum(bool(w) for _, w in rows), sum(len(w) for _, w in rows)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in wanted.items():
        weights = {t: math.floor(1000 * math.log((2 * texts + 2) / (2 * sum(t in w for _, w in rows) + 1))) for t in terms}
        scores = []
        for i, words in rows:
            m = 50 + 50 * len(words) * texts // length if length else 0
            score = sum(weights[t] * (10**9 * words.count(t) // (1000 * words.count(t) + 20 * m)) for t in terms if t in words)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        scores.sort(key=lambda x: x[:3])
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return out


def check_ranking(spark, docs, items, k, **options):
    docs_frame = spark.createDataFrame([(i, t, 1, "clash", 2, 3, 4) for i, t in docs], DOCS).repartition(3)
    items_frame = spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS)
    got = [tuple(r) for r in lexical_search.ranked(docs_frame, items_frame, k, **options).collect()]
    assert sorted(got, key=str) == sorted(plain_ranking(docs, items, k), key=str)
    return got


@pytest.mark.parametrize("k,chunk", [(1, 500_000), (4, 500_000), (50, 9)])
def test_lexical_search_against_all_scores(spark, monkeypatch, k, chunk):
    monkeypatch.setattr(lexical_search, "STEP", 2)
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 7)
    rng = np.random.default_rng(k)
    words = [*(f"w{i}" for i in range(40)), "Été", "été", "Über", "日本", "x1", "Ⅷ"]
    share = 1 / np.arange(1, len(words) + 1)
    draw = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, draw(int(rng.integers(0, 30)))) for i in range(120)] + [(1000 + i, "w1 W2-w3 été") for i in range(30)]
    docs += [(5, "w1 w1"), (5, "w1 w1"), (None, "w1 w1"), (None, None), (2000, ""), (2001, "!? -"), (2002, "w0 " * 4000), (2003, "a\x00w1\x7fw2[w3`w4{w5")]
    items = [(i, draw(12)) for i in range(8)] + [(3, "w7 w8 w8"), (20, None), (21, "nowhere"), (22, "W1 w2 ÉTÉ"), (None, "w3 w1")]
    got = check_ranking(spark, docs, items, k, item_terms_at_once=chunk)
    assert got and not [r for r in got if r[0] in (20, 21)]


def test_lexical_search_of_nothing(spark):
    assert check_ranking(spark, [], [(1, "a")], 5) == [] and check_ranking(spark, [(1, "a")], [], 5) == []
    assert check_ranking(spark, [(1, None), (2, "-")], [(1, "a")], 5) == []
    assert check_ranking(spark, [(1, "a")], [(1, "a")], 5) == [(1, 1, 1, plain_ranking([(1, "a")], [(1, "a")], 5)[0][3])]


def test_the_threshold_ends_searches_early():
    """Of two lists in which the same few documents lead, the rest isn't read; a tie at the threshold is."""
    import pyarrow as pa

    n = 4000
    counts = [[50 - i, 50 - i] if i < 20 else [1, 1] for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([100] * n), pa.array([[0, 1]] * n, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])
    segment = lexical_search.Segment([batch], np.array([700, 900]), n, 100 * n)
    looked, scores = [], segment.scores
    segment.scores = lambda docs: looked.append(len(docs)) or scores(docs)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    best = segment.search(np.array([0, 1]), none, 10)
    assert best[1].tolist() == list(range(10)) and sum(looked) <= 48
    looked.clear()
    tied = segment.search(np.array([0, 1]), none, 30)
    assert tied[1].tolist() == list(range(30)) and sum(looked) == n  # all others tie with the 21st


def plain_nearest(rows, asked, k):
    """The k nearest different ids of each query id, by every distance."""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i in asked}):
        best = {}
        for _, own in [g for g in good if g[0] == q]:
            for i, v in good:
                if i != q:
                    best[i] = min(best.get(i, math.inf), float(np.sqrt(((v - own) ** 2).sum())))
        out[q] = [(i, d) for d, i in sorted((d, i) for i, d in best.items())[:k]]
    return out


def found_by(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("bytes_", [64 << 20, 24 * 20])
def test_nearest_edges(spark, bytes_):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(floats(rng.normal(size=(90, 3))))]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(3, rows[3][1]), (3, rows[50][1]), (10, rows[60][1])] + ODD
    vectors = table_of(spark, rows).repartition(3)
    got = found_by(nearest.nearest(vectors, vectors.filter("vec_id % 10 = 0"), bound_rows=60, query_bytes=bytes_))
    want = plain_nearest(rows, set(range(0, 300, 10)), 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        for i, d in found:
            assert dict(plain_nearest(rows, {q}, 1000)[q])[i] == d
    for q in (0, *range(200, 240, 10)):  # copies at distance 0, ties to the smaller id
        assert got[q] == want[q]


def test_nearest_of_few(spark):
    few = table_of(spark, [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [5.0, 1.0, 0.0])])
    got = found_by(nearest.nearest(few, few.filter("vec_id % 100 = 0")))
    assert [i for i, _ in got[0]] == [1, 2]
    for empty in (table_of(spark, []), table_of(spark, [(0, None), (100, [0.0])])):
        assert nearest.nearest(empty, empty.filter("vec_id % 100 = 0")).count() == 0
    alone = table_of(spark, [(0, [1.0, 0.0, 0.0])])
    assert nearest.nearest(alone, alone).count() == 0


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    hits = total = 0
    for q, found in found_by(nearest.op13_nearest(spark, folder)).items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits, total = hits + len(set(ids[np.lexsort((ids, d))[:10]]) & {i for i, _ in found}), total + 10
    assert total == 10 * (ids % 100 == 0).sum() and hits >= 0.95 * total


def test_a_row_at_the_radius_reaches_the_threshold():
    rng, needed = np.random.default_rng(9), nearest.threshold()
    along = nearest.directions(24)
    apart = rng.normal(size=(4000, 24))
    apart /= np.linalg.norm(apart, axis=1)[:, None]
    reached = (np.abs(apart @ along.T) <= nearest.HALF_WIDTH).sum(axis=1) >= needed
    far = (np.abs(2 * apart @ along.T) <= nearest.HALF_WIDTH).sum(axis=1) >= needed
    assert reached.mean() > 1 - 2 * nearest.MISS and far.mean() < 0.01

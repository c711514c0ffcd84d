import numpy as np

from tenura.llm import quality as q
from tests.llm.test_text_basics import ODD, frame


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.8
    accuracy = np.array([0.9, 0.85, 0.7, 0.75, 0.6, 0.8, 0.7, 0.65, 0.55])
    right = rng.random((20000, 9)) < accuracy
    cast = np.where(right == truth[:, None], 1, 0)
    cast[rng.random(cast.shape) < 0.2] = q.ABSTAIN
    codes = (cast * 3 ** np.arange(9)).sum(axis=1)
    kinds, n = np.unique(codes, return_counts=True)
    p = q.label_model(dict(zip(kinds.tolist(), n.tolist(), strict=True)))
    said = np.array([p[c] for c in codes]) > 0.5
    majority = (cast == 1).sum(axis=1) > (cast == 0).sum(axis=1)
    assert (said == truth).mean() > max(0.9, (majority == truth).mean())


def test_table_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in q.op7_quality(spark, sf).collect()}
    assert len(got) == 1000
    kept = np.array([got[i]["kept"] for i in truth])
    good = np.array(list(truth.values())) == 1
    assert kept[good].mean() > 0.99 and kept[~good].mean() < 0.1, (kept[good].mean(), kept[~good].mean())


def test_edges(spark):
    got = {r["doc_id"]: r for r in q.graded(frame(spark, ODD)).collect()}
    assert len(got) == len(ODD) and got[0]["score"] == got[1]["score"] == 0 and not got[0]["kept"]
    assert q.graded(frame(spark, [])).count() == 0


def plain_em(cast, rounds):
    """Expectation-maximisation document by document: p(good) of each."""
    p = [(sum(v == q.GOOD for v in d) + 1) / (sum(v != q.ABSTAIN for v in d) + 2) for d in cast]
    for _ in range(rounds):
        prior = min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
        rates = {}
        for label, mass in (("good", p), ("bad", [1 - x for x in p])):
            for k in range(len(cast[0])):
                said = [1 + sum(m for m, d in zip(mass, cast, strict=True) if d[k] == v) for v in (0, 1)]
                rates[label, k] = [x / sum(said) for x in said]
        new = []
        for d in cast:
            odds = np.log(prior) - np.log(1 - prior) + sum(np.log(rates["good", k][v]) - np.log(rates["bad", k][v]) for k, v in enumerate(d) if v != q.ABSTAIN)
            new.append(1 / (1 + np.exp(-min(max(odds, -30), 30))))
        p = new
    return p


def test_label_model_against_em_by_document():
    rng = np.random.default_rng(5)
    cast = [[int(x) for x in rng.choice([0, 1, 2], 9, p=[0.2, 0.6, 0.2] if k % 3 else [0.5, 0.3, 0.2])] for k in range(150)]
    codes = [sum(v * 3**k for k, v in enumerate(d)) for d in cast]
    counts = {c: codes.count(c) for c in codes}
    got = q.label_model(counts, 12)
    assert np.allclose([got[c] for c in codes], plain_em(cast, 12), atol=1e-9)


def test_scorer_against_a_plain_one():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["good", "words", "%%%", "a1", "A1", "A1", "end."], rng.integers(1, 40))) for _ in range(60)]
    target = rng.random(60)
    rows = [q.vector(t.split(), q.Memo(q.features, 10)) for t in texts]
    dense = np.zeros((60, q.FEATURES + 2))
    for k, t in enumerate(texts):
        tokens = t.split()
        for token in tokens:
            for f in q.features(token):
                dense[k, f] += 1 / len(tokens)
        dense[k, q.FEATURES] = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens)
    dense[:, -1] = 1
    share = target.mean()
    weight = target / share + (1 - target) / (1 - share)
    weight /= weight.sum()
    w, squares = np.zeros(q.FEATURES + 2), np.full(q.FEATURES + 2, 1e-8)
    decay = np.append(np.full(q.FEATURES + 1, q.DECAY), 0)
    for _ in range(q.STEPS):
        step = dense.T @ (weight * (1 / (1 + np.exp(-dense @ w)) - target)) + decay * w
        squares += step**2
        w -= q.RATE / 10 * step / np.sqrt(squares)
    got = q.fit_scorer(rows, target)
    assert np.allclose(got, w, atol=1e-5)
    grader = q.Grader(w)
    assert np.allclose([grader.score(t) for t in texts], 1 / (1 + np.exp(-dense @ w)), atol=1e-9)

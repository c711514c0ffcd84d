import random

import pytest

from tenura.llm import jaccard_join as jj
from tests.llm.test_text_basics import ODD, frame


def brute(rows):
    """doc -> (class, links) by comparing every two documents."""
    sets = [(i, frozenset(jj.shingles(t or "").tolist())) for i, t in rows]
    n = len(sets)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            x, y = sets[a][1], sets[b][1]
            if len(x & y) >= 0.8 * len(x | y) - 1e-9 and (x or not y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for k in range(n):
        low[find(k)] = min(low.get(find(k), sets[k][0]), sets[k][0])
    return {sets[k][0]: (low[find(k)], links[k]) for k in range(n)}


def near_copies(seed, groups, members, words=60):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(members):
            x = list(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(words)] = f"z{rng.randrange(5000)}"
            out.append(" ".join(x))
    return out


@pytest.mark.parametrize("small,block", [(24, 256), (3, 8)])
def test_against_every_pair(spark, small, block):
    texts = [*ODD, *near_copies(1, 3, 30), *near_copies(2, 20, 3), "one two", "one two", "One, two!"]
    docs = frame(spark, texts)
    rows = jj.joined(docs, small, block).collect()
    want = brute(list(enumerate(texts)))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == want
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == sorted({c for c, _ in want.values()})


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.op4_jaccard_join(spark, small).collect()} == want


def test_keep_one(spark):
    base = near_copies(3, 4, 5)
    docs = frame(spark, [*base, base[0], base[0], None, ""], [*range(20), 0, 0, 50, 51])
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    want = brute([(k, t) for k, t in enumerate(base)])
    assert ids == sorted({c for c, _ in want.values()} | {50})
    assert jj.keep_one(frame(spark, [])).count() == 0 and jj.similarity_join(frame(spark, [])).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    least = jj.least_matches()
    assert least[16] >= 3 and least[128] >= 70 and all(a <= b for a, b in zip(least, least[1:], strict=False))


def test_components_with_hubs(spark):
    from tenura.llm.graph import components

    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 900)] + [(k, k + 1) for k in range(2000, 2040)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(5000, 5000), (899, 2000)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}

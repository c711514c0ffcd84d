import random
import re
import tracemalloc

import numpy as np

from tenura.llm import decontaminate as dc
from tests.llm.test_text_basics import ODD, frame


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        assert dc.common_subsequence(a, b) == lcs(a, b)


def test_latent_space_is_that_of_numpy(spark):
    rng = np.random.default_rng(2)
    dense = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 30)) + 1e-6 * rng.standard_normal((60, 30))
    rows = [([*range(30)], [float(v) for v in r]) for r in dense]
    v = dc.latent_space(spark.createDataFrame(rows, "rows array<int>, weights array<double>"), 30, k=4)
    want = np.linalg.svd(dense)[2][:4].T
    assert np.allclose(v @ v.T, want @ want.T, atol=1e-3)


def test_sums_of_pairs_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(70, rng.integers(1, 20), replace=False).tolist()) for _ in range(300)]
    weights = [rng.standard_normal(len(r)).tolist() for r in rows]
    dense = np.zeros((300, 70))
    for k, (r, w) in enumerate(zip(rows, weights, strict=True)):
        dense[k, r] = w
    matrix = spark.createDataFrame(list(zip(rows, weights, strict=True)), "rows array<int>, weights array<double>").repartition(5)
    assert np.allclose(dc.gram(matrix, 70), dense.T @ dense)
    assert np.allclose(dc.gram(matrix.repartition(2 * dc.GRAM_TASKS + 3), 70), dense.T @ dense)
    assert np.allclose(dc.gathered(matrix, dense[:9].T.copy(), False), dense.T @ dense @ dense[:9].T)


def test_the_driver_holds_no_square_of_the_terms(spark):
    rng = np.random.default_rng(5)
    terms, q = 1500, rng.normal(size=(1500, 3))
    rows = [(sorted(rng.choice(terms, 40, replace=False).tolist()), rng.random(40).tolist()) for _ in range(80)]
    matrix = spark.createDataFrame(rows, "rows array<int>, weights array<double>").repartition(3)
    dense = np.zeros((len(rows), terms))
    for k, (r, w) in enumerate(rows):
        dense[k, r] = w
    blocks = dc.gram_blocks(matrix, terms)
    tracemalloc.start()
    got = dc.product(blocks, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, dense.T @ (dense @ q))
    assert peak < terms * terms * 8 / 4  # of one such square


def test_every_document_is_factored(spark):
    """The matrix has the windows of every document, however many there are, with the weights that tfidf gives."""
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(200))) for _ in range(5000)] + [None, "", "strange"]
    items = [" ".join(f"w{k}" for k in range(at, at + 20)) for at in (0, 20)]
    vocabulary, idf = dc.Vocabulary({w for t in items for w in dc.item_words(t)}), np.random.default_rng(1).random(40) + 0.1
    share = spark.sparkContext.broadcast
    got = dc.passages(spark.createDataFrame([(t,) for t in items], "text string"), frame(spark, texts), share(vocabulary), share(idf))
    plain = [dc.tfidf(vocabulary.terms(t or "")[at : at + 64], idf) for t in texts for at in range(0, len((t or "").split()), 64)]
    plain, own = [x for x in plain if len(x[0])], [dc.tfidf(vocabulary.terms(t)[at : at + 16], idf) for t in items for at in dc.beginnings(20)]
    scale = (len(plain) / len(own)) ** 0.5
    want = sorted((r.tolist(), np.round(w, 9).tolist()) for r, w in [*plain, *((r, w * scale) for r, w in own)])
    assert sorted((r["rows"], np.round(r["weights"], 9).tolist()) for r in got.collect()) == want


def test_table_against_verbatim_search(spark):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: " ".join(w.decode() for w in dc.item_words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = f" {' '.join(w.decode() for w in dc.item_words(r['text']))} "
        want[r["doc_id"]] = sorted(i for i, t in items.items() if f" {t} " in text)
    got = {r["doc_id"]: r for r in dc.op8_decontaminate(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert {i for i, x in want.items() if x} == {i for i, r in got.items() if r["contaminated"]}
    assert all(set(x) <= set(got[i]["items"]) for i, x in want.items())


def test_paraphrases_and_edges(spark):
    rng = random.Random(4)
    words = [f"term{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + ". " + " ".join(rng.choice(words) for _ in range(5)) + "." for _ in range(30)]
    filler = lambda n: " ".join(f"other{rng.randrange(3000)}" for _ in range(n))
    docs = []
    for t in texts[:20]:
        w = t.split()
        for _ in range(5):  # a seventh of the words changed
            w[rng.randrange(len(w) - 5)] = f"changed{rng.randrange(99)}"
        docs.append(f"{filler(rng.randrange(200))} {' '.join(w)} {filler(rng.randrange(200))}")
    clean = [filler(300) for _ in range(20)] + [" ".join(rng.choice(words) for _ in range(300)) for _ in range(10)]
    # a part of an item is a leak too, but a few words aren't
    half = [f"{filler(50)} {' '.join(t.split()[:22])} {filler(50)}" for t in texts[20:25]]
    few = [f"{filler(50)} {' '.join(t.split()[:6])} {filler(50)}" for t in texts[25:]]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(90, None), (91, "")], "item_id long, text string")
    data = frame(spark, [*docs, *half, *clean, *few, *ODD]).withColumnRenamed("source", "items")
    got = {r["doc_id"]: r for r in dc.contaminated(data, bench).collect()}
    assert all(got[k]["contaminated"] and k in got[k]["items"] for k in range(20))
    assert all(got[k]["items"] == [k] for k in range(20, 25))
    assert not any(got[k]["contaminated"] for k in range(25, len(got)))
    assert dc.contaminated(frame(spark, []), bench).count() == 0
    assert dc.contaminated(data, bench.limit(0)).filter("contaminated").count() == 0


def test_verbatim_copies_of_many_and_of_long_items(spark):
    rng = random.Random(6)
    words = [f"term{k}" for k in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    # far more items than latent dimensions, and items far longer than a window
    texts = [some(rng.randrange(15, 60)) for _ in range(2000)] + [some(n) for n in (440, 700, 1500)]
    held = [*rng.sample(range(2000), 60), 2000, 2001, 2002]
    docs = [f"{some(rng.randrange(300))} {texts[i]} {some(rng.randrange(300))}" for i in held] + [some(400) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {r["doc_id"]: r for r in dc.contaminated(frame(spark, docs), bench).collect()}
    assert all(i in got[k]["items"] for k, i in enumerate(held))
    assert not any(got[k]["contaminated"] for k in range(len(held), len(docs)))


def searcher_of(items, seed, dimensions):
    vocabulary = dc.Vocabulary({w for _, t in items for w in dc.item_words(t)})
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((vocabulary.size, min(dimensions, vocabulary.size))))[0]
    return dc.Searcher(items, vocabulary, 0.1 + rng.random(vocabulary.size), space.astype(np.float32))


def test_stretches_against_sums_of_weights():
    rng = random.Random(7)
    items = [(k, " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 25)))) for k in range(30)]
    searcher = searcher_of(items, 8, 4)
    of = {k: {int(w) for w in range(len(searcher.rare_counts)) for at in range(searcher.rare_counts[w]) if searcher.rare_items[searcher.rare_begins[w] + at] == k} for k in range(30)}
    texts = [searcher.vocabulary.numbered(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(60)))) for _ in range(40)]
    first = np.cumsum([0, *map(len, texts)])
    got = {(int(b), int(i)) for b, _, i in zip(*searcher.stretches(np.concatenate(texts), first), strict=True)}
    want = set()
    for t, begin in zip(texts, first, strict=False):
        for k, rare in of.items():
            for at in range(len(t)):
                if t[at] in rare and sum(searcher.weights[w] for w in t[at : at + searcher.reach[k]] if w in rare) >= searcher.mass[k] - 1e-6:
                    want.add((int(begin) + at, k))
    assert got == want


def test_windows_are_sums_of_term_vectors():
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(n))) for k, n in enumerate((1, 2, 3, 6, 12, 16, 17, 40, 90))]
    searcher = searcher_of(items, 4, 20)
    texts = [" ".join([*(f"w{rng.randrange(400)}" for _ in range(30)), t]) for _, t in items]
    numbers = [searcher.vocabulary.numbered(t) for t in texts]
    first, words = np.cumsum([0, *map(len, numbers)]), np.concatenate(numbers)
    seen = 0
    for length, places, vectors in searcher.windows(words, first):
        for at, v in zip(places, vectors, strict=True):
            end = min(at + length, first[np.searchsorted(first, at, side="right")])
            own = words[at:end]
            assert np.allclose(v, searcher.term_vectors[searcher.vocabulary.rows[own]].sum(axis=0), atol=1e-4)
            seen += 1
    assert seen and all(any(i == k for i, _ in found) for k, found in enumerate(searcher.search(texts)))


def test_longest_run():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(15))] for _ in range(2))
        want = max((n for n in range(16) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        assert dc.longest_run(a, b) == want


def test_in_place_against_every_shift():
    rng = random.Random(13)
    for trial in range(300):
        n = rng.choice([3, 12, 25])
        item = [rng.randrange(n) for _ in range(n)]
        region = [rng.choice([-1, *range(n)]) for _ in range(rng.randrange(2 * n))]
        if trial % 2:
            region += [v if rng.random() < 0.7 else -1 for v in item] + region[:3]
        weights = [rng.random() for _ in range(n)] + [0.0]
        best = 0.0
        for shift in range(-n, len(region) + n):
            pairs = [(i, j) for i, v in enumerate(item) for j, w in enumerate(region) if v == w and shift <= j - i <= shift + 4]
            own, other = {i for i, _ in pairs}, {j for _, j in pairs}
            if min(len(own), len(other)) >= dc.SHORT:
                best = max(best, min(sum(weights[item[i]] for i in own), sum(weights[region[j]] for j in other)))
        best /= sum(weights[v] for v in item)
        got = dc.in_place(np.array(item), np.array(region, np.int32), np.array(weights))
        assert abs(got - (best if best >= dc.PLACED else 0.0)) < 1e-9, trial


def planted_kinds(rng, foreign):
    def replaced(words, share):
        return [foreign(rng) if rng.random() < share else w for w in words]

    cut = lambda a, b: lambda t: t.split()[int(a * len(t.split())) : int(b * len(t.split()))]
    return {
        "whole": str.split, "upper case": lambda t: t.upper().split(),
        "a tenth replaced": lambda t: replaced(t.split(), 0.1), "a fifth replaced": lambda t: replaced(t.split(), 0.2),
        "a fifth left out": lambda t: [w for w in t.split() if rng.random() > 0.2],
        "first three quarters": cut(0, 0.75), "middle": cut(0.2, 0.8), "first half": cut(0, 0.5), "second half": cut(0.5, 1),
        "three tenths replaced": lambda t: replaced(t.split(), 0.3), "two fifths replaced": lambda t: replaced(t.split(), 0.4),
        "neighbours swapped": lambda t: [w for k in range(0, len(t.split()), 2) for w in t.split()[k : k + 2][::-1]],
        "13 words": lambda t: t.split()[:13], "sentences reversed": lambda t: " ".join(re.split(r"(?<=[.!?])\s+", t)[::-1]).split(),
    }


def test_recall_of_parts_and_edits(spark):
    """Items of the table planted in other documents by kind: 0.9 of each kind found, 0.99 of the others left alone."""
    rng, sf = random.Random(11), "/root/testdata/sf0.1"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(3000).collect() if r["text"]]
    held = {r["doc_id"] for r in dc.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).filter("contaminated").collect()}
    plain = [f" {' '.join(w.decode() for w in dc.item_words(t))} " for t in texts]
    verbatim = {k for k, t in enumerate(plain) if any(f" {' '.join(w.decode() for w in dc.item_words(i))} " in t for _, i in items)}
    assert verbatim <= held and len(held - verbatim) <= 0.01 * len(texts)
    fill = [t for k, t in enumerate(texts) if k not in held and 400 < len(t) < 3000]
    rows = []
    for kind, change in planted_kinds(rng, lambda r: r.choice(r.choice(fill).split())).items():
        for i, t in rng.sample(items, 60):
            words = rng.choice(fill).split()
            at = rng.randrange(len(words))
            rows.append((kind, i, " ".join([*words[:at], *change(t), *words[at:]])))
    docs = frame(spark, [t for _, _, t in rows] + fill)
    got = {r["doc_id"]: r["items"] for r in dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    shares: dict = {}
    for k, (kind, i, _) in enumerate(rows):
        shares.setdefault(kind, []).append(i in got[k])
    assert {kind: sum(s) / len(s) for kind, s in shares.items() if sum(s) < 0.9 * len(s)} == {}


def test_several_blocks_find_what_one_does(spark):
    rng = random.Random(12)
    some = lambda n: " ".join(f"term{rng.randrange(2000)}" for _ in range(n))
    texts = [some(rng.randrange(3, 50)) for _ in range(40)] + [None, ""]
    docs = frame(spark, [f"{some(40)} {t} {some(40)}" for t in texts[:20] if t] + [some(50), None, "", f"{texts[0]} {texts[30]}"] * 2).withColumnRenamed("source", "digest_1")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    one, many = (sorted(map(tuple, dc.contaminated(docs, bench, size).select("doc_id", "items", "contaminated").collect())) for size in (1000, 10))
    assert one == many and sum(r[2] for r in one) >= 22


def test_verbatim_items_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    items = {r["item_id"]: " ".join(w.decode() for w in dc.item_words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r["doc_id"]: set(r["items"]) for r in dc.op8_decontaminate(spark, sf).filter("contaminated").collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").toLocalIterator():
        text = f" {' '.join(w.decode() for w in dc.item_words(r['text']))} "
        assert {i for i, t in items.items() if f" {t} " in text} <= got.get(r["doc_id"], set())


def test_documents_are_cut_into_words_once_for_the_fit(spark):
    """One pass counts terms by document and by window, and what it stores gives the document frequencies; beyond it only the search reads texts."""
    rng = random.Random(15)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(200))) for _ in range(1500)] + [None, "", "strange"]
    items = [" ".join(f"w{k}" for k in range(at, at + 20)) for at in (0, 20)]
    marks = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            marks.add(batch.num_rows)
            yield batch

    docs = frame(spark, texts).select("text").mapInArrow(seen, "text string")
    vocabulary, idf, space = dc.fit(docs, spark.createDataFrame([(t,) for t in items], "text string"))
    assert marks.value == len(texts)
    held = [{*vocabulary.terms(t or "").tolist()} - {-1} for t in texts]
    want = [sum(k in x for x in held) for k in range(vocabulary.size)]
    assert np.allclose(idf, np.log((len(texts) + 1.0) / (np.array(want) + 1.0)) + 1e-3)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)


def test_sums_of_stored_counts_are_those_of_their_weights(spark):
    """Beyond GRAM_TERMS and below: the sums over counts that are weighed where they are read, and over the weights as a whole, are the same."""
    rng = random.Random(16)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(300))) for _ in range(200)]
    items = spark.createDataFrame([(" ".join(f"w{k}" for k in range(at, at + 20)),) for at in (0, 20)], "text string")
    share, docs = spark.sparkContext.broadcast, frame(spark, texts)
    vocabulary = share(dc.Vocabulary({f"w{k}".encode() for k in range(40)}))
    idf = share(np.random.default_rng(4).random(40) + 0.1)
    matrix, cells = dc.weighing(dc.counted(items, docs, vocabulary), idf)
    dense = np.zeros((40, 40))
    for r in dc.passages(items, docs, vocabulary, idf).collect():
        dense[np.ix_(r["rows"], r["rows"])] += np.outer(r["weights"], r["weights"])
    q = np.random.default_rng(5).normal(size=(40, 3))
    assert np.allclose(dc.product(dc.gram_blocks(matrix, 40, cells), q), dense @ q)
    assert np.allclose(dc.gathered(matrix, q, False, cells), dense @ q)
    assert np.allclose(dc.gathered(matrix, q, True, cells), q.T @ dense @ q)


def test_a_task_holds_half_a_square_of_the_terms():
    """The whole square, and a million pairs at a time, took the pipeline over an executor's memory."""
    rng = np.random.default_rng(6)
    terms = 1500
    rows = [np.sort(rng.choice(terms, 60, replace=False)).astype(np.int32) for _ in range(1000)]
    weights = rng.random((1000, 60))
    dense = np.zeros((1000, terms))
    np.put_along_axis(dense, np.array(rows, np.int64), weights, axis=1)
    tracemalloc.start()
    sums = dc.PairSums(terms)
    sums.add(np.concatenate(rows), weights.ravel(), np.full(1000, 60))
    got = np.zeros((-(-terms // dc.GRAM_ROWS), dc.GRAM_ROWS * terms))
    peak = tracemalloc.get_traced_memory()[1] - got.nbytes
    tracemalloc.stop()
    for block, cells, values in sums.blocks():
        got[block, cells] = values
    assert np.allclose(got.reshape(-1, terms)[:terms], np.triu(dense.T @ dense))
    assert peak < terms * terms * 8

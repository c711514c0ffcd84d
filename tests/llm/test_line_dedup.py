import random

import numpy as np

from tenura.llm import line_dedup as ld
from tests.llm.test_text_basics import ODD, frame


def words(line):
    return len(line.strip(" \t\r").split(" ")) if line.strip(" \t\r") else 0


def brute(docs, least=ld.MIN_WORDS):
    """doc_id -> lines in runs of at least so many words that an earlier document has too."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = [x.strip(" \t\r") for x in (text or "").split("\n")]
        gone, mine = set(), set()
        for b in range(len(lines)):
            total = 0
            for e in range(b, len(lines)):
                total += words(lines[e])
                if total >= least and lines[b] and lines[e]:
                    mine.add(tuple(lines[b : e + 1]))
                    if tuple(lines[b : e + 1]) in seen:
                        gone |= set(range(b, e + 1))
        seen |= mine
        out[i] = sorted(gone)
    return out


def test_patience_matches_in_order():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        m = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert ld.patience(list("xabcy"), list("zabcw")) == [(1, 1), (2, 2), (3, 3)]


def test_common_lines_of_a_pair():
    make = lambda x: ld.Lines(np.array(x, dtype=np.int64), np.full(len(x), 10, dtype=np.int32))
    assert ld.common_lines(make([1, 2, 3]), make([9, 2, 3, 8])).tolist() == [1, 2]
    assert ld.common_lines(make([1, 2, 3]), make([9, 2, 8, 3])).tolist() == []
    assert ld.common_lines(make([1, 2, 3, 4]), make([3, 4, 1, 2])).tolist() == [0, 1, 2, 3]


def test_against_brute_force(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 14))) + f" {k}" for k in range(60)]
    passage = "\n".join(f"passage line {k} with several words in it" for k in range(8))
    texts = []
    for k in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"own {k} {j} " + "w " * rng.randrange(9) for j in range(rng.randrange(1, 12))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines)), passage)
        texts.append("\n".join(lines))
    texts += [texts[0]] * 40 + [texts[3] + "\nmore"] * 3
    docs = frame(spark, texts)
    want = brute(list(enumerate(texts)))
    for rare in (2, 16):
        got = {r["doc_id"]: r for r in ld.dedup_lines(docs, rare=rare).collect()}
        assert {i: r["removed_lines"] for i, r in got.items()} == want
        for i, r in got.items():
            assert r["text"] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want[i])


def test_edges_and_table(spark, small):
    docs = frame(spark, [*ODD, None, "x", "x"], [*range(len(ODD)), 70, 71, 71]).withColumnRenamed("source", "n_lines")
    out = ld.dedup_lines(docs)
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] < len(ODD)} == dict(enumerate(ODD))
    assert ld.dedup_lines(frame(spark, [])).count() == 0
    table = spark.read.parquet(f"{small}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in table.collect()])
    assert {r["doc_id"]: r["removed_lines"] for r in ld.op1_line_dedup(spark, small).collect()} == want


def test_own_columns_and_spaceless_scripts(spark):
    docs = frame(spark, ["a", "b"]).withColumnRenamed("source", "line_row").withColumnRenamed("digest", "removed")
    out = ld.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "removed_lines"]
    assert {(r["line_row"], r["removed"]) for r in out.collect()} == {("s", "clash")}
    passage = "これは二つの文書にある長い段落です。同じ文がもう一度出てくるので、後の文書から消えます。短くはありません。"
    got = {r["doc_id"]: r["removed_lines"] for r in ld.dedup_lines(frame(spark, [f"一\n{passage}", f"二\n{passage}\n三", "短い行\n二"])).collect()}
    assert got == {0: [], 1: [1], 2: []}


def test_a_document_of_very_many_lines_and_a_window_that_all_hold(spark):
    passage = " ".join(f"word{k}" for k in range(25))
    long = "\n".join([f"line {k} of a long document" for k in range(8_000)])
    texts = [f"{passage}\n{long}", *(f"own {k}\n{passage}" for k in range(400)), f"x\n{long}"]
    got = {r["doc_id"]: r["removed_lines"] for r in ld.dedup_lines(frame(spark, texts)).collect()}
    assert got[0] == [] and all(got[k] == [1] for k in range(1, 401))
    assert got[401] == list(range(1, 8_001))


def test_one_document_of_very_many_sources_and_one_source_of_very_many(spark):
    quote = lambda k: "\n\n".join(f"source {k} says in its line {j} what others quote" for j in range(4))
    texts = [f"own {k}\n{quote(k)}" for k in range(600)]
    texts += ["\n".join(f"between\n{quote(k)}" for k in range(600))]
    texts += [f"{quote(k)}\n\nother words {k}" for k in range(0, 600, 2)] + [f"{quote(k)}\n{quote(k + 1)}" for k in range(0, 600, 3)]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["removed_lines"] for r in ld.dedup_lines(docs).collect()}
    want = {k: [] for k in range(600)} | {600: [x for x in range(4_800) if x % 8]}
    assert got == want | {k: list(range(7)) for k in range(601, 901)} | {k: list(range(14)) for k in range(901, 1_101)}
    # what moves to the tasks is in proportion to the lines, though one document has 600 pairs as the later and 500 as the earlier one
    rows = ld.stored(ld.sequences(docs.select(ld.F.monotonically_increasing_id().alias("line_row"), "doc_id", "text")))
    moved = ld.gathered(rows, ld.pairs_of(ld.keys_of(rows))).select(ld.F.sum(ld.F.size("hashes"))).first()[0]
    parts = 1 / ld.HOT_SHARE
    longest = texts[600].count("\n") + 1
    assert moved < 3 * sum(x.count("\n") + 1 for x in texts) + parts * longest

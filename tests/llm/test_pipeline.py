import re
import zlib

import pytest

from tenura.llm import language, tokens
from tests.llm.test_jaccard_join import brute as near_groups
from tests.llm.test_text_basics import ODD, frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_run_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rejected = {r["doc_id"] for r in language.identify(docs, language.fit(docs)).filter("rejected").collect()}
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in rejected}
    last = {}
    for i in sorted(left):
        last[left[i].translate(LOWER)] = i
    left = {i: left[i] for i in last.values()}
    near = near_groups(sorted(left.items()))
    left = {i: left[i] for i in {c for c, _ in near.values()}}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(f" {x} " in f" {plain(t)} " for x in items)}
    tok = tokens.tokenizer(tokens.vocabulary(corpus_pipeline.TOKENIZER))
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in left.items()}
    got: dict = {}
    for r in corpus_pipeline.run(spark, small).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) == r["ids_crc32"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(x) for i, x in want.items()}


def test_stages_keep_the_columns(spark, small):
    docs = frame(spark, [*ODD, "an ordinary English text of some words " * 4], range(len(ODD) + 1)).drop("digest")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, small)
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() <= table.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0

import hashlib
import zlib

import numpy as np
import pytest

from tenura.llm import exact_dedup, language, packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = ["", None, "A b", "a B", "a b", "Éa", "éa", "É A", "x  y\n\n z", "<|endoftext|> a<|endoftext|>", "日本語 テキスト", "a\x1cb\x85c", "word " * 9000, "a" * 70000, "ß ﬁ Σας"]


def test_exact_dedup(spark):
    docs = frame(spark, [*ODD, "dup", "DUP", "dup"], [*range(len(ODD)), 70, 71, 71])
    got = {(r["doc_id"], r["text_sha256"], r["kept"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], hashlib.sha256((r["text"] or "").translate(low).encode()).hexdigest()) for r in docs.collect()]
    assert len(got) == len(rows) or len(set(rows)) < len(rows)
    for i, h in set(rows):
        same = [a for a, b in rows if b == h]
        mine = [g for g in got if g[:2] == (i, h)]
        assert all(g[3:] == (max(same), len(same)) for g in mine)
    assert sum(r["kept"] for r in exact_dedup.exact_dedup(docs).collect()) == len({h for _, h in rows})
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns and kept.count() == len({h for _, h in rows})


def test_digest_index_appends(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "digests_test", str(tmp_path))
    index.ingest(frame(spark, ["one", "two", "Two"]))
    rows, _ = index.ingest(frame(spark, ["TWO", "three", "three"], [10, 11, 12]))
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in rows.collect()}
    assert got == {10: (2, False, 2), 11: (12, False, 2), 12: (12, True, 2)}
    assert index.read().count() == 3
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_the_index_outlives_its_session(spark, tmp_path):
    root = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, "digests_lasting", root)
    first.ingest(frame(spark, ["one", "two"], [1, 2]), "a")
    first.ingest(frame(spark, ["TWO", "three"], [3, 4]), "b")
    spark.sql("DROP TABLE digests_lasting")  # as a catalog that knows nothing of it; its files stay
    second = exact_dedup.DigestIndex(spark, "digests_lasting", root)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in second.ingest(frame(spark, ["ONE", "four"], [5, 6]), "c")[0].collect()}
    assert got == {5: (1, False), 6: (6, True)} and second.read().count() == 4
    rows = sorted(map(tuple, second.read().collect()))
    second.compact()
    assert sorted(map(tuple, second.read().collect())) == rows and len(second._generations()) == 1 and second.buckets() == 8
    files = [f for f in second.read().inputFiles()]
    assert len(files) == len({f.rsplit("_", 1)[1] for f in files})
    spark.conf.set(exact_dedup.DigestIndex.OUTPUT_ORDER, "true")
    groups = exact_dedup.stored(frame(spark, ["one", "nine"], [8, 9]).select(exact_dedup.digest_of().alias("digest"), "doc_id"))
    plan = second.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(exact_dedup.DigestIndex.OUTPUT_ORDER)
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    assert second.ingest(frame(spark, ["nine", "Four"], [9, 10]), "d")[0].filter("kept").count() == 1
    second.drop()
    assert second._generations() == []


def test_a_batch_may_come_again_after_a_failure(spark, monkeypatch, tmp_path):
    first, second = frame(spark, ["old", "two"], [1, 2]), frame(spark, ["OLD", "new", "New", None, "x", "x"], [3, 4, 5, None, 7, 7])
    want = exact_dedup.DigestIndex(spark, "digests_whole", str(tmp_path))
    want.ingest(first, "a")
    want_rows = sorted(want.ingest(second, "b")[0].collect(), key=str)
    index = exact_dedup.DigestIndex(spark, "digests_broken", str(tmp_path))
    index.ingest(first, "a")
    append, calls = exact_dedup.DigestIndex.append, []

    def fails_behind_the_second(self, groups, batch):
        append(self, groups, batch)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "append", fails_behind_the_second)
    with pytest.raises(RuntimeError):
        index.ingest(second, "b")
    for _ in range(2):  # once more after it went well, too
        assert sorted(index.ingest(second, "b")[0].collect(), key=str) == want_rows
    assert sorted(index.read().select("digest", "keep_id").collect()) == sorted(want.read().select("digest", "keep_id").collect())
    # under another name all of its texts are known
    assert index.ingest(second, "c")[0].filter("kept").count() == 0


def test_earlier_runs_decide_by_the_index(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = frame(spark, [f"text {x}" for x in rng.integers(0, 60, 300)], rng.permutation(300).tolist())
    seen, unseen = [], exact_dedup.DigestIndex.unseen
    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", lambda self, groups: seen.append((groups.count(), unseen(self, groups).count())) or unseen(self, groups))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()}
    want = {}
    for r in docs.collect():
        want.setdefault(r["text"], []).append(r["doc_id"])
    assert got == {i: max(ids) for ids in want.values() for i in ids}
    assert len(seen) == exact_dedup.RUNS and any(new < groups for groups, new in seen[1:])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_token_counts(spark):
    path = tokens.vocabulary("word_bpe_49k.json")
    tok = tokens.tokenizer(path)
    docs = frame(spark, ODD)
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, path).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["n_tokens"] == len(tok.encode(t or "", add_special_tokens=False).ids), repr(t)[:50]
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 2048)
    assert tokens.token_counts(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(200, 8), (300, 40), (5000, 64)])
def test_overlap_resynchronisation(spark, small, chunk, overlap):
    tok = tokens.tokenizer(tokens.vocabulary("word_bpe_49k.json"))
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    texts += ["ab cd " * 500, "x" * 3000, "x" * 700 + " " + "words here " * 100, " ".join(texts)[:30000], "ééé" * 400 + " a b c"]
    for t in texts:
        assert tokens.count_huge(tok, t, chunk, overlap) == len(tok.encode(t, add_special_tokens=False).ids)


def test_token_counts_of_the_table(spark, small):
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r["doc_id"]: len(tokens.tokenizer(path).encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.op5_token_counts(spark, small).collect()} == want


def check_packing(rows, docs, tok):
    ids = {d["doc_id"]: np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4") for d in docs}
    seen, filled = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(seen) == set(ids)
    for parts in (*seen.values(), *filled.values()):
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
    assert all(sum(n for _, n in x) <= 1024 for x in filled.values())
    return sum(map(len, ids.values())) / (1024 * len(filled))


def test_packing(spark, small):
    path = packing.vocabulary("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    share = check_packing(packing.op3_packing(spark, small).collect(), docs.collect(), tokens.tokenizer(path))
    assert share > 0.98
    odd = frame(spark, ODD)
    check_packing(packing.pack(odd, path).collect(), odd.collect(), tokens.tokenizer(path))
    check_packing(packing.pack(docs, path, bucket_pieces=50).collect(), docs.collect(), tokens.tokenizer(path))
    assert packing.pack(frame(spark, []), path).count() == 0


def test_ranks_are_those_of_the_rank_file():
    import base64

    path = packing.vocabulary("byte_bpe_50k.tiktoken")
    want = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    assert packing.ranks_of(packing.vocabulary("byte_bpe_50k.json")) == want


def test_best_fit_takes_the_tightest():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 33, 400))[::-1]
    to, offset = packing.best_fit(lengths, 32)
    rooms: list[int] = []
    for k, n in enumerate(lengths):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert 32 - offset[k] == min(fits)
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            assert offset[k] == 0
            rooms.append(32 - n)


def test_language(spark):
    got = language.op6_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.99
    assert not any(r["rejected"] for r in got if r["lang_pred"] != "und")
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    docs = frame(spark, ["the cat sat on the mat " * 9] * 30 + ODD)
    models = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, models).collect()}
    assert got[30]["lang_pred"] == got[31]["lang_pred"] == "und" and got[0]["lang_pred"] == "en"
    assert got[31]["rejected"] and got[31]["score"] == 0
    numbers = language.identify(frame(spark, ["½ ② Ⅷ ²", "12 ¾ _", "٣"]), models).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in numbers)
    assert language.cleaned("½a²b") == " a b " and language.cleaned("É2") == " é " and language.cleaned("一二") == " 一二 "
    foreign = frame(spark, ["ψηφίδα κόσμου ξένη γλώσσα " * 20])
    assert language.identify(foreign, models).collect()[0]["rejected"]
    assert language.fit(frame(spark, [])) is None
    assert language.identify(docs, None).filter("lang_pred = 'und'").count() == docs.count()


def plain_kneser_ney(counts, order):
    """p(character | up to order - 1 characters before it) by the textbook recursion, in dictionaries."""
    letters = {g for g in counts if len(g) == 1}

    def count(g):
        if len(g) == order or g[0] == " " and len(g) > 1:
            return counts.get(g, 0)
        return sum(1 for x in counts if len(x) == len(g) + 1 and x[1:] == g)

    table = {g: count(g) for g in counts}
    discounts = {}
    for n in range(1, order + 1):
        of = [v for g, v in table.items() if len(g) == n]
        once, twice = of.count(1), of.count(2)
        discounts[n] = once / (once + 2 * twice) if once else 0.5

    def p(c, h, n):
        if n == 0:
            return 1 / (len(letters) + 1)
        context = h[len(h) - n + 1 :]
        after = {g: v for g, v in table.items() if len(g) == n and g[:-1] == context and v}
        lower = p(c, h, n - 1)
        if not after:
            return lower
        total, d = sum(after.values()), discounts[n]
        return max(after.get(context + c, 0) - d, 0) / total + d * len(after) / total * lower

    return lambda word, i: p(word[i], word[:i], min(order, i + 1)), letters


def grams_of(words, order):
    counts: dict = {}
    for w in words:
        for i in range(1, len(w)):
            for n in range(1, min(order, i + 1) + 1):
                counts[w[i - n + 1 : i + 1]] = counts.get(w[i - n + 1 : i + 1], 0) + 1
    return counts


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_against_the_textbook(order):
    rng = np.random.default_rng(3)
    words = [" abra ", " cadabra ", " ab ", " bad ", *(f" {''.join(rng.choice(list('abcdr'), rng.integers(1, 9)))} " for _ in range(40))]
    counts = grams_of(words, order)
    plain, letters = plain_kneser_ney(counts, order)
    own = language.kneser_ney({"en": counts}, order)
    for w in [*words, " zebra ", " aabbccdd "]:
        sums, n = own.log_probabilities([w])
        assert n[0] == len(w) - 1
        assert abs(sums[0, 0] - sum(np.log(plain(w, i)) for i in range(1, len(w)))) < 1e-3
    for prefix in (" ", " a", " ab", " cad", " zz", " abracad"):
        known = sum(plain(prefix + c, len(prefix)) for c in [*letters, "~"])
        mine = [np.exp(own.log_probabilities([prefix + c])[0][0, 0] - own.log_probabilities([prefix])[0][0, 0]) for c in [*letters, "~"]]
        assert abs(known - 1) < 1e-6 and abs(sum(mine) - 1) < 1e-4


def test_long_words_are_scored_as_whole_ones():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdr"), 3000))
    models = language.kneser_ney({"en": grams_of([f" {text[:800]} "], 5), "de": grams_of([f" {text[900:1500]} "], 5)})
    sums, n = models.log_probabilities([language.cleaned(text)])
    got, k = language.Scorer(models).scored_whole(text)
    assert k == n[0] and np.allclose(got, sums[0], rtol=1e-5)
    x, counted = language.Scorer(models).cross_entropies([f"ab {text} cd", "ab", ""])
    assert counted.tolist() == [len(text) + 1 + 6, 3, 0]

import gzip
import hashlib
import os

import pytest

from tenura.operators import bytescan


@pytest.mark.parametrize("chunk", [1 << 22, 64])
def test_scan(spark, tmp_path, chunk):
    tokens = [hashlib.sha256(str(k).encode()).digest()[:12] for k in range(500)]
    relation = spark.createDataFrame([(t,) for t in tokens] * 2 + [(None,)], "subscriber_token binary")
    bundle = tmp_path / "bundle"
    (bundle / "deep").mkdir(parents=True)
    (bundle / "clean.json").write_text('{"engendered": 1, "digest": "' + hashlib.sha256(b"x").hexdigest() + '", "random": "' + os.urandom(12).hex() + '"}')
    (bundle / "name.csv").write_text("city,gender\n" + "x" * 100 + "\n")
    (bundle / "words.txt").write_text("engender genders _gender gender_ " * 40)
    (bundle / "words.gz").write_bytes(gzip.compress(b"engender genders _gender gender_ " * 40))
    (bundle / "upper.txt").write_text("." * 60 + tokens[3].hex().upper() + "." * 60)
    (bundle / "inside.txt").write_text("ab" + tokens[4].hex() + "ff")
    (bundle / "raw.bin").write_bytes(os.urandom(59) + tokens[5] + os.urandom(200) + tokens[5])
    (bundle / "deep/packed.gz").write_bytes(gzip.compress(b"-" * 5000 + tokens[6].hex().encode()) + gzip.compress(b" gender " + tokens[7]))
    (bundle / "deep/not.gz").write_bytes(b"\x1f\x8b broken " + tokens[8])
    (bundle / "empty").write_bytes(b"")
    spark.createDataFrame([(tokens[9],)], "t binary").coalesce(1).write.option("compression", "none").parquet(str(bundle / "table"))
    got = {(os.path.basename(os.path.dirname(r["path"])) if "table" in r["path"] else os.path.basename(r["path"]), r["kind"], r["found"]) for r in bytescan.scanned(spark, str(bundle), frozenset({"gender", "msno"}), relation, chunk).collect()}
    want = {("name.csv", "name", "gender"), ("packed.gz", "name", "gender")}
    want |= {(f, "token", tokens[k].hex()) for f, k in (("upper.txt", 3), ("inside.txt", 4), ("raw.bin", 5), ("packed.gz", 6), ("packed.gz", 7), ("not.gz", 8), ("table", 9))}
    assert got == want


def test_filter_keeps_all_and_few_others(spark):
    tokens = [hashlib.sha256(str(k).encode()).digest()[:12] for k in range(3000)]
    known = bytescan.filter_of(spark.createDataFrame([(t,) for t in tokens], "subscriber_token binary").repartition(5))
    assert set(bytescan.candidates(b"".join(tokens), known)) >= set(tokens)
    noise = os.urandom(300_000)
    assert len(bytescan.candidates(noise, known)) < 0.01 * len(noise)


def test_chunks_of_gzip_overlap():
    text = bytes(range(256)) * 300
    parts = list(bytescan.unpacked(gzip.compress(text), 23, 1000))
    assert parts[0][0] + b"".join(p[24:] for p, _, _ in parts[1:]) == text and max(len(p) for p, _, _ in parts) <= 2024
    assert [p[1] for p in parts] == [True] + [False] * (len(parts) - 1) and [p[2] for p in parts] == [False] * (len(parts) - 1) + [True]

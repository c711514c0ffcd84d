"""Similarity join on word n-grams (operator 4) with Bayesian candidate pruning.

A text's shingles are its runs of five words (lower-cased letters and digits; a
shorter text is one shingle). Two texts are linked where the Jaccard similarity
of their shingle sets is 0.8 or more.

1. Texts with equal shingle sets form a class, of which one represents the rest.
2. Representatives that agree in a band of MinHash values are candidates. Buckets
   of up to SMALL give their pairs. Members of larger buckets are put together
   by connected components, cut into blocks, and compared block by block
   inside tasks that return counts and a spanning forest, never the pairs.
3. A candidate's MinHash values are compared STEP at a time; it is dropped when
   the posterior probability of reaching the threshold (uniform prior) is below
   TOLERANCE.
4. The rest are verified on the shingle sets.

With 32 bands of 4 values a pair at 0.8 is missed with probability 5e-8.

Defined results: null counts as empty; texts without a word form one class;
class_id is the least doc_id among the documents that links connect (null ids
are ignored), n_links the number of other documents that a document is linked to,
copies included; kept marks one document of each connected class: that with the
least doc_id, and one row of repeated rows. Further columns are left alone.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import Memo, hash64, held, map_batches, mix, stored, table, whole_text, words_of
from tenura.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
VALUES, BAND = 128, 4
#: MinHash values compared at once, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Larger buckets are compared in blocks of about BLOCK texts.
SMALL, BLOCK = 24, 256
#: Rows of two or three numbers that may be broadcast (some 50 MB as hash tables); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[:VALUES] | np.uint64(1), _SEEDS[VALUES:]
_PLACES = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of n words."""
    memo = held(("jaccard_join",), lambda: Memo(hash64))
    w = np.fromiter(map(memo.__getitem__, words_of(text)), np.int64).view(np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    total = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += w[k : len(w) - n + 1 + k] * _PLACES[k]
    return np.unique(mix(total))


def minhash(sh: np.ndarray) -> np.ndarray:
    """VALUES minima as unsigned 32-bit integers."""
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint64)
    for begin in range(0, len(sh), 2048):
        part = sh[begin : begin + 2048]
        np.minimum(out, ((_TIMES[:, None] * part[None, :] + _PLUS[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype("<u4")


def set_key(sh: np.ndarray) -> bytes:
    """A 128-bit digest of a shingle set."""
    import hashlib

    return hashlib.blake2b(sh.tobytes(), digest_size=16).digest()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of values compared, the fewest matches that a pair needs to go on.

    Under a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1),
    and its mass above t is the chance of at most m successes in n + 1 trials at t.
    """
    least = []
    for n in range(VALUES + 1):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return least


_LEAST = least_matches()


def reaches(common: np.ndarray, left, right, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether sets of these sizes with so much in common reach the threshold."""
    return common >= threshold * (left + right - common) - 1e-9


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices aren't dropped, by incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        matches = matches + np.count_nonzero(a[alive, n - STEP : n] == b[alive, n - STEP : n], axis=1)
        on = matches >= _LEAST[n]
        alive, matches = alive[on], matches[on]
    return alive


def sketches(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, key, n_shingles and signature of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts, signatures = [], [], []
        for text in batch.column("text"):
            sh = shingles(text.as_py())
            keys.append(set_key(sh))
            counts.append(len(sh))
            signatures.append(minhash(sh).tobytes())
        columns = [batch.column(c) for c in ("row", "doc_id", "text_hash")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], ["row", "doc_id", "text_hash", "key", "n_shingles", "signature"])

    numbered = identified(docs).withColumn("row", F.monotonically_increasing_id())
    return map_batches(numbered, run, "row long, doc_id long, text_hash long, key binary, n_shingles long, signature binary")


def identified(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the representatives wanted (cid, doc_id, text_hash)."""
    small = wanted.count() <= BROADCAST_ROWS
    right = wanted.select("cid", F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    left = identified(docs)
    match = left["doc_id"].eqNullSafe(F.col("d")) & (left["text_hash"] == F.col("h"))
    found = left.join(F.broadcast(right) if small else right, match).select("cid", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return stored(map_batches(found, run, "cid long, shingles binary").dropDuplicates(["cid"]))


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, cid, n, low) for bands that two or more representatives share."""
    band = F.explode(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1))).alias("band")
    rows = reps.filter("n_shingles > 0").select("cid", "signature", band)
    rows = rows.select("cid", F.xxhash64("band", F.expr(f"substring(signature, band * {4 * BAND} + 1, {4 * BAND})")).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("low")).filter("n > 1")
    return stored(rows.join(shared, "bucket"))


def verified(pairs: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""

    def prune(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, VALUES) for c in ("sa", "sb")]
        return batch.select(["a", "b"]).take(pa.array(survivors(*sides)))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            keep.append(bool(reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sig = wanted.select("cid", "signature")
    sided = pairs.join(sig.select(F.col("cid").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("cid").alias("b"), F.col("signature").alias("sb")), "b")
    left = stored(map_batches(sided, prune, "a long, b long"))
    sided = left.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb")), "b")
    return stored(map_batches(sided, verify, "a long, b long"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sorted sets, by 0/1 matrices over slices of their union."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    for begin in range(0, len(shared), 8192):
        part = shared[begin : begin + 8192]
        sides = []
        for flat, rows, n in ((flat_a, rows_a, len(a)), (flat_b, rows_b, len(b))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[rows[hit], at[hit]] = 1.0
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def compare_blocks(group: pa.Table) -> pa.Table:
    """Links of two blocks: for each text the documents it is linked to here, and a forest that spans the links."""
    group = group.sort_by("cid")
    block, i, j = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    cid, size = group.column("cid").to_numpy(), group.column("size").to_numpy()
    sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype="<u4").reshape(-1, VALUES)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    pairs_a, pairs_b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    if i == j:
        up = pairs_a < pairs_b
        pairs_a, pairs_b = pairs_a[up], pairs_b[up]
    out = {"cid": [], "other": [], "linked": []}
    alive = survivors(sig[pairs_a], sig[pairs_b]) if len(pairs_a) else np.zeros(0, dtype=np.int64)
    if len(alive):
        pairs_a, pairs_b = pairs_a[alive], pairs_b[alive]
        use_a, use_b = np.unique(pairs_a), np.unique(pairs_b)
        common = common_counts([sets[k] for k in use_a], [sets[k] for k in use_b])[np.searchsorted(use_a, pairs_a), np.searchsorted(use_b, pairs_b)]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        on = reaches(common, sizes[pairs_a], sizes[pairs_b])
        pairs_a, pairs_b = pairs_a[on], pairs_b[on]
        linked = np.bincount(pairs_a, weights=size[pairs_b], minlength=len(cid)) + np.bincount(pairs_b, weights=size[pairs_a], minlength=len(cid))
        for k in np.flatnonzero(linked):
            out["cid"].append(int(cid[k]))
            out["other"].append(None)
            out["linked"].append(int(linked[k]))
        adjacent = np.zeros((len(cid), len(cid)), dtype=bool)
        adjacent[pairs_a, pairs_b] = adjacent[pairs_b, pairs_a] = True
        new = np.ones(len(cid), dtype=bool)
        for root in range(len(cid)):
            reach = [root] if new[root] else []
            new[root] = False
            while reach:
                node = reach.pop()
                for k in np.flatnonzero(adjacent[node] & new):
                    out["cid"].append(int(cid[node]))
                    out["other"].append(int(cid[k]))
                    out["linked"].append(0)
                    reach.append(int(k))
                new &= ~adjacent[node]
    return pa.table([pa.array(out[c], pa.int64()) for c in out], names=list(out))


def crowded_links(hot: DataFrame, reps: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cid, other, linked): sums of linked documents (other null) and links that connect, within components hot (cid, comp)."""
    sizes = hot.groupBy("comp").agg(F.count("*").alias("members")).select("comp", F.ceil(F.col("members") / block).cast("long").alias("blocks"))
    rows = hot.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    rows = rows.join(reps.select("cid", "size", "signature"), "cid").join(sets, "cid")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "size", "signature", "shingles")
    return stored(rows.groupBy("comp", "i", "j").applyInArrow(compare_blocks, "cid long, other long, linked long"))


def joined(docs: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """row, doc_id, text_hash, class_id, n_links, n_copies and kept of every document, written once."""
    drawn = stored(sketches(docs))
    total = drawn.count()
    classes = stored(drawn.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count("*").alias("size")))
    reps = stored(classes.select(F.col("first.row").alias("cid"), "key", "size").join(drawn.drop("key"), F.col("cid") == F.col("row")).drop("row"))
    shared = buckets(reps)
    star = shared.filter(F.col("n") > small).select(F.col("cid").alias("u"), F.col("low").alias("v"))
    hot = stored(components(star).select(F.col("node").alias("cid"), F.col("component").alias("comp")))
    few = shared.filter(F.col("n") <= small).select("bucket", "cid")
    pairs = few.select("bucket", F.col("cid").alias("a")).join(few.select("bucket", F.col("cid").alias("b")), "bucket").filter("a < b").select("a", "b").distinct()
    inside = pairs.join(hot.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a", "left").join(hot.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b", "left")
    pairs = stored(inside.filter("ca IS NULL OR cb IS NULL OR ca != cb").select("a", "b"))
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(hot.select("cid")).distinct()
    wanted = stored(reps.join(ids, "cid"))
    sets = shingle_sets(docs, wanted)
    links = verified(pairs, wanted, sets)
    crowd = crowded_links(hot, wanted, sets, block)
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(crowd.filter("other IS NOT NULL").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    size = wanted.select("cid", "size")
    both = links.select(F.col("a").alias("at"), F.col("b").alias("cid")).unionByName(links.select(F.col("b").alias("at"), F.col("a").alias("cid")))
    counts = both.join(size, "cid").select(F.col("at").alias("cid"), F.col("size").alias("linked")).unionByName(crowd.filter("other IS NULL").select("cid", "linked"))
    counts = counts.groupBy("cid").agg(F.sum("linked").alias("linked"))
    found = reps.select("cid", "key", "size", "doc_id").join(components(edges).withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    found = found.select("cid", "key", "size", "doc_id", F.coalesce("component", "cid").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    heads = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cid")).alias("head"))
    facts = found.join(heads, "component").select("key", F.col("size").alias("n_copies"), "n_links", F.col("head.doc_id").alias("class_id"), F.col("head.cid").alias("head"))
    facts = stored(facts)
    # the few sets with a large share of all rows don't meet in one task
    most = max(1, total // 200)
    crowd_keys = F.broadcast(facts.filter(F.col("n_copies") > most))
    rows = drawn.select("row", "doc_id", "text_hash", "key")
    out = rows.join(crowd_keys, "key").unionByName(rows.join(crowd_keys.select("key"), "key", "left_anti").join(facts.filter(F.col("n_copies") <= most), "key"))
    return stored(out.select("row", "doc_id", "text_hash", "class_id", "n_links", "n_copies", (F.col("row") == F.col("head")).alias("kept")))


def similarity_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and kept of every document."""
    return joined(docs).select("doc_id", "class_id", "n_links", "n_copies", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each connected class, and their own columns."""
    rows = joined(docs)
    kept = rows.filter("kept").select("doc_id", "text_hash")
    gone = stored(rows.filter("NOT kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    again = stored(gone.join(kept, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_semi"))
    mark = f"hash_{uuid.uuid4().hex}"
    repeats = not again.isEmpty()
    drop = gone.join(again.select(F.col("d").alias("d2"), F.col("h").alias("h2")), F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left_anti") if repeats else gone
    small = gone.count() <= BROADCAST_ROWS
    left = docs.withColumn(mark, F.xxhash64(whole_text()))
    out = left.join(F.broadcast(drop) if small else drop, left["doc_id"].eqNullSafe(F.col("d")) & (left[mark] == F.col("h")), "left_anti")
    if repeats:
        once = [F.col("doc_id").eqNullSafe(F.col("d")) & (F.col(mark) == F.col("h"))]
        single, many = out.join(again, once, "left_anti"), out.join(again, once, "left_semi").dropDuplicates(["doc_id", mark])
        out = single.unionByName(many)
    return out.drop(mark)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))

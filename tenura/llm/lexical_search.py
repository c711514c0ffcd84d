"""Ranked lexical search by Fagin's threshold algorithm (operator 12).

1. Items are cut to their terms, and every whole text is cut to terms once. What
   is written of a document is its forward row: its number of terms, and which of
   the items' terms it has how often.
2. Spark adds up N, L and the document frequencies, which give the weights.
3. A task turns forward rows into segments: the forward index, and for each term
   the list of its documents sorted by falling impact. For each item the lists are
   read round-robin from the top; each document that turns up is looked up in the
   forward index and scored whole. The search of a segment ends when the threshold,
   the sum of the impacts last read, is strictly below the k-th score found in this
   task so far, or when all lists are read.
4. The best rows of the tasks are merged, within salts of an item first.

Segments are by document, so that a term of a third of all documents is in as many
lists as there are segments. Items are searched in chunks of ITEM_TERMS terms, whose
size is counted first; each chunk is one pass over the documents.

Defined results: null texts and texts without a term have none and are no documents
of N; rows that share an item_id are one item; a null item_id is an item; each
repeated row of documents is a document of its own; a null doc_id ranks behind
others of the same score; an item without terms, or whose terms no document has,
gives no rows, as do empty tables; further columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import best_rows, map_batches, map_partitions, stored, table

TOP = 50
#: (item, term) pairs that are searched in one pass.
ITEM_TERMS = 500_000
#: A segment ends behind this many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 65_536, 4_000_000
#: Postings of each list that the first round reads; each later round reads twice as many.
STEP = 16
#: The place of a null doc_id among equal scores.
LAST = np.iinfo(np.int64).max

#: A-Z lower-cased, digits, a-z and all bytes beyond ASCII kept, anything else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_FOLD).split() if text else []


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(item_id, term): the different terms of each item."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, terms = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            own = set(terms_of(text))
            ids += [i] * len(own)
            terms += own
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    return stored(map_batches(items.select(F.col(key).cast("long"), "text"), run, "item_id long, term binary").distinct())


def forward_index(docs: DataFrame, vocabulary: list[bytes], key: str = "doc_id") -> DataFrame:
    """(doc_id, n, terms, counts) of every document, with the vocabulary's terms by their place in it; written."""
    held = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, n, terms, counts, ends = held.value, [], [], [], [0]
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = terms_of(text)
            n.append(len(words))
            for term, count in Counter(words).items():
                if (place := places.get(term)) is not None:
                    terms.append(place)
                    counts.append(count)
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return stored(map_batches(docs.select(F.col(key).cast("long"), "text"), run, "doc_id long, n long, terms array<int>, counts array<long>"))


def document_frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    found = map_partitions(forward.select("terms"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # a row for each term of the items
    out = np.zeros(size, np.int64)
    out[found["term"]] = found["df"]
    return out


class Segment:
    """Some documents' forward index and impact-sorted lists."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, texts: int, length: int):
        flat = lambda name, kind: np.concatenate([b.column(name).flatten().to_numpy() for b in batches]).astype(kind)
        ids = pa.concat_arrays([b.column("doc_id") for b in batches])
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = np.where(self.null, LAST, ids.fill_null(0).to_numpy())
        self.terms, counts = flat("terms", np.int64), flat("counts", np.int64)
        sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in batches])
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        n = [k for b in batches for k in b.column("n").to_pylist()]
        m = np.array([50 + 50 * k * texts // length for k in n], dtype=np.int64)  # in whole numbers of any size
        self.docs = np.repeat(np.arange(len(n)), sizes)
        self.impacts = weights[self.terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[self.docs]))
        order = np.lexsort((-self.impacts, self.terms))
        self.list_docs, self.list_impacts = self.docs[order], self.impacts[order]
        self.list_ends = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=len(weights)))))
        self.wanted = np.zeros(len(weights), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of some documents for the wanted terms."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.ends[docs] - starts, sizes)
        return np.add.reduceat(np.where(self.wanted[self.terms[at]], self.impacts[at], 0), starts)

    def search(self, terms: np.ndarray, best: tuple, k: int) -> tuple:
        """best, (scores, ids, null) in their order, with what this segment's documents add to it."""
        starts, ends = self.list_ends[terms], self.list_ends[terms + 1]
        starts, ends = starts[ends > starts], ends[ends > starts]
        seen, depth, step = np.zeros(len(self.ids), bool), 0, STEP
        self.wanted[terms] = True
        while len(starts):
            reads = [slice(a + depth, min(a + depth + step, b)) for a, b in zip(starts, ends, strict=True)]
            docs = np.unique(np.concatenate([self.list_docs[r] for r in reads]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            if len(docs):
                best = kept(best, (self.scores(docs), self.ids[docs], self.null[docs]), k)
            depth, step = depth + step, 2 * step
            threshold = int(sum(self.list_impacts[r.stop - 1] for r in reads))
            more = ends - starts > depth
            # a list that is read to its end adds nothing any more
            threshold -= int(sum(self.list_impacts[r.stop - 1] for r, go in zip(reads, more, strict=True) if not go))
            if len(best[0]) == k and threshold < best[0][-1]:
                break
            starts, ends = starts[more], ends[more]
        self.wanted[terms] = False
        return best


def kept(best: tuple, new: tuple, k: int) -> tuple:
    """The first k of both by falling score and rising id; scores of 0 are none."""
    positive = new[0] > 0
    if len(best[0]) == k:
        positive &= new[0] >= best[0][-1]
    scores, ids, null = (np.concatenate((a, b[positive])) for a, b in zip(best, new, strict=True))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order], null[order]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches, some at a time, up to the size of a segment."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
        if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
            yield held
            held, docs, postings = [], 0, 0
    if held:
        yield held


def search_chunk(docs: DataFrame, pairs: list, k: int) -> DataFrame | None:
    """(item_id, doc_id, score): the best rows of every task for the items of these (item_id, term) pairs."""
    vocabulary = sorted({p["term"] for p in pairs})
    places = {bytes(t): i for i, t in enumerate(vocabulary)}
    items: dict = {}
    for p in pairs:
        items.setdefault(p["item_id"], []).append(places[bytes(p["term"])])
    forward = forward_index(docs, [bytes(t) for t in vocabulary])
    found = forward.agg(F.count(F.when(F.col("n") > 0, 1)).alias("texts"), F.sum("n").alias("length")).first()
    texts, length = found["texts"], found["length"]
    if not texts:
        return None
    df = document_frequencies(forward, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    held = docs.sparkSession.sparkContext.broadcast((weights, [(i, np.array(sorted(t))) for i, t in items.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = held.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = [none] * len(items)
        for some in segments(batches):
            segment = Segment(some, weights, texts, length)
            best = [segment.search(terms, own, k) for (_, terms), own in zip(items, best, strict=True)]
        for (item, _), (scores, ids, null) in zip(items, best, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(scores)], ["item_id", "doc_id", "score"])

    return map_partitions(forward, run, "item_id long, doc_id long, score long")


RANKED = "item_id long, rank int, doc_id long, score long"


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    terms = item_terms(items)
    chunks = -(-terms.count() // item_terms_at_once)
    chunk, parts = F.pmod(F.xxhash64("item_id"), F.lit(chunks)), []
    for c in range(chunks):
        if pairs := terms.filter(chunk == c).collect():  # about item_terms_at_once rows
            part = search_chunk(docs, pairs, k)
            if part is not None:
                parts.append(part if chunks == 1 else stored(part))
    if not parts:
        return docs.sparkSession.createDataFrame([], RANKED)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    best = best_rows(rows, "item_id", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, F.col("doc_id"))
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS texts, sum(n)::BIGINT AS length FROM size),
item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark)),
weight AS (SELECT term, floor(1000 * ln((2 * max(texts) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole WHERE term IN (SELECT term FROM item) GROUP BY 1),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * texts) // length))) AS points
  FROM tf JOIN weight USING (term) JOIN size USING (doc_id), whole),
score AS (SELECT item_id, doc_id, sum(points)::BIGINT AS score FROM item JOIN impact USING (term) GROUP BY 1, 2 HAVING sum(points) > 0),
place AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score)
SELECT item_id, rank, doc_id, score FROM place WHERE rank <= 50
"""

"""Line dedup by pairwise alignment (operator 1).

Documents that overlap are found through shared line hashes: a rare line (in 2 to
RARE documents) links each holder to the first holder and to the one before it; a
window of lines of MIN_WORDS words or more links each holder to the first holder,
however many hold it. So every common block of that many words is found, with a
number of pairs in proportion to the lines. The lines of windows that a pair
shares are aligned by patience diff; aligned common blocks of MIN_WORDS words or
more go from the later document (the larger doc_id). Lines are compared without
white space at their ends; repeated or moved blocks, which patience diff leaves
out, go by their windows.

A pair is worked on where the larger of its documents is, which is read and
indexed once for all its pairs (once for each part, where it has very many): what
moves for a pair is the smaller document, so one document of a hundred thousand
sources, or the source of as many, costs in proportion to their lines.

Defined results: null texts have one empty line and lose nothing; of repeated rows
the later loses its blocks; rows with a null doc_id come first; lines are split at
line feeds only and the rest of a text is kept as it is; further columns stay,
whatever their names, but n_lines and removed_lines are replaced. Of scripts written
without spaces two characters count as a word.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.llm.common import lists_of, map_batches, map_partitions, mix, stored, table, whole_text

MIN_WORDS, RARE = 20, 16
#: Rows and lines of the removed that may be broadcast (under 20 MB); more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 2_000_000
#: What occurs in more than this share of rows is joined apart: there are at most 200 of those.
HOT_SHARE = 1 / 200

#: Characters of Thai to Burmese, kana, Han and their like.
DENSE = "[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def windows(hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end and hash of each shortest run with at least so many words from a line on, or up to a line.

    Every line of a common block of that many words is in such a run within the block.
    """
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(words)])
    to = np.searchsorted(total, total[:-1] + least)
    since = np.searchsorted(total, total[1:] - least, side="right") - 1
    begin, end = np.flatnonzero((to <= n) & (words > 0)), np.flatnonzero((since >= 0) & (words > 0))
    runs = np.unique(np.concatenate([np.stack([begin, to[begin]]), np.stack([since[end], end + 1])], axis=1), axis=1)
    begin, end = runs[0].astype(np.int64), runs[1].astype(np.int64)
    up, down = powers(_BASE, n), powers(_BACK, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * up[:n], dtype=np.uint64)])
    return begin, end, mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def rising(values: list[int]) -> list[int]:
    """Positions of a longest rising subsequence."""
    tails, last, back = [], [], []
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        back.append(last[at - 1] if at else -1)
        tails[at : at + 1] = [v]
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two lists: equal ends first, then lines that are unique in both, in order, then the gaps."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, iend, j, jend = todo.pop()
        while i < iend and j < jend and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < iend and j < jend and a[iend - 1] == b[jend - 1]:
            iend, jend = iend - 1, jend - 1
            out.append((iend, jend))
        if i >= iend or j >= jend:
            continue
        once: dict = {}
        for k in range(i, iend):
            once[a[k]] = -1 if a[k] in once else k
        other: dict = {}
        for k in range(j, jend):
            other[b[k]] = -1 if b[k] in other else k
        anchors = [(k, other[x]) for x, k in once.items() if k >= 0 and other.get(x, -1) >= 0]
        chosen = rising([q for _, q in anchors])
        if not chosen:
            continue
        x, y = i, j
        for p, q in (anchors[c] for c in chosen):
            todo.append((x, p, y, q))
            x, y = p, q  # the next gap begins with the anchor itself
        todo.append((x, iend, y, jend))
    return sorted(out)


def spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end."""
    n = end - begin
    return np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())


class Lines:
    """A document's lines, and its windows in the order of their hashes."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS):
        begin, end, keys = windows(hashes, words, least)
        order = np.argsort(keys, kind="stable")
        self.hashes, self.words, self.least = hashes, words, least
        self.begin, self.end, self.keys = begin[order], end[order], keys[order]

    def inside(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the lines in windows with one of these distinct hashes."""
        at = spread(np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right"))
        return np.unique(spread(self.begin[at], self.end[at]))


def common_lines(early: Lines, late: Lines) -> np.ndarray:
    """Positions of the late document's lines in common blocks of MIN_WORDS words or more.

    The one with more windows is only searched, never read through.
    """
    few, many = sorted((early, late), key=lambda x: len(x.keys))
    keys = np.unique(few.keys)
    keys = keys[np.searchsorted(many.keys, keys) < np.searchsorted(many.keys, keys, side="right")]
    at_a, at_b = early.inside(keys), late.inside(keys)
    matched = np.array(patience(early.hashes[at_a].tolist(), late.hashes[at_b].tolist()), dtype=np.int64).reshape(-1, 2)
    p, q = at_a[matched[:, 0]], at_b[matched[:, 1]]
    block = np.cumsum(np.concatenate([[0], (np.diff(p) != 1) | (np.diff(q) != 1)]))[: len(q)]
    aligned = q[np.bincount(block, weights=late.words[q])[block] >= late.least]
    moved = np.setdiff1d(at_b, aligned, assume_unique=True)  # in windows of both, but elsewhere or once more
    return np.union1d(aligned, moved)


def sequences(numbered: DataFrame) -> DataFrame:
    """line_row, doc_id, hashes, words (of each line) and line_count."""
    lines = F.transform(F.split(whole_text(), "\n", -1), lambda x: F.trim(x, F.lit(" \t\r")))
    words = F.transform("lines", lambda x: F.when(x == "", 0).otherwise(line_words(x)))
    rows = numbered.select("line_row", "doc_id", lines.alias("lines"))
    return rows.select("line_row", "doc_id", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), words.alias("words"), F.size("lines").alias("line_count"))


def line_words(line: Column) -> Column:
    """Spaces and tabs + 1, and in lines with many characters of three bytes half of those of scripts that are written without spaces."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\u3000"))
    plain = F.when(other, F.translate(line, "\t\u3000", "  ")).otherwise(line)
    spaces = F.length(line) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    dense = F.floor(F.regexp_count(line, F.lit(DENSE)) / 2).cast("int")
    return F.when(F.octet_length(line) < 1.5 * F.length(line), spaces).otherwise(spaces + dense)


def keys_of(rows: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(key, window, doc_id, line_row, line_count): the distinct lines and windows of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, kinds, counts = [], [], []
        for h, w in zip(batch.column("hashes"), batch.column("words"), strict=True):
            hashes, words = h.values.to_numpy(), w.values.to_numpy()
            single = np.unique(hashes[words > 0])
            several = np.unique(windows(hashes, words, least)[2])
            found += [single, several]
            kinds += [np.zeros(len(single), bool), np.ones(len(several), bool)]
            counts.append(len(single) + len(several))
        of = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        names = ["doc_id", "line_row", "line_count"]
        columns = [pa.array(np.concatenate(found)), pa.array(np.concatenate(kinds)), *(batch.column(c).take(of) for c in names)]
        return pa.RecordBatch.from_arrays(columns, ["key", "window", *names])

    return map_batches(rows, run, "key long, window boolean, doc_id long, line_row long, line_count int")


def pairs_of(keys: DataFrame, rare: int = RARE) -> DataFrame:
    """(early, of_early, late, of_late): rows of documents that share a rare line or a window of lines, with their numbers of lines."""
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "line_row", "line_count")
    seen = stored(keys).withColumn("place", order)
    shared = seen.groupBy("key", "window").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1")
    first = F.struct("first.line_row", "first.line_count").alias("first")
    shared = stored(shared.filter(F.col("window") | (F.col("n") <= rare)).select("key", "window", "n", first))
    # the rows of a key with a large share of them are dealt to several tasks
    most = max(1, int((shared.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    hot = F.broadcast(shared.filter(F.col("n") > most).select("key", "window", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    dealt = seen.join(hot, ["key", "window"], "left").withColumn("part", F.pmod(F.xxhash64("line_row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    parts = F.when(F.col("n") > most, F.ceil(F.col("n") / most).cast("int")).otherwise(1)
    copies = shared.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    held = stored(dealt.join(copies.hint("merge"), ["key", "window", "part"]).select("key", "window", "n", "place", "first"))
    pair = lambda a, b: f"struct({a}.line_row AS early, {a}.line_count AS of_early, {b}.line_row AS late, {b}.line_count AS of_late)"
    to_first = held.select(F.expr(pair("first", "place")).alias("x")).select("x.*")
    few = held.filter(~F.col("window")).groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("places"))  # at most rare places
    chain = few.select(F.explode(F.expr(f"transform(sequence(1, size(places) - 1), k -> {pair('places[k - 1]', 'places[k]')})")).alias("x")).select("x.*")
    return to_first.unionByName(chain).filter("early != late").distinct()


def many_of(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """(key, parts) of those with more than most pairs: fewer than 1 / HOT_SHARE."""
    return F.broadcast(pairs.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts")))


def dealt(pairs: DataFrame, key: str, many: DataFrame, name: str, by: tuple[str, ...]) -> DataFrame:
    """pairs with a part: those of a key with many are dealt to several tasks."""
    part = F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")
    return pairs.join(many, key, "left").withColumn(name, part).drop("parts")


def gathered(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """anchor, part, guest, at_late, hashes and words: a row for each anchor and part (guest null), before one for each of its guests.

    Of a pair the earlier document is the anchor, or the later one where it has twice as many lines (at_late).
    """
    at_late = F.col("of_late") > 2 * F.col("of_early")
    anchor, guest = F.when(at_late, F.col("late")).otherwise(F.col("early")), F.when(at_late, F.col("early")).otherwise(F.col("late"))
    pairs = stored(pairs.select(at_late.alias("at_late"), anchor.alias("anchor"), guest.alias("guest")))
    most = max(1, int(pairs.count() * HOT_SHARE))
    placed = stored(dealt(pairs, "anchor", many_of(pairs, "anchor", most), "part", ("guest",)))
    hosts = placed.select(F.col("anchor").alias("line_row"), "anchor", "part", F.lit(None).cast("long").alias("guest"), F.lit(False).alias("at_late")).distinct()
    wanted = hosts.unionByName(placed.select(F.col("guest").alias("line_row"), "anchor", "part", "guest", "at_late"))
    many = many_of(wanted, "line_row", most)
    copies = rows.select("line_row", "hashes", "words").join(many, "line_row", "left")
    copies = copies.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    wanted = dealt(wanted, "line_row", many, "deal", ("anchor", "part", "guest"))
    both = wanted.join(copies.hint("merge"), ["line_row", "deal"]).drop("line_row", "deal")
    return both.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.col("guest").isNotNull())


def removed_lines(rows: DataFrame, pairs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(line_row, removed): the lines that go from each later document."""

    def made(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        counts = np.fromiter((len(x) for _, x in found), np.int64, len(found))
        flat = np.concatenate([x for _, x in found]).astype(np.int32) if found else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), lists_of(flat, counts, pa.int32())], ["line_row", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, document, gone = -1, None, np.zeros(0, dtype=bool)
        for batch in batches:
            found = []
            anchors, guests, at_late = (batch.column(c).to_pylist() for c in ("anchor", "guest", "at_late"))
            for k, (h, w) in enumerate(zip(batch.column("hashes"), batch.column("words"), strict=True)):
                lines = Lines(h.values.to_numpy(), w.values.to_numpy(), least)
                if guests[k] is None:
                    found.append((anchor, np.flatnonzero(gone)))
                    anchor, document, gone = anchors[k], lines, np.zeros(len(h), dtype=bool)
                elif at_late[k]:
                    gone[common_lines(lines, document)] = True
                else:
                    found.append((guests[k], common_lines(document, lines)))
            yield made([x for x in found if len(x[1])])
        yield made([(anchor, np.flatnonzero(gone))] if gone.any() else [])

    gone = map_partitions(gathered(rows, pairs), run, "line_row long, lines array<int>").select("line_row", F.explode("lines").alias("line"))
    return stored(gone.groupBy("line_row").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """docs with text replaced by what is left, and n_lines and removed_lines (their positions) added."""
    docs = docs.drop("n_lines", "removed_lines")
    row, gone = (f"{name}_{uuid.uuid4().hex}" for name in ("row", "removed"))
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = stored(sequences(numbered.select(F.col(row).alias("line_row"), "doc_id", "text")))
    removed = removed_lines(rows, pairs_of(keys_of(rows, least), rare), least)
    size = removed.agg(F.count("*").alias("rows"), F.sum(F.size("removed")).alias("lines")).first()
    small = size["rows"] <= BROADCAST_ROWS and (size["lines"] or 0) <= BROADCAST_LINES
    removed = removed.select(F.col("line_row").alias(row), F.col("removed").alias(gone))
    out = numbered.join(F.broadcast(removed) if small else removed, row, "left")
    lines = F.split(whole_text(), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))
    none = F.array().cast(T.ArrayType(T.IntegerType()))
    added = {"text": text, "n_lines": F.size(lines), "removed_lines": F.coalesce(gone, none)}
    return out.withColumns(added).select(*docs.columns, "n_lines", "removed_lines")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines", F.char_length(whole_text()).alias("n_chars"), F.crc32(whole_text()).alias("text_crc32"))

"""Exact dedup over a persistent digest index (operator 10), built from DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; null counts as
empty. A digest index is a table bucketed and sorted by digest, one row per
digest ever seen. A batch comes in RUNS runs by descending doc_id: of each, the
digests that the index lacks are found by a sort-merge anti-join and appended with
their largest doc_id, so that what an earlier run or batch appended decides on later
ones. Each document's verdict is then read from the index.

A batch may be ingested again under its name, after a crash too: digests that its
first attempt appended stay its own, nothing is appended twice, and the verdicts are
the same.

Defined results: of equal texts the largest doc_id stays (null ids sort lowest);
of repeated rows with that same id exactly one stays; a digest that the index
already holds drops every new row; an empty table gives no rows; further columns
of the input are left alone and may have any name.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.llm.common import shared_dir, stored, table, whole_text

#: A digest with more than this share of a batch is joined by broadcast: there are at most 200 of those.
HOT_SHARE = 1 / 200
#: Runs of a batch, by ranges of doc_id.
RUNS = 3
#: Index rows meant for one bucket.
BUCKET_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """text with A-Z lower-cased and all else as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest_of(column: str = "text") -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(whole_text(column)), 256))


class DigestIndex:
    """A persistent table (digest, keep_id, first_batch), bucketed and sorted by digest.

    It lies below root, by default in the shared folder, in a folder whose name tells its
    generation and buckets; a session whose catalog doesn't know the table registers it
    from there. compact() writes the next generation, a sorted file a bucket, which a
    merge join reads without sorting it (with OUTPUT_ORDER on).
    """

    COLUMNS = "digest binary, keep_id long, first_batch string"
    OUTPUT_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.name, self.root = spark, name, root or f"{shared_dir(spark)}/digest_index"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> list[tuple[int, int, str]]:
        """(generation, buckets, folder) of what is written whole, the oldest first."""
        found = []
        for s in self._fs.globStatus(self._path(f"{self.root}/{self.name}.g*")) or []:
            generation, buckets = s.getPath().getName().removeprefix(f"{self.name}.g").split("b")
            if self._fs.exists(self._path(s.getPath(), "_SUCCESS")):
                found.append((int(generation), int(buckets), f"{self.root}/{s.getPath().getName()}"))
        return sorted(found)

    def _register(self) -> None:
        _, buckets, folder = self._generations()[-1]
        self.spark.sql(f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def _save(self, rows: DataFrame, buckets: int, folder: str, name: str) -> None:
        rows.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").option("path", folder).saveAsTable(name)

    def create(self, rows: int) -> None:
        """An empty index with buckets for about this many rows, unless there is one, here or from another session."""
        if self.spark.catalog.tableExists(self.name):
            return
        if not self._generations():
            buckets = max(8, min(8192, -(-rows // BUCKET_ROWS)))
            self._save(self.spark.createDataFrame([], self.COLUMNS), buckets, f"{self.root}/{self.name}.g1b{buckets}", self.name)
        else:
            self._register()

    def buckets(self) -> int:
        return self._generations()[-1][1]

    def compact(self) -> None:
        """One sorted file for each bucket, as a new generation that the table then reads; what a crash leaves of one isn't read."""
        generation, buckets, folder = self._generations()[-1]
        after = f"{self.root}/{self.name}.g{generation + 1}b{buckets}"
        self._fs.delete(self._path(after), True)
        passing = f"{self.name}_{uuid.uuid4().hex}"
        # by the bucket's number: a repartition by digest would be taken for what the table's layout gives
        self._save(self.read().repartition(buckets, F.pmod(F.hash("digest"), F.lit(buckets))), buckets, after, passing)
        self.spark.sql(f"DROP TABLE {passing}")
        self.spark.sql(f"DROP TABLE {self.name}")
        self._register()
        self._fs.delete(self._path(folder), True)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index lacks: a sort-merge anti-join, with no shuffle of the index."""
        return groups.hint("merge").join(self.read(), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        n = self.buckets()
        (groups.select("digest", "keep_id", F.lit(batch).alias("first_batch")).repartition(n, "digest")
         .write.bucketBy(n, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.name))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for _, _, folder in self._generations():
            self._fs.delete(self._path(folder), True)

    def ingest(self, docs: DataFrame, batch: str | None = None, runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
        """Decide on a batch and append what is new.

        Returns (rows, verdict): one row per document with doc_id, keep_id,
        group_size, kept and text_sha256; and one row per digest of the batch with
        digest, keep_id, keep_row, n, ties and known (another batch had it before).
        group_size counts the batch's copies, and one more where another batch had the text.
        """
        batch = batch or uuid.uuid4().hex
        rows = stored(docs.select(F.col("doc_id"), digest_of().alias("digest")).withColumn("row", F.monotonically_increasing_id()))
        total = rows.count()
        self.create(total)
        for run in self._runs(rows, runs):
            last = run.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
            self.append(stored(self.unseen(last)), batch)
        by_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("ties"), F.max("row").alias("row"))
        by_id = stored(by_id)
        index = self.read().select("digest", "keep_id", (F.col("first_batch") != batch).alias("known"))
        sizes = by_id.groupBy("digest").agg(F.sum("ties").alias("n"))
        # by doc_id too, which spreads the copies of one text
        same = F.col("digest") == F.col("new_digest")
        new = index.filter("NOT known").select(F.col("digest").alias("new_digest"), F.col("keep_id").alias("new_id"))
        kept = by_id.join(new, same & F.col("doc_id").eqNullSafe(F.col("new_id"))).select("digest", F.col("row").alias("keep_row"), "ties")
        verdict = sizes.join(index, "digest").join(kept, "digest", "left")
        verdict = stored(verdict.select("digest", "keep_id", "keep_row", (F.col("n") + F.col("known").cast("int")).alias("n"), "ties", "known"))
        return self._rows(rows, verdict, total), verdict

    @staticmethod
    def _runs(rows: DataFrame, runs: int) -> list[DataFrame]:
        """The rows by ranges of doc_id, the largest first; all rows of one id are in one range, null ids in the last."""
        if runs < 2 or not isinstance(rows.schema["doc_id"].dataType, T.NumericType):
            return [rows]
        shares = [k / runs for k in range(1, runs)]
        cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 1000).alias("cuts")).first()["cuts"]
        out, above = [], None
        for cut in sorted(set(cuts or ()), reverse=True):
            part = F.col("doc_id") > cut
            out.append(rows.filter(part if above is None else part & (F.col("doc_id") <= above)))
            above = cut
        return [*out, rows if above is None else rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= above))]

    def _rows(self, rows: DataFrame, verdict: DataFrame, total: int) -> DataFrame:
        """Each row with its group; the few digests with a large share of the rows don't meet in one task."""
        most = max(1, int(total * HOT_SHARE))
        facts = verdict.select("digest", "keep_id", "keep_row", F.col("n").alias("group_size"))
        hot = facts.filter(F.col("group_size") > most)
        large, small = rows.join(F.broadcast(hot), "digest"), rows.join(F.broadcast(hot), "digest", "left_anti")
        out = large.unionByName(small.join(facts.filter(F.col("group_size") <= most), "digest"))
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def ingested(docs: DataFrame, index: str | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows and verdict of a batch against the named index, or against one of its own that is dropped again."""
    found = DigestIndex(docs.sparkSession, index or f"digest_index_{uuid.uuid4().hex}")
    try:
        return found.ingest(docs, batch)
    finally:
        if index is None:
            found.drop()


def exact_dedup(docs: DataFrame, index: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document against the named index, or against a new one."""
    return ingested(docs, index, batch)[0]


def keep_last(docs: DataFrame, index: str | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with their own columns.

    They are joined by (digest, doc_id), which spreads the copies of one text;
    repeated rows of one id are then reduced to one where there are any.
    """
    mark = f"digest_{uuid.uuid4().hex}"
    verdict = ingested(docs, index, batch)[1].filter(~F.col("known"))
    left = docs.withColumn(mark, digest_of())
    right = verdict.select(F.col("digest").alias(f"{mark}_d"), F.col("keep_id").alias(f"{mark}_k"))
    out = left.join(right, (F.col(mark) == F.col(f"{mark}_d")) & F.col("doc_id").eqNullSafe(F.col(f"{mark}_k")), "left_semi")
    if not verdict.filter("ties > 1").isEmpty():
        out = out.dropDuplicates([mark, "doc_id"])
    return out.drop(mark)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""

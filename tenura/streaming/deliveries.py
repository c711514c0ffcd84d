"""Payment events as they are delivered, batch by batch, merged into a table with their lineage.

The table is a publication: a folder for each month, and a manifest that names the
current one of each. A batch rewrites only the months that it has events of; the new
version uses the other folders as they are. An event's versions are a set, so that a
batch that comes again, in another order or split otherwise, leaves the same table;
the same batch number is a no-op.

A row is late when its day lies more than the allowed delay before the last day of
earlier batches. Late rows aren't merged; they go to a table of their own, and their
number is in the manifest: every delivered row is either in the events' lineage or
counted as late.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators import facts, promote
from tenura.operators.publish import Publication
from tenura.operators.scratch import written

MONTH = "event_month"
#: Rows of a delivered file, about; a task writes one.
FILE_ROWS = 250_000


class Deliveries:
    """The merged events below a root."""

    def __init__(self, spark: SparkSession, root: str, delay_days: int):
        self.spark, self.delay, self.publication = spark, timedelta(days=delay_days), Publication(spark, root)

    def manifest(self) -> dict:
        version = self.publication.current()
        return self.publication.manifest(version) if version else {"batch": -1, "last_day": None, "months": {}, "late": [], "late_rows": 0, "delivered_rows": 0}

    def _read(self, places: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.publication.root}/{p}" for p in places))

    def events(self) -> DataFrame | None:
        """The events with event_key and source_versions; None before the first."""
        months = self.manifest()["months"]
        return self._read(sorted(months.values())) if months else None

    def late(self) -> DataFrame | None:
        """Late rows as they were delivered."""
        places = self.manifest()["late"]
        return self._read(places) if places else None

    def merge(self, rows: DataFrame, batch: int) -> dict:
        """Merge a batch of delivered events (facts.EVENT and source_version); the manifest that holds then."""
        before = self.manifest()
        if batch <= before["batch"]:
            return before
        day, month = F.col("transaction_date"), F.date_format("transaction_date", "yyyyMM")
        limit = date.fromisoformat(before["last_day"]) - self.delay if before["last_day"] else None
        rows = written(rows.select(*facts.EVENT, "source_version").withColumn("is_late", F.coalesce(day < F.lit(limit), F.lit(False)) if limit else F.lit(False)))
        known = rows.agg(F.count("*").alias("n"), F.count_if("is_late").alias("late"), F.max("transaction_date").alias("last_day")).first()
        on_time = rows.filter("NOT is_late").drop("is_late").withColumn(MONTH, F.coalesce(month, F.lit("none")))
        touched = sorted(r[0] for r in on_time.select(MONTH).distinct().collect())  # months
        after = before | {"batch": batch, "delivered_rows": before["delivered_rows"] + known["n"], "late_rows": before["late_rows"] + known["late"]}
        after["last_day"] = max((d for d in (before["last_day"], known["last_day"] and str(known["last_day"])) if d), default=None)
        with self.publication.writing(f"{batch:012d}") as version:
            if touched:
                had = [before["months"][m] for m in touched if m in before["months"]]
                if had:
                    one = F.explode(F.split("source_versions", r"\+")).alias("source_version")
                    on_time = on_time.unionByName(self._read(had).select(*facts.EVENT, one).withColumn(MONTH, F.coalesce(month, F.lit("none"))))
                merged = facts.dedup_transactions(on_time).withColumn(MONTH, F.coalesce(month, F.lit("none")))
                merged.repartition(MONTH, F.pmod(F.hash("subscriber_token"), F.lit(8))).write.option("compression", "zstd").partitionBy(MONTH).parquet(f"{self.publication.folder(version)}/events")
                after["months"] = before["months"] | {m: f"versions/{version}/events/{MONTH}={m}" for m in touched}
            if known["late"]:
                promote.counted_write(rows.filter("is_late").drop("is_late"), f"{self.publication.folder(version)}/late")
                after["late"] = [*before["late"], f"versions/{version}/late"]
            after["uses"] = sorted({p.split("/")[1] for p in (*after["months"].values(), *after["late"])} - {version})
            self.publication.commit(version, after)
        self.publication.clean()
        return after

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge all that a stream has now, a batch of it at a time; a restart goes on behind the last whole batch."""
        query = stream.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def replayed(raw: DataFrame, folder: str, parts: int = 4, delay_days: int = 36_500) -> Deliveries:
    """The rows of a relation as a stream of some shuffled parts, merged below a new folder.

    A part is as many files of about FILE_ROWS rows as it needs, so that no task writes a share of all rows.
    """
    spark = raw.sparkSession
    rows = raw.select(*facts.EVENT, "source_version")
    files = parts * max(1, -(-rows.count() // (parts * FILE_ROWS)))
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(f"{folder}/delivered")
    written_files = len(spark.read.schema(rows.schema).parquet(f"{folder}/delivered").inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-written_files // parts))).parquet(f"{folder}/delivered")
    deliveries = Deliveries(spark, f"{folder}/merged", delay_days)
    deliveries.follow(stream, f"{folder}/checkpoint")
    return deliveries

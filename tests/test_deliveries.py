from pathlib import Path

from pyspark.sql import functions as F

from tenura.operators import facts
from tenura.plans.registry import Warehouse
from tenura.streaming import deliveries
from tenura.streaming.deliveries import Deliveries


def shown(df):
    return sorted(map(str, df.select("event_key", *facts.EVENT, "source_versions").collect()))


def test_a_shuffled_stream_gives_the_batch_result(spark, small, tmp_path):
    raw = Warehouse(spark, small).raw_transactions
    merged = deliveries.replayed(raw, str(tmp_path / "a"), 3)
    assert shown(merged.events()) == shown(facts.dedup_transactions(raw))
    manifest = merged.manifest()
    assert manifest["late_rows"] == 0 and manifest["delivered_rows"] == raw.count() and merged.late() is None
    assert merged.merge(raw, manifest["batch"]) == manifest  # that batch was merged
    again = merged.merge(raw, manifest["batch"] + 1)
    assert again["batch"] == manifest["batch"] + 1 and shown(merged.events()) == shown(facts.dedup_transactions(raw))


def test_only_the_months_of_a_batch_are_rewritten(spark, small, tmp_path):
    raw = Warehouse(spark, small).raw_transactions
    merged = Deliveries(spark, str(tmp_path / "d"), 36_500)
    first = merged.merge(raw.filter("source_version = 'v1'"), 0)["months"]
    month = raw.filter("source_version = 'v2' AND date_format(transaction_date, 'yyyyMM') IN ('199803', '199911')")
    second = merged.merge(month, 1)["months"]
    assert {m for m in second if second[m] != first.get(m)} == {"199803", "199911"}
    merged.merge(month.limit(0), 2)
    merged.merge(month, 3)
    assert merged.manifest()["months"].keys() == first.keys() | {"199803", "199911"}
    want = raw.filter("source_version = 'v1'").unionByName(month)
    assert shown(merged.events()) == shown(facts.dedup_transactions(want))
    assert {Path(f).parts[-1] for f in merged.publication._names("versions")} >= {p.split("/")[1] for p in merged.manifest()["months"].values()}


def test_late_rows_are_kept_apart_and_counted(spark, small, tmp_path):
    raw = Warehouse(spark, small).raw_transactions
    early, late = raw.filter("transaction_date < '1997-01-01'"), raw.filter("transaction_date >= '1998-01-01'")
    merged = Deliveries(spark, str(tmp_path / "d"), 90)
    merged.merge(late, 0)
    merged.merge(early.withColumn("transaction_date", F.when(F.col("payment_method_id") == 1, F.col("transaction_date"))), 1)  # null days are never late
    manifest = merged.manifest()
    undated = early.filter("payment_method_id <> 1").withColumn("transaction_date", F.lit(None).cast("date"))
    assert manifest["late_rows"] == merged.late().count() == early.filter("payment_method_id = 1").count() > 0
    assert manifest["delivered_rows"] == early.count() + late.count()
    assert shown(merged.events()) == shown(facts.dedup_transactions(late.unionByName(undated)))


def test_nothing_delivered(spark, small, tmp_path):
    merged = Deliveries(spark, str(tmp_path / "d"), 5)
    assert merged.events() is None and merged.late() is None
    merged.merge(Warehouse(spark, small).raw_transactions.limit(0), 0)
    assert merged.events() is None and merged.manifest()["delivered_rows"] == 0


def test_no_delivered_file_has_a_share_of_all_rows(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(deliveries, "FILE_ROWS", 100)
    raw = Warehouse(spark, small).raw_transactions.limit(1000).localCheckpoint()
    merged = deliveries.replayed(raw, str(tmp_path / "a"), 2)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "a" / "delivered")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 200
    assert merged.manifest()["batch"] + 1 == 2
    assert shown(merged.events()) == shown(facts.dedup_transactions(raw))

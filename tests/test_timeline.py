import datetime as dt
import time

from pyspark.sql import functions as F

from tenura.contracts import LabelWindow, Settings, windows_frame
from tenura.functions.columns import within
from tenura.operators import features
from tenura.plans.registry import Warehouse

D = dt.date
MANY = Settings(windows=tuple(LabelWindow(f"w{k:02d}", D(1999, 1, 5) + dt.timedelta(23 * k)) for k in range(24)))


def shown(df):
    return sorted(map(str, df.collect()))


def plain(events, windows, day):
    """Every event joined to every window that it is known in."""
    return events.join(F.broadcast(windows.select("label_window", "history_cutoff")), F.col(day) <= F.col("history_cutoff"))


def test_features_of_many_windows_against_joins(spark, small):
    w = Warehouse(spark, small, MANY)
    tx, windows = w.transactions, windows_frame(spark, MANY)
    day, cutoff = F.col("transaction_date"), F.col("history_cutoff")
    rows = plain(features.sequenced(tx), windows, "transaction_date")
    spans = {"lifetime": F.lit(True), **{f"{n}d": within(day, cutoff, n) for n in (30, 90)}}
    want = rows.groupBy(*features.KEY).agg(
        *(F.count_if(c).alias(f"subscription_event_count_{s}") for s, c in spans.items()),
        *(F.coalesce(F.sum(F.when(c, F.col("actual_amount_paid"))), F.lit(0)).alias(f"gross_receipts_{s}") for s, c in spans.items()),
        *(F.count_if(c & (F.col("is_cancel") == 1)).alias(f"cancellation_event_count_{s}") for s, c in spans.items() if s != "90d"),
        F.max("transaction_date").alias("latest_transaction_date"), F.max_by(F.struct(*features.LATEST), F.struct("transaction_date", "same_day_sequence")).alias("last"))
    want = want.select(*features.KEY, *features.SUBSCRIPTION_COUNTS, "latest_transaction_date", *(F.col(f"last.{c}").alias(n) for c, n in features.LATEST.items()))
    got = features.subscription_features(tx, windows)
    assert got.columns == want.columns and shown(got) == shown(want) and got.count() > 500
    heard = w.listening.withColumn("activity_date", F.date_sub("activity_date", F.lit(300)))
    late = plain(heard, windows, "activity_date").filter(within(F.col("activity_date"), cutoff, 90))
    counts = late.groupBy(*features.KEY).agg(F.count("*").alias("n"), F.count_if(within(F.col("activity_date"), cutoff, 30)).alias("m"), F.sum("total_secs").alias("s"), F.max("activity_date").alias("d"), F.count_if("total_secs_was_negative").alias("neg"))
    activity = features.listening_features(heard, windows).select(*features.KEY, F.col("listening_active_days_90d").alias("n"), F.col("listening_active_days_30d").alias("m"), F.col("listening_seconds_90d").alias("s"), F.col("latest_activity_date").alias("d"), F.col("negative_duration_rows_90d").alias("neg"))
    assert shown(activity) == shown(counts) and counts.count() > 50
    past = day <= cutoff
    every = features.sequenced(tx).crossJoin(F.broadcast(windows.select("label_window", "history_cutoff")))
    gaps = every.groupBy(*features.KEY).agg(F.count_if(past).alias("events"), F.max_by(F.when(past, F.col("membership_expire_date")), F.when(past, F.struct("transaction_date", "same_day_sequence"))).alias("e"), F.min(F.when(~past & (F.col("is_cancel") == 0), day)).alias("p")).filter("events > 0")
    assert shown(features.renewal_gaps(tx, windows).select(*features.KEY, F.col("expiration_date").alias("e"), F.col("next_payment_date").alias("p"))) == shown(gaps.select(*features.KEY, "e", "p"))


def test_no_event_is_joined_to_windows(spark, small):
    w = Warehouse(spark, small, MANY)
    for df in (w.subscription, w.activity, w.gaps):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan


def test_the_work_does_not_grow_with_the_windows(spark):
    tables = "/root/testdata/sf0.1"
    took = {}
    for n in (2, 24):
        w = Warehouse(spark, tables, Settings(windows=MANY.windows[:n]))
        for df in (w.subscription, w.gaps):
            df.write.format("noop").mode("overwrite").save()
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took[n] = took.get(n, 0) + time.perf_counter() - began
    assert took[24] < 2.5 * took[2], took


def test_nulls_and_empty(spark, small):
    w = Warehouse(spark, small)
    odd = w.transactions.limit(3).withColumns({"transaction_date": F.lit(None).cast("date"), "actual_amount_paid": F.lit(None).cast("long")})
    assert features.subscription_features(odd, w.windows).count() == 0 and features.renewal_gaps(odd, w.windows).count() == 0
    assert features.subscription_features(w.transactions.limit(0), w.windows).count() == 0
    assert features.listening_features(w.listening.limit(0), w.windows).count() == 0
    paid = w.transactions.filter("transaction_date <= '2000-06-01'").limit(5).withColumn("actual_amount_paid", F.lit(None).cast("long"))
    assert {r[0] for r in features.subscription_features(paid, w.windows).select("gross_receipts_lifetime").collect()} == {0}

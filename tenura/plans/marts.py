"""Marts: aggregates of the snapshot by window and dimension, and their public forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenura.contracts import METRICS
from tenura.functions.columns import month_of, ratio, within



def _outcomes() -> list:
    renewed, churned = F.sum("observed_renewed_within_30_days"), F.sum("is_churn")
    return [F.count("*").alias("eligible_subscribers"), renewed.alias("observed_renewed_subscribers"), churned.alias("observed_churned_subscribers")]


def _rates(renewed: bool = True) -> list:
    out = [ratio(F.sum("is_churn"), F.count("*")).alias("observed_churn_rate")]
    return [ratio(F.sum("observed_renewed_within_30_days"), F.count("*")).alias("observed_renewal_rate"), *out] if renewed else out


def retention_overview(snapshot: DataFrame) -> DataFrame:
    """The KPI row of each window."""
    sums = lambda *names: [F.sum(n).alias(n) for n in names]
    return snapshot.groupBy("label_window").agg(
        F.max("history_cutoff").alias("history_cutoff"), *_outcomes(), F.count_if("is_active_at_cutoff").alias("active_subscribers"), *_rates(),
        *sums("gross_receipts_lifetime", "gross_receipts_30d", "gross_receipts_90d", "subscription_event_count_lifetime", "cancellation_event_count_lifetime"),
        ratio(F.sum("cancellation_event_count_lifetime"), F.sum("subscription_event_count_lifetime")).alias("cancellation_event_rate"),
        *sums("listening_active_days_30d", "listening_active_days_90d", "full_completion_count_30d", "negative_duration_rows_90d"),
    )


def renewal_cohort(snapshot: DataFrame) -> DataFrame:
    """Registration months up to the cutoff's; unknown months drop out."""
    known = snapshot.filter(F.col("registration_cohort_month") <= month_of(F.col("history_cutoff")))
    return known.groupBy("label_window", "registration_cohort_month").agg(*_outcomes(), *_rates(), F.sum("gross_receipts_90d").alias("gross_receipts_90d"))


def engagement_mart(snapshot: DataFrame) -> DataFrame:
    mean = lambda n: ratio(F.sum(n), F.count("*"))
    return snapshot.groupBy("label_window", "engagement_segment").agg(
        *_outcomes(), *_rates(False), mean("listening_active_days_30d").alias("average_listening_active_days_30d"),
        mean("listening_seconds_30d").alias("average_listening_seconds_30d"), F.sum("full_completion_count_30d").alias("full_completion_count_30d"),
    )


def subscription_segment(snapshot: DataFrame) -> DataFrame:
    """Four dimensions in one pass: each row is unpivoted in memory and pre-aggregated before the shuffle."""
    def entry(dimension, column, label):
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(dimension).alias("dimension"), F.col(column).cast("string").alias("segment_key"), label.alias("segment_label")))

    text = lambda c: F.col(c).cast("string")
    entries = F.array_compact(F.array(
        entry("payment_method", "latest_payment_method_id", F.concat(F.lit("Method "), text("latest_payment_method_id"))),
        entry("plan_duration", "latest_payment_plan_days", F.concat(text("latest_payment_plan_days"), F.lit(" days"))),
        entry("registration_method", "registration_method_code", F.concat(F.lit("Channel "), text("registration_method_code"))),
        entry("auto_renew", "latest_is_auto_renew", F.when(F.col("latest_is_auto_renew") == 1, "Auto-renew on").otherwise("Auto-renew off")),
    ))
    rows = snapshot.select("label_window", "observed_renewed_within_30_days", "is_churn", "gross_receipts_90d", F.explode(entries).alias("e")).select("*", "e.*")
    return rows.groupBy("label_window", "dimension", "segment_key", "segment_label").agg(*_outcomes(), *_rates(), F.sum("gross_receipts_90d").alias("gross_receipts_90d"))


def public(mart: DataFrame, minimum: int) -> DataFrame:
    """Groups of at least so many subscribers."""
    return mart.filter(F.col("eligible_subscribers") >= minimum)


def metric_definition(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric_id string, definition string, grain string, direction string, limitation string")


def review_population(snapshot: DataFrame, size: int) -> DataFrame:
    """The subscribers with the largest recent receipts in each window; a bounded set by design."""
    rank = F.row_number().over(W.partitionBy("label_window").orderBy(F.col("gross_receipts_90d").desc_nulls_last(), F.col("subscriber_token").asc_nulls_last()))
    return snapshot.withColumn("rank", rank).filter(F.col("rank") <= size).drop("rank")


def review_transactions(review: DataFrame, events: DataFrame, size: int) -> DataFrame:
    """The latest events of each reviewed subscriber up to the cutoff. The review set is at most its size times the windows."""
    chosen = F.broadcast(review.select("subscriber_token", "label_window", "history_cutoff"))
    rows = events.join(chosen, "subscriber_token").filter(F.col("transaction_date") <= F.col("history_cutoff"))
    order = W.partitionBy("subscriber_token", "label_window").orderBy(F.col("transaction_date").desc_nulls_last(), F.col("same_day_sequence").desc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return ranked.select("subscriber_token", "label_window", "transaction_date", "membership_expire_date", "payment_method_id", "payment_plan_days", "actual_amount_paid", "is_auto_renew", "is_cancel", "same_day_sequence")


def review_listening(review: DataFrame, listening: DataFrame, days: int = 180) -> DataFrame:
    """Monthly activity of each reviewed subscriber over half a year."""
    chosen = F.broadcast(review.select("subscriber_token", "label_window", "history_cutoff"))
    rows = listening.join(chosen, "subscriber_token").filter(within(F.col("activity_date"), F.col("history_cutoff"), days))
    return rows.groupBy("subscriber_token", "label_window", month_of(F.col("activity_date")).alias("activity_month")).agg(
        F.count("*").alias("active_days"), F.sum("total_secs").alias("listening_seconds"), F.sum("num_unq").alias("unique_track_count"))

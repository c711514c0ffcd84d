"""Canonical facts: families to typed rows, deduplication with lineage, and control totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import compact_date, event_key, subscriber_token

EVENT = ("subscriber_token", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel")
COUNTS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")


def canonical(family: str, rows: DataFrame, version: str | None = None, window: str | None = None) -> DataFrame:
    """A source family's rows in canonical types: tokens for ids, dates for integers, sentinels as null."""
    token = subscriber_token(F.col("msno")).alias("subscriber_token")
    if family == "members":
        via = F.when(F.col("registered_via") != -1, F.col("registered_via"))
        gender = F.when(F.col("gender") != "", F.col("gender"))
        return rows.select(token, F.col("city").alias("city_code"), F.col("bd").alias("age_reported"), gender.alias("gender"), via.alias("registration_method_code"), compact_date(F.col("registration_init_time")).alias("registration_date"))
    if family == "labels":
        return rows.select(token, F.lit(window).alias("label_window"), F.col("is_churn").cast("int").alias("is_churn"))
    if family == "transactions":
        plain = [F.col(c) for c in EVENT[1:6]]
        days = [compact_date(F.col(c)).alias(c) for c in ("transaction_date", "membership_expire_date")]
        return rows.select(token, *plain, *days, "is_cancel", F.lit(version).alias("source_version"))
    if family == "listening":
        seconds = F.col("total_secs")
        return rows.select(
            token, compact_date(F.col("date")).alias("activity_date"), *COUNTS, F.greatest(seconds, F.lit(0.0)).alias("total_secs"),
            (seconds < 0).alias("total_secs_was_negative"), F.lit(version).alias("source_version"), F.expr("date div 100").cast("int").alias("activity_month"),
        )
    raise ValueError(f"unknown family {family}")


def dedup_transactions(rows: DataFrame) -> DataFrame:
    """One row per distinct event, with the versions that delivered it: a single hash aggregation on the nine columns."""
    versions = F.when(F.min("source_version") == F.max("source_version"), F.min("source_version")).otherwise("v1+v2")
    out = rows.groupBy(*EVENT).agg(versions.alias("source_versions"))
    return out.select(event_key(*(F.col(c) for c in EVENT)).alias("event_key"), *EVENT, "source_versions")


def dedup_controls(rows: DataFrame) -> DataFrame:
    """Rows before and after deduplication, and why rows went, in one row."""
    one = rows.groupBy(*EVENT, "source_version").agg(F.count("*").alias("n"))
    events = one.groupBy(*EVENT).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("within"), F.count("*").alias("versions"))
    return events.agg(
        F.sum("n").alias("source_rows"), F.count("*").alias("accepted_rows"), (F.sum("n") - F.count("*")).alias("removed_rows"),
        F.sum("within").alias("within_version_removed"), F.count_if(F.col("versions") > 1).alias("cross_version_events"),
        F.sum(F.col("actual_amount_paid")).alias("accepted_amount"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"),
    )


def profile(rows: DataFrame, key: str, day: str, approximate: bool = False) -> DataFrame:
    """Rows, subscribers, date range and null cells of a source, in one pass."""
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(F.col(key))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in rows.columns), F.lit(0))
    return rows.agg(F.count("*").alias("source_rows"), distinct.alias("subscribers"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), nulls.alias("null_cells"))


def invalid_transaction() -> Column:
    """True where a payment event breaks its domain; null values alone don't."""
    flags = ~F.col("is_auto_renew").isin(0, 1) | ~F.col("is_cancel").isin(0, 1)
    return (F.col("payment_method_id") <= 0) | (F.col("payment_plan_days") < 0) | (F.col("plan_list_price") < 0) | (F.col("actual_amount_paid") < 0) | flags


def member_controls(rows: DataFrame) -> DataFrame:
    domain = (F.col("city_code") < 0) | (F.col("registration_method_code") < 0) | ~F.col("gender").isin("female", "male")
    return rows.agg(
        F.count("*").alias("member_rows"), F.count_distinct("subscriber_token").alias("distinct_tokens"), F.count_if(F.col("subscriber_token").isNull()).alias("null_tokens"),
        F.count_if(domain).alias("invalid_rows"), F.count_if(F.col("gender").isNull()).alias("null_genders"), F.count_if(F.col("registration_date").isNull()).alias("null_registrations"),
    )


def label_controls(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label_window").agg(
        F.count("*").alias("label_rows"), F.count_distinct("subscriber_token").alias("distinct_tokens"),
        F.count_if(~F.col("is_churn").isin(0, 1)).alias("invalid_rows"), F.sum("is_churn").alias("churned"),
    )


def transaction_controls(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("accepted_rows"), F.count_distinct("event_key").alias("distinct_events"), F.count_if(invalid_transaction()).alias("invalid_rows"))


def listening_controls(rows: DataFrame, by: tuple[str, ...] = ("source_version", "activity_month")) -> DataFrame:
    """Key uniqueness and domains by version and month, or by version alone."""
    bad = F.col("total_secs") < 0
    for c in COUNTS:
        bad = bad | (F.col(c) < 0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("listening_rows"), F.count_distinct(F.struct("subscriber_token", "activity_date")).alias("distinct_days"), F.count_if(bad).alias("invalid_rows"),
        F.count_if("total_secs_was_negative").alias("negative_rows"), F.sum("total_secs").cast("double").alias("total_secs"),
        F.min("activity_date").alias("first_date"), F.max("activity_date").alias("last_date"),
    )


def require_valid_listening(by_version: DataFrame) -> None:
    """Raise when keys repeat, a domain is broken or the versions' dates overlap."""
    found = sorted((r.asDict() for r in by_version.collect()), key=lambda r: r["source_version"])  # a row per version
    for r in found:
        if r["listening_rows"] != r["distinct_days"] or r["invalid_rows"]:
            raise ValueError(f"listening {r['source_version']}: repeated keys or invalid rows")
    for a, b in zip(found, found[1:], strict=False):
        if a["last_date"] >= b["first_date"]:
            raise ValueError("listening versions overlap")

"""Comparison of two windows: metric movements, cohort breaks and segment breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metric, kind of change, and which direction is good.
MOVEMENTS = (
    ("observed_churn_rate", "rate", "lower"), ("active_subscribers", "count", "higher"), ("observed_renewal_rate", "rate", "higher"),
    ("gross_receipts_30d", "amount", "context"), ("cancellation_event_rate", "rate", "lower"), ("listening_active_days_30d", "count", "context"),
)
#: Numerator and denominator of each metric that has them.
BASIS = {
    "observed_churn_rate": ("observed_churned_subscribers", "eligible_subscribers"), "observed_renewal_rate": ("observed_renewed_subscribers", "eligible_subscribers"),
    "active_subscribers": ("active_subscribers", "eligible_subscribers"), "cancellation_event_rate": ("cancellation_event_count_lifetime", "subscription_event_count_lifetime"),
}


def _long(overview: DataFrame, window: str, name: str, columns: list[str]) -> DataFrame:
    row = overview.filter(F.col("label_window") == window).select("label_window", *(F.col(c).cast("double").alias(c) for c in columns))
    return row.unpivot("label_window", columns, "metric", name).drop("label_window")


def movements(overview: DataFrame, current: str, comparison: str) -> DataFrame:
    """Absolute and relative change of each metric, and its tone."""
    metrics = [m for m, _, _ in MOVEMENTS]
    kinds = F.broadcast(overview.sparkSession.createDataFrame(MOVEMENTS, "metric string, kind string, direction string"))
    both = _long(overview, current, "current_value", metrics).join(_long(overview, comparison, "comparison_value", metrics), "metric").join(kinds, "metric")
    delta = F.col("current_value") - F.col("comparison_value")
    relative = F.coalesce(delta / F.when(F.col("comparison_value") != 0, F.abs("comparison_value")), F.lit(0.0))
    shown = F.when(F.col("kind") == "rate", F.round(delta * 100, 1)).otherwise(delta)
    sign = F.when(F.col("direction") == "higher", shown).when(F.col("direction") == "lower", -shown).otherwise(F.lit(0.0))
    tone = F.when(sign < 0, "adverse").when(sign > 0, "favorable").otherwise("context")
    return both.select("metric", "kind", "direction", "comparison_value", "current_value", delta.alias("delta"), shown.alias("shown_delta"), F.round(relative * 100, 1).alias("relative_percent"), tone.alias("tone"))


def basis(overview: DataFrame, current: str, comparison: str) -> DataFrame:
    """Numerator and denominator of the rates in both windows."""
    rows = overview.filter(F.col("label_window").isin(current, comparison))
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(n).cast("long").alias("numerator"), F.col(d).cast("long").alias("denominator")) for m, (n, d) in BASIS.items()))
    return rows.select("label_window", F.explode(entries).alias("b")).select("label_window", "b.*")


def _matched(mart: DataFrame, keys: list[str], current: str, comparison: str) -> DataFrame:
    side = lambda w, tail: mart.filter(F.col("label_window") == w).select(*keys, F.col("eligible_subscribers").alias(f"{tail}_eligible"), F.col("observed_churn_rate").alias(f"{tail}_churn_rate"))
    both = side(current, "current").join(side(comparison, "comparison"), keys)
    change = F.round((F.col("current_churn_rate") - F.col("comparison_churn_rate")) * 100, 1)
    return both.withColumn("change_pp", change)


def cohort_breaks(cohorts: DataFrame, current: str, comparison: str, limit: int = 7) -> DataFrame:
    """The newest cohorts that both windows have."""
    return _matched(cohorts, ["registration_cohort_month"], current, comparison).orderBy(F.col("registration_cohort_month").desc()).limit(limit)


def segment_breaks(segments: DataFrame, keys: list[str], current: str, comparison: str, minimum: int, limit: int = 7) -> DataFrame:
    """Segments of both windows with the highest current churn, small groups marked."""
    both = _matched(segments, keys, current, comparison)
    small = F.least("current_eligible", "comparison_eligible") < minimum
    return both.withColumn("small_group", small).orderBy(F.col("current_churn_rate").desc(), *keys).limit(limit)

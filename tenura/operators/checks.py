"""Quality gates as violation relations: an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counted(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(check_id, violations) of each check."""
    each = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_id"), "violations") for name, df in checks]
    return reduce(DataFrame.unionByName, each)


def gate(report: DataFrame) -> None:
    """Raise when a check of the report has violations; a report has a row per check."""
    bad = report.filter("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check_id']}: {r['violations']}" for r in bad))


def null_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, violations), in one pass over the relation."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in columns)))
    return counts.select(pairs.alias("x")).select("x.*")


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their rows."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def unaccepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(~F.col(column).isin(values))


def unreconciled(overview: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Windows whose outcomes don't add up."""
    parts = F.col("observed_renewed_subscribers") + F.col("observed_churned_subscribers")
    rates = F.abs(F.col("observed_renewal_rate") + F.col("observed_churn_rate") - 1)
    return overview.filter((F.col("eligible_subscribers") != parts) | (rates > tolerance))


def small_groups(relations: dict[str, DataFrame], keys: dict[str, list[str]], minimum: int) -> DataFrame:
    """Published groups below the minimum."""
    each = [df.filter(F.col("eligible_subscribers") < minimum).select(F.lit(n).alias("relation"), F.concat_ws(":", *(F.col(k).cast("string") for k in keys[n])).alias("group_key"), "eligible_subscribers") for n, df in relations.items()]
    return reduce(DataFrame.unionByName, each)


def private_columns(relations: dict[str, DataFrame], denied: frozenset[str]) -> list[tuple[str, str]]:
    """(relation, column) of published columns that must stay private; schemas only, no job."""
    return [(n, c) for n, df in relations.items() for c in df.columns if c in denied]


def unsafe(snapshot: DataFrame) -> DataFrame:
    """Rows that know of anything after their cutoff."""
    after = [F.coalesce(F.col(c) > F.col("history_cutoff"), F.lit(False)) for c in ("latest_transaction_date", "latest_activity_date")]
    return snapshot.filter(after[0] | after[1])


def orphans(fact: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a fact that its dimension lacks."""
    return fact.select(*keys).distinct().join(dimension.select(*keys), keys, "left_anti")


def compared_controls(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(control_id, expected_value, actual_value, problem) of each control on either side; problem is null where both agree."""
    both = expected.select("control_id", "expected_value").join(actual.select("control_id", "actual_value"), "control_id", "full_outer")
    missing = F.when(F.col("expected_value").isNull(), "not expected").when(F.col("actual_value").isNull(), "missing")
    differs = F.when(F.abs(F.col("expected_value") - F.col("actual_value")) > tolerance, "differs")
    return both.withColumn("problem", F.coalesce(missing, differs))


def require_controls(compared: DataFrame) -> None:
    """Raise where a compared control has a problem; a report has a row for each control."""
    bad = compared.filter("problem IS NOT NULL").orderBy("control_id").collect()
    if bad:
        raise ValueError("; ".join(f"{r['control_id']}: {r['problem']}" for r in bad))


def placed(expected: DataFrame, actual: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(position, column_name, expected, actual) of two relations of a few rows, zipped by their place in this order; a row that a side lacks is null."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        numbered = df.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)))
        return numbered.select("position", *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("position", columns, "column_name", name)

    return rows(expected, "expected").join(rows(actual, "actual"), ["position", "column_name"], "full_outer")


def forbidden_keys(payload, denied: frozenset[str], at: str = "$") -> list[str]:
    """Paths of denied keys in a JSON document of any depth."""
    if isinstance(payload, dict):
        own = [f"{at}.{k}" for k in payload if k in denied]
        return own + [p for k, v in payload.items() for p in forbidden_keys(v, denied, f"{at}.{k}")]
    if isinstance(payload, list):
        return [p for k, v in enumerate(payload) for p in forbidden_keys(v, denied, f"{at}[{k}]")]
    return []


def relative_error(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) / F.greatest(F.abs(expected), F.lit(1.0))


RECONCILED = (
    "eligible_subscribers", "observed_churned_subscribers", "observed_renewed_subscribers", "gross_receipts_lifetime",
    "subscription_event_count_lifetime", "cancellation_event_count_lifetime", "listening_active_days_30d", "listening_active_days_90d",
)


def reconciled(overview: DataFrame, labels: DataFrame, transactions: DataFrame, listening: DataFrame, windows: DataFrame) -> DataFrame:
    """(label_window, metric, expected, actual, error) of the overview against a recomputation from facts by another plan."""
    cut = F.broadcast(windows.select("label_window", "history_cutoff"))
    eligible = labels.join(cut, "label_window")
    outcome = eligible.groupBy("label_window").agg(F.count("*").alias("eligible_subscribers"), F.sum("is_churn").alias("observed_churned_subscribers"), F.sum(1 - F.col("is_churn")).alias("observed_renewed_subscribers"))
    paid = eligible.join(transactions, "subscriber_token").filter("transaction_date <= history_cutoff").groupBy("label_window").agg(
        F.sum("actual_amount_paid").alias("gross_receipts_lifetime"), F.count("*").alias("subscription_event_count_lifetime"), F.count_if(F.col("is_cancel") == 1).alias("cancellation_event_count_lifetime"))
    lag = F.datediff("history_cutoff", "activity_date")
    heard = eligible.join(listening, "subscriber_token").filter(lag.between(0, 89)).groupBy("label_window").agg(F.count_if(lag < 30).alias("listening_active_days_30d"), F.count("*").alias("listening_active_days_90d"))
    expected = outcome.join(paid, "label_window").join(heard, "label_window")
    long = lambda df, name: df.select("label_window", *(F.col(m).cast("double").alias(m) for m in RECONCILED)).unpivot("label_window", list(RECONCILED), "metric", name)
    both = long(expected, "expected").join(long(overview, "actual"), ["label_window", "metric"])
    return both.withColumn("error", relative_error(F.col("actual"), F.col("expected")))


def leaks(spark: SparkSession, folder: str, names: frozenset[str], pattern: str = "(?i)(^|[^0-9a-f])[0-9a-f]{24}([^0-9a-f]|$)") -> DataFrame:
    """(path, line) of a written bundle's lines that hold a private column's name or a subscriber's token."""
    word = "|".join(sorted(names))
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.filter(F.col("line").rlike(rf"\b({word})\b") | F.col("line").rlike(pattern))

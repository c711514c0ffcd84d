"""BI star: dimensions, facts, and measures that are recomputed from sums in a valid context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import ratio
from tenura.operators.checks import compared_controls
from tenura.sources.readers import read_controls

SEGMENT_ORDER = {"dormant": 1, "light": 2, "steady": 3, "high": 4}
OVERVIEW = ("eligible_subscribers", "active_subscribers", "observed_renewed_subscribers", "observed_churned_subscribers", "gross_receipts_lifetime", "gross_receipts_30d", "gross_receipts_90d", "subscription_event_count_lifetime", "cancellation_event_count_lifetime", "listening_active_days_30d", "listening_active_days_90d", "full_completion_count_30d", "negative_duration_rows_90d")
GROUP = ("eligible_subscribers", "observed_renewed_subscribers", "observed_churned_subscribers")
#: Fact, dimension and key of each one-to-many relationship.
RELATIONSHIPS = (
    ("fct_retention_overview", "dim_label_window", "label_window"), ("fct_renewal_cohort", "dim_label_window", "label_window"), ("fct_engagement_segment", "dim_label_window", "label_window"), ("fct_subscription_segment", "dim_label_window", "label_window"),
    ("fct_renewal_cohort", "dim_registration_cohort", "registration_cohort_key"), ("fct_engagement_segment", "dim_engagement_segment", "engagement_segment"), ("fct_subscription_segment", "dim_subscription_segment", "subscription_segment_key"),
)


def _cohort_key() -> Column:
    return F.coalesce(F.date_format("registration_cohort_month", "yyyy-MM-dd"), F.lit("unknown"))


def star(overview: DataFrame, cohorts: DataFrame, engagement: DataFrame, segments: DataFrame, definitions: DataFrame) -> dict[str, DataFrame]:
    """The nine tables by name."""
    month = F.col("registration_cohort_month")
    order = F.lit(5)
    for name, place in SEGMENT_ORDER.items():
        order = F.when(F.lower("engagement_segment") == name, place).otherwise(order)
    key = F.concat_ws(":", "dimension", "segment_key").alias("subscription_segment_key")
    whole = lambda names: [F.col(n).cast("long").alias(n) for n in names]
    return {
        "dim_label_window": overview.select("label_window", "history_cutoff"),
        "dim_registration_cohort": cohorts.select(
            _cohort_key().alias("registration_cohort_key"), month, F.coalesce(F.date_format(month, "MMMM yyyy"), F.lit("Unknown registration cohort")).alias("registration_cohort_label"),
            F.coalesce(F.year(month) * 100 + F.month(month), F.lit(0)).alias("registration_cohort_sort")).distinct(),
        "dim_engagement_segment": engagement.select("engagement_segment", order.alias("engagement_segment_sort")).distinct(),
        "dim_subscription_segment": segments.select(key, "dimension", "segment_key", "segment_label").distinct(),
        "dim_metric_definition": definitions,
        "fct_retention_overview": overview.select("label_window", *whole(OVERVIEW)),
        "fct_renewal_cohort": cohorts.select("label_window", _cohort_key().alias("registration_cohort_key"), *whole((*GROUP, "gross_receipts_90d"))),
        "fct_engagement_segment": engagement.select("label_window", "engagement_segment", *whole(GROUP), "average_listening_active_days_30d", "average_listening_seconds_30d", *whole(("full_completion_count_30d",))),
        "fct_subscription_segment": segments.select("label_window", key, *whole((*GROUP, "gross_receipts_90d"))),
    }


def _measured(fact: DataFrame, by: list[str], valid: Column, sums: dict[str, str], rates: dict[str, tuple[str, str]], weighted: dict[str, str] | None = None) -> DataFrame:
    """Sums and ratios of sums by context; null where the context isn't one window (and dimension)."""
    weight = F.sum("eligible_subscribers")
    columns = {name: F.when(valid, F.sum(c)) for name, c in sums.items()}
    columns |= {name: F.when(valid, ratio(F.sum(a), F.sum(b))) for name, (a, b) in rates.items()}
    columns |= {name: F.when(valid, ratio(F.sum(F.col(c) * F.col("eligible_subscribers")), weight)) for name, c in (weighted or {}).items()}
    return fact.groupBy(*by).agg(*(c.alias(n) for n, c in columns.items()))


ONE_WINDOW = "label_window"
RATES = {"renewal_rate": ("observed_renewed_subscribers", "eligible_subscribers"), "churn_rate": ("observed_churned_subscribers", "eligible_subscribers")}


def _one(column: str = ONE_WINDOW) -> Column:
    return F.min(column) == F.max(column)


def overview_measures(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    rates = RATES | {"cancellation_event_rate": ("cancellation_event_count_lifetime", "subscription_event_count_lifetime")}
    return _measured(tables["fct_retention_overview"].withColumn("context", F.lit("all")), by, _one(), {n: n for n in OVERVIEW}, rates)


def cohort_measures(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    return _measured(tables["fct_renewal_cohort"].withColumn("context", F.lit("all")), by, _one(), {n: n for n in (*GROUP, "gross_receipts_90d")}, RATES)


def engagement_measures(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    means = {n: n for n in ("average_listening_active_days_30d", "average_listening_seconds_30d")}
    return _measured(tables["fct_engagement_segment"].withColumn("context", F.lit("all")), by, _one(), {n: n for n in (*GROUP, "full_completion_count_30d")}, RATES, means)


def subscription_measures(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    dimension = F.broadcast(tables["dim_subscription_segment"].select("subscription_segment_key", "dimension"))
    rows = tables["fct_subscription_segment"].join(dimension, "subscription_segment_key").withColumn("context", F.lit("all"))
    return _measured(rows, by, _one() & _one("dimension"), {n: n for n in (*GROUP, "gross_receipts_90d")}, RATES)


def controls(tables: dict[str, DataFrame], windows: list[str]) -> DataFrame:
    """(control_id, measure_id, actual_value) of four overview measures in each fixed window."""
    short = {"eligible": "eligible_subscribers", "renewed": "observed_renewed_subscribers", "churned": "observed_churned_subscribers", "gross_receipts_lifetime": "gross_receipts_lifetime"}
    measures = overview_measures(tables, ["label_window"]).filter(F.col("label_window").isin(windows))
    each = [measures.select(F.concat_ws(":", "label_window", F.lit(n)).alias("control_id"), F.lit(f"overview_{n}").alias("measure_id"), F.col(c).alias("actual_value")) for n, c in short.items()]
    return reduce(DataFrame.unionByName, each)


#: The columns that tell the rows of each table apart.
GRAIN = {
    "dim_label_window": ("label_window",), "dim_registration_cohort": ("registration_cohort_key",), "dim_engagement_segment": ("engagement_segment",),
    "dim_subscription_segment": ("subscription_segment_key",), "dim_metric_definition": ("metric_id",), "fct_retention_overview": ("label_window",),
    "fct_renewal_cohort": ("label_window", "registration_cohort_key"), "fct_engagement_segment": ("label_window", "engagement_segment"),
    "fct_subscription_segment": ("label_window", "subscription_segment_key"),
}


#: Columns and types of each table, in their order (fixed values of the published model).
_SUMS = ", ".join(f"{c} bigint" for c in GROUP)
SCHEMAS = {
    "dim_label_window": "label_window string, history_cutoff date",
    "dim_registration_cohort": "registration_cohort_key string, registration_cohort_month date, registration_cohort_label string, registration_cohort_sort int",
    "dim_engagement_segment": "engagement_segment string, engagement_segment_sort int",
    "dim_subscription_segment": "subscription_segment_key string, dimension string, segment_key string, segment_label string",
    "dim_metric_definition": "metric_id string, definition string, grain string, direction string, limitation string",
    "fct_retention_overview": "label_window string, " + ", ".join(f"{c} bigint" for c in OVERVIEW),
    "fct_renewal_cohort": f"label_window string, registration_cohort_key string, {_SUMS}, gross_receipts_90d bigint",
    "fct_engagement_segment": f"label_window string, engagement_segment string, {_SUMS}, average_listening_active_days_30d double, average_listening_seconds_30d double, full_completion_count_30d bigint",
    "fct_subscription_segment": f"label_window string, subscription_segment_key string, {_SUMS}, gross_receipts_90d bigint",
}


def schema_problems(tables: dict[str, DataFrame]) -> list[str]:
    """What differs from the published columns, their order or types; metadata alone, no job."""
    found = {name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for name, df in tables.items()}
    missing = [f"{name} is missing" for name in SCHEMAS if name not in found] + [f"{name} isn't published" for name in found if name not in SCHEMAS]
    return missing + [f"{name}: {found[name]} instead of {want}" for name, want in SCHEMAS.items() if name in found and found[name] != want]


def exchanged_controls(tables: dict[str, DataFrame], windows: list[str], folder: str) -> DataFrame:
    """The controls, written as an engine's export, read in again and compared with those of the star."""
    expected = controls(tables, windows).withColumn("expected_value", F.col("actual_value").cast("double")).drop("actual_value")
    controls(tables, windows).coalesce(1).write.option("header", True).csv(folder)
    return compared_controls(expected, read_controls(tables["fct_retention_overview"].sparkSession, folder, "actual_value"))


def contract(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, repeated_grain, null_grain, unreconciled): what a model over the star relies on, a row each; raises where a schema drifted."""
    if problems := schema_problems(tables):
        raise ValueError("; ".join(problems))
    out = None
    for name, keys in GRAIN.items():
        df, null = tables[name], reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        parts = F.col("observed_renewed_subscribers") + F.col("observed_churned_subscribers")
        wrong = F.count_if(F.col("eligible_subscribers") != parts) if name.startswith("fct_") else F.lit(0).cast("long")
        whole = df.agg(F.count("*").alias("rows"), F.count_if(null).alias("null_grain"), wrong.alias("unreconciled"))
        repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_grain"))
        row = whole.join(F.broadcast(repeated)).select(F.lit(name).alias("table_name"), "rows", "repeated_grain", "null_grain", "unreconciled")
        out = row if out is None else out.unionByName(row)
    return out

"""Query templates of the serving layer: bounded DataFrames behind validated parameters.

Public and private stores are different objects: a public one has no relation that
holds a subscriber, so no template can reach one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.operators.promote import write_report

DIMENSIONS = ("payment_method", "plan_duration", "registration_method", "auto_renew")
TOKEN = re.compile(r"[0-9a-f]{24}")


def bounded(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} is a whole number from {low} to {high}")
    return value


@dataclass(frozen=True)
class PublicStore:
    """Aggregates only."""

    overview: DataFrame
    cohorts: DataFrame
    engagement: DataFrame
    segments: DataFrame
    definitions: DataFrame
    cutoffs: dict[str, date]

    def window(self, label_window: str) -> str:
        if label_window not in self.cutoffs:
            raise ValueError(f"unknown window {label_window!r}")
        return label_window

    def status(self) -> DataFrame:
        return self.overview.select("label_window", "history_cutoff", "eligible_subscribers").orderBy("label_window")

    def overview_row(self, label_window: str) -> DataFrame:
        return self.overview.filter(F.col("label_window") == self.window(label_window))

    def cohort_rows(self, label_window: str, limit: int = 48) -> DataFrame:
        """The newest cohorts up to the cutoff's month."""
        bound = self.cutoffs[self.window(label_window)].replace(day=1)
        rows = self.cohorts.filter((F.col("label_window") == label_window) & (F.col("registration_cohort_month") <= F.lit(bound)))
        return rows.orderBy(F.col("registration_cohort_month").desc_nulls_last()).limit(bounded("limit", limit, 1, 240))

    def segment_rows(self, label_window: str, dimension: str = "engagement", limit: int = 16) -> DataFrame:
        self.window(label_window)
        bounded("limit", limit, 1, 50)
        if dimension == "engagement":  # four segments at most, whatever the limit
            return self.engagement.filter(F.col("label_window") == label_window).orderBy(F.col("observed_churn_rate").desc_nulls_last(), "engagement_segment")
        if dimension not in DIMENSIONS:
            raise ValueError(f"unknown dimension {dimension!r}")
        rows = self.segments.filter((F.col("label_window") == label_window) & (F.col("dimension") == dimension))
        return rows.orderBy(F.col("eligible_subscribers").desc_nulls_last(), "segment_key").limit(limit)

    def definition_rows(self) -> DataFrame:
        return self.definitions.orderBy("metric_id")

    def export(self, resource: str, label_window: str) -> DataFrame:
        """What a CSV download holds."""
        self.window(label_window)
        if resource == "overview":
            return self.overview_row(label_window)
        if resource == "cohorts":
            bound = self.cutoffs[label_window].replace(day=1)
            return self.cohorts.filter((F.col("label_window") == label_window) & (F.col("registration_cohort_month") <= F.lit(bound))).orderBy("registration_cohort_month")
        if resource == "segments":
            return self.segments.filter(F.col("label_window") == label_window).orderBy("dimension", F.col("eligible_subscribers").desc_nulls_last(), "segment_key")
        raise ValueError(f"unknown export {resource!r}")


@dataclass(frozen=True)
class PrivateStore(PublicStore):
    """Adds the bounded review sets."""

    population: DataFrame
    transactions: DataFrame
    listening: DataFrame

    def subscribers(self, label_window: str, engagement_segment: str | None = None, outcome: str = "all", limit: int = 20) -> DataFrame:
        """The review population by receipts, optionally of one segment or outcome."""
        if outcome not in ("all", "renewed", "churned"):
            raise ValueError(f"unknown outcome {outcome!r}")
        rows = self.population.filter(F.col("label_window") == self.window(label_window))
        if engagement_segment:
            rows = rows.filter(F.col("engagement_segment") == engagement_segment)
        if outcome != "all":
            rows = rows.filter(F.col("is_churn") == int(outcome == "churned"))
        shown = rows.orderBy(F.col("gross_receipts_90d").desc_nulls_last(), "subscriber_token").limit(bounded("limit", limit, 1, 50))
        return shown.select("subscriber_token", "label_window", "is_churn", "is_active_at_cutoff", "effective_expiration_date", "engagement_segment", "gross_receipts_90d", "listening_active_days_30d", "latest_payment_plan_days", "latest_is_auto_renew")

    def _of(self, rows: DataFrame, token: str, label_window: str) -> DataFrame:
        token = token.lower()
        if not TOKEN.fullmatch(token):
            raise ValueError("a token is 24 hexadecimal digits")
        return rows.filter((F.col("subscriber_token") == F.unhex(F.lit(token))) & (F.col("label_window") == self.window(label_window)))

    def profile(self, token: str, label_window: str) -> DataFrame:
        return self._of(self.population, token, label_window)

    def journey_transactions(self, token: str, label_window: str) -> DataFrame:
        rows = self._of(self.transactions, token, label_window)
        return rows.orderBy(F.col("transaction_date").desc(), F.col("same_day_sequence").desc()).limit(24)

    def journey_listening(self, token: str, label_window: str) -> DataFrame:
        return self._of(self.listening, token, label_window).orderBy("activity_month")


def envelope(rows: DataFrame, mode: str, release_id: str, **filters) -> dict:
    """A JSON-ready response; templates bound their rows, so collecting is safe."""
    data = [json.loads(x) for x in rows.select(F.to_json(F.struct(*(F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes)), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    return {"data": data, "meta": {"mode": mode, "release_id": release_id, "metric_version": "1", "filters": filters}}


def write_csv(rows: DataFrame, path: str) -> None:
    """One headed CSV file of a bounded template."""
    rows.coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def write_static(store: PublicStore, folder: str, release_id: str) -> list[str]:
    """Every public template's rows below a new folder, for delivery without an engine: a JSON document each, and the downloads as CSV."""
    spark = store.overview.sparkSession
    documents = {"status": (store.status(), {}), "definitions": (store.definition_rows(), {})}
    for w in store.cutoffs:
        documents[f"{w}/overview"] = (store.overview_row(w), {"label_window": w})
        documents[f"{w}/cohorts"] = (store.cohort_rows(w, 240), {"label_window": w})
        for d in ("engagement", *DIMENSIONS):
            documents[f"{w}/segments-{d}"] = (store.segment_rows(w, d, 50), {"label_window": w, "dimension": d})
    for name, (rows, filters) in documents.items():
        write_report(spark, envelope(rows, "public", release_id, **filters), f"{folder}/{name}.json")
    exports = [(w, resource) for w in store.cutoffs for resource in ("overview", "cohorts", "segments")]
    for w, resource in exports:
        write_csv(store.export(resource, w), f"{folder}/{w}/{resource}.csv")
    return [*(f"{name}.json" for name in documents), *(f"{w}/{resource}.csv" for w, resource in exports)]

"""All relations of an input folder: computed when asked for, or built once and read back."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.contracts import DEFAULT, Settings, windows_frame
from tenura.operators import checks, curve, evaluation, facts, features, promote, release
from tenura.operators.publish import Publication
from tenura.operators.scratch import shared_folder, written
from tenura.plans import bi, marts, serve
from tenura.sources import driver_tables

#: Part of the fingerprint of a built warehouse: another version is built anew.
VERSION = "3"
#: The same of its model and curve.
MODEL_VERSION = "1"
SOURCES = ("customer", "orders", "events")


@dataclass
class Warehouse:
    """All relations of one input folder, lazily."""

    spark: SparkSession
    sf_dir: str
    settings: Settings = field(default=DEFAULT)

    @cached_property
    def windows(self) -> DataFrame:
        return windows_frame(self.spark, self.settings)

    @cached_property
    def members(self) -> DataFrame:
        return driver_tables.members(self.spark, self.sf_dir)

    @cached_property
    def raw_transactions(self) -> DataFrame:
        return driver_tables.raw_transactions(self.spark, self.sf_dir)

    @cached_property
    def transactions(self) -> DataFrame:
        return facts.dedup_transactions(self.raw_transactions)

    @cached_property
    def listening(self) -> DataFrame:
        return driver_tables.raw_listening(self.spark, self.sf_dir, self.settings)

    @cached_property
    def gaps(self) -> DataFrame:
        return features.renewal_gaps(self.transactions, self.windows, self.settings.renewal_gap_days)

    @cached_property
    def labels(self) -> DataFrame:
        return self.gaps.select("subscriber_token", "label_window", "is_churn")

    @cached_property
    def cutoffs(self) -> DataFrame:
        return features.subscriber_cutoffs(self.labels, self.windows)

    @cached_property
    def subscription(self) -> DataFrame:
        return features.subscription_features(self.transactions, self.windows)

    @cached_property
    def activity(self) -> DataFrame:
        cutoffs = sorted(w.history_cutoff for w in self.settings.windows)
        return features.listening_features(self.listening, self.windows, (cutoffs[0], cutoffs[-1]))

    @cached_property
    def snapshot(self) -> DataFrame:
        return features.snapshot(self.cutoffs, self.members, self.subscription, self.activity)

    @cached_property
    def stored_snapshot(self) -> DataFrame:
        """The snapshot written once, for jobs that read it several times."""
        return written(self.snapshot)

    @cached_property
    def overview(self) -> DataFrame:
        return marts.retention_overview(self.snapshot)

    @cached_property
    def cohorts(self) -> DataFrame:
        return marts.renewal_cohort(self.snapshot)

    @cached_property
    def engagement(self) -> DataFrame:
        return marts.engagement_mart(self.snapshot)

    @cached_property
    def segments(self) -> DataFrame:
        return marts.subscription_segment(self.snapshot)

    @cached_property
    def definitions(self) -> DataFrame:
        return marts.metric_definition(self.spark)

    def public(self, mart: DataFrame) -> DataFrame:
        return marts.public(mart, self.settings.minimum_group)

    @cached_property
    def review(self) -> DataFrame:
        return marts.review_population(self.snapshot, self.settings.review_subscribers)

    @cached_property
    def review_transactions(self) -> DataFrame:
        # whole subscribers are kept, so that their events' order is the same; only these are shuffled
        own = self.transactions.join(F.broadcast(self.review.select("subscriber_token").distinct()), "subscriber_token", "left_semi")
        return marts.review_transactions(self.review, features.sequenced(own), self.settings.review_events)

    @cached_property
    def review_listening(self) -> DataFrame:
        return marts.review_listening(self.review, self.listening)

    @property
    def first(self) -> str:
        return self.settings.windows[0].label_window

    @property
    def last(self) -> str:
        return self.settings.windows[-1].label_window

    @cached_property
    def store(self) -> serve.PublicStore:
        return serve.PublicStore(self.overview, self.public(self.cohorts), self.public(self.engagement), self.public(self.segments), self.definitions, {w.label_window: w.history_cutoff for w in self.settings.windows})

    @cached_property
    def private(self) -> serve.PrivateStore:
        return serve.PrivateStore(self.overview, self.cohorts, self.engagement, self.segments, self.definitions, {w.label_window: w.history_cutoff for w in self.settings.windows}, self.review, self.review_transactions, self.review_listening)

    @cached_property
    def star(self) -> dict[str, DataFrame]:
        return bi.star(self.overview, self.cohorts, self.engagement, self.segments, self.definitions)

    @cached_property
    def features(self) -> DataFrame:
        return evaluation.features(self.snapshot, self.last, self.first)

    @cached_property
    def model_rows(self) -> tuple[DataFrame, DataFrame]:
        """The first window's rows that models are fitted on, and those they are calibrated on."""
        s = self.settings
        rows = written(evaluation.features(self.snapshot, self.first, self.first).filter(F.col("bucket").isin(*s.fit_buckets, *s.calibration_buckets)))
        return rows.filter(F.col("bucket").isin(*s.fit_buckets)), rows.filter(F.col("bucket").isin(*s.calibration_buckets))

    def fitted(self, kind: str) -> evaluation.ChurnModel:
        return evaluation.fit(*self.model_rows, kind)

    @cached_property
    def model(self) -> evaluation.ChurnModel:
        """The model whose scores are published."""
        return self.fitted(self.settings.score_model)

    @cached_property
    def scores(self) -> DataFrame:
        """tie_breaker, y, p, receipts and is_repeat_subscriber of the last window's rows, by the model."""
        rows = self.model.score(self.features).withColumns({"y": F.col("is_churn"), "receipts": F.col("latest_actual_amount_paid")})
        return rows.select("tie_breaker", "y", "p", "receipts", "is_repeat_subscriber")

    @cached_property
    def curve(self) -> DataFrame:
        """The curve of the model's scores."""
        return curve.score_curve(self.scores.filter("is_repeat_subscriber = 1"), self.settings.group_size)

    @cached_property
    def check_scored(self) -> DataFrame:
        """The features with a score that SQL can give too: only for checks of metrics and curve arithmetic, never published."""
        part = F.conv(F.substring("tie_breaker", 1, 8), 16, 10).cast("long") % 1000
        return self.features.withColumns({"p": 0.05 + 0.9 * (part / F.lit(1000.0)), "y": F.col("is_churn"), "receipts": F.col("latest_actual_amount_paid")})

    @cached_property
    def check_curve(self) -> DataFrame:
        return curve.score_curve(self.check_scored.filter("is_repeat_subscriber = 1"), self.settings.group_size)

    def released(self, table: str) -> DataFrame:
        source = {"member": self.members, "subscription_transaction": self.transactions, "churn_label": self.labels, "listening_day": self.listening}
        return release.released(table, source[table], release.publication_salt(self.spark, self.settings.release_salt))

    @cached_property
    def listener(self) -> str:
        """The first token of the review set that has activity in the last window."""
        rows = self.review_listening.filter(F.col("label_window") == self.last).agg(F.min(F.lower(F.hex("subscriber_token"))).alias("token")).first()
        return rows["token"] or "0" * 24

    @cached_property
    def token(self) -> str:
        """The token of the review set's first subscriber, for the journey templates."""
        row = self.private.subscribers(self.last, limit=1).select(F.lower(F.hex("subscriber_token"))).first()
        return row[0] if row else "0" * 24


#: Relations of a built warehouse, and the names of their folders.
TABLES = {
    "members": "dim_member", "transactions": "fact_subscription_transaction", "listening": "fact_listening_day", "gaps": "fact_renewal_gap", "snapshot": "subscriber_snapshot",
    "overview": "retention_overview", "cohorts": "renewal_cohort", "engagement": "engagement_segment", "segments": "subscription_segment", "definitions": "metric_definition",
    "review": "review_population", "review_transactions": "review_transactions", "review_listening": "review_listening",
}
PARTITIONS = {"fact_listening_day": ("source_version", "activity_month")}


def fingerprints(spark: SparkSession, sf_dir: str, settings: Settings) -> dict[str, str]:
    """tables: of the source files and all that decides on the tables; scores: of those, the model and the curve."""
    files = [f for name in SOURCES for f in promote.source_files(spark, f"{sf_dir}/{name}.parquet") + promote.source_files(spark, f"{sf_dir}/{name}.parquet/*")]
    own = {"score_model", "fit_buckets", "calibration_buckets", "group_size"}
    plain = {f.name: getattr(settings, f.name) for f in fields(settings) if f.name not in own}
    tables = promote.fingerprint(f"{VERSION}\n{sorted(plain.items(), key=str)}\n{sf_dir}", files)
    model = [MODEL_VERSION, *(getattr(settings, n) for n in sorted(own)), evaluation.Parameters()]
    return {"tables": tables, "scores": promote.fingerprint(f"{tables}\n{model}", [])}


def build(spark: SparkSession, sf_dir: str, output: str, settings: Settings = DEFAULT, scored: bool = True) -> dict:
    """A version with facts, snapshot, marts, review sets, model, scores and score curve, behind gates; unchanged sources are a no-op.

    Each table is written once and read back for those that follow from it. Where only
    the model or the curve changed, the new version uses the tables of the one before.
    Without scored, a version of new sources has the tables alone; the next scored build
    adds the rest in a version that uses them.
    """
    publication, marks = Publication(spark, output), fingerprints(spark, sf_dir, settings)
    before = publication.current()
    old = publication.manifest(before) if before else {"marks": {}}
    same = old["marks"].get("tables") == marks["tables"]
    if old["marks"] == marks or same and not scored:
        return {"status": "unchanged"} | old
    with publication.writing(marks["scores"]) as version:
        w, stage = Warehouse(spark, sf_dir, settings), publication.folder(version)
        if same:
            rows, places, uses = old["tables"], old["places"], sorted({p.split("/")[1] for p in old["places"].values()})
        else:
            rows, places, uses = {}, {folder: f"versions/{version}/{folder}" for folder in TABLES.values()}, []
        for name, folder in TABLES.items():
            if not same:
                rows[folder] = promote.counted_write(getattr(w, name), f"{stage}/{folder}", PARTITIONS.get(folder, ()))
            w.__dict__[name] = spark.read.parquet(f"{output}/{places[folder]}")
        require_sound(w, rows)
        rebuilt = [] if same else ["tables"]
        manifest = {"marks": marks if scored else {"tables": marks["tables"]}, "tables": rows, "places": places, "uses": uses, "rebuilt": rebuilt + ["scores"] * scored}
        if scored:
            manifest["model"] = write_scores(w, stage)
        publication.commit(version, manifest)
    publication.clean()
    return {"status": "built"} | manifest


def require_sound(w: Warehouse, rows: dict[str, int]) -> None:
    """A built warehouse has outcomes that add up, nothing from after a cutoff, and definitions."""
    checks.gate(checks.counted(("outcomes", checks.unreconciled(w.overview)), ("cutoff_safety", checks.unsafe(w.snapshot))))
    if rows["metric_definition"] == 0:
        raise ValueError("no metric is defined")


def write_scores(w: Warehouse, stage: str) -> dict:
    """Fit and save the model, score by what was saved, and write scores and curve; what the manifest says of the model."""
    w.model.save(w.spark, f"{stage}/churn_model")
    w.__dict__["model"] = evaluation.ChurnModel.load(w.spark, f"{stage}/churn_model")
    w.__dict__["features"] = written(w.features)
    rows = promote.counted_write(w.scores, f"{stage}/subscriber_score")
    w.__dict__["scores"] = w.spark.read.parquet(f"{stage}/subscriber_score")
    evaluation.require_scores(w.scores, w.features)
    curve.write_curve(w.curve, f"{stage}/score_curve.json")
    written_curve = curve.CachedCurve.read(w.spark, f"{stage}/score_curve.json")
    everyone = w.scores.filter("is_repeat_subscriber = 1").count()
    base = curve.Scenario(min(everyone, 50_000) if everyone >= w.settings.group_size else 0, 0.1, 0.5, 2.0, 0.12, 0.04)
    failed = [name for name, passed in curve.boundary_checks(written_curve, w.settings.group_size, base).items() if not passed]
    if failed or everyone != (written_curve.points["contacts"].max() if everyone else 0):
        raise ValueError(f"a curve of {everyone} subscribers fails {failed}")
    return {"kind": w.model.kind, "asked": w.settings.score_model, "scored_rows": rows, "window": w.last}


_fitted: dict[tuple[str, str, str], evaluation.ChurnModel] = {}


class StoredWarehouse(Warehouse):
    """Reads the current version of a built warehouse; what no folder holds is computed from what one does."""

    def __init__(self, spark: SparkSession, output: str, settings: Settings = DEFAULT, version: str | None = None):
        super().__init__(spark, output, settings)
        publication = Publication(spark, output)
        self.version = version or publication.current()
        self.folder, self.manifest = publication.folder(self.version), publication.manifest(self.version)
        for name, table in TABLES.items():
            self.__dict__[name] = spark.read.parquet(f"{output}/{self.manifest['places'][table]}")

    @cached_property
    def model(self) -> evaluation.ChurnModel:
        return evaluation.ChurnModel.load(self.spark, f"{self.folder}/churn_model")

    def fitted(self, kind: str) -> evaluation.ChurnModel:
        """A model of this version's rows, fitted once in an application."""
        key = (self.spark.sparkContext.applicationId, self.folder, kind)
        if key not in _fitted:
            _fitted[key] = super().fitted(kind)
        return _fitted[key]

    @cached_property
    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/subscriber_score")

    @cached_property
    def curve(self) -> DataFrame:
        return self.spark.read.schema(curve.CURVE_SCHEMA).json(f"{self.folder}/score_curve.json")

    @cached_property
    def cached_curve(self) -> curve.CachedCurve:
        return curve.CachedCurve.of(self.curve)


def home(spark: SparkSession, sf_dir: str) -> str:
    """Where the warehouse of an input folder is built unless another place is given."""
    return f"{shared_folder(spark)}/warehouse/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def opened(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT, scored: bool = True) -> StoredWarehouse:
    """The built warehouse of an input folder, built first where it is missing or its sources have changed; model and curve only for what reads them."""
    folder = home(spark, sf_dir)
    build(spark, sf_dir, folder, settings, scored)
    return StoredWarehouse(spark, folder, settings)

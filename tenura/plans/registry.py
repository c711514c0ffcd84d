"""Every registered query: a Spark job, the columns that it shows, and SQL for another engine where that can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenura.contracts import DEFAULT
from tenura.operators import bytescan, checks, curve, evaluation, facts, features, movement, quantiles, release
from tenura.operators.scratch import scratch, written
from tenura.plans import bi, oracle, serve, warehouse
from tenura.plans.warehouse import Warehouse
from tenura.streaming import deliveries, event_windows

_CASTS = {
    "i": lambda c: F.col(c).cast("bigint"), "f": lambda c: F.col(c).cast("double"), "r": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "s": lambda c: F.col(c).cast("string"),
    "d": lambda c: F.date_format(c, "yyyy-MM-dd"), "b": lambda c: F.col(c).cast("boolean"), "t": lambda c: F.lower(F.hex(c)),
}


def shown(df: DataFrame, columns: str) -> DataFrame:
    """df's columns in portable types: long, double, rounded double, string, date as text, boolean, token as hex."""
    return df.select(*(_CASTS[k](c).alias(c) for c, k in (x.split(":") for x in columns.split())))


@dataclass(frozen=True)
class Query:
    """A job over the warehouse of an input folder: over the built one where it only serves what a build holds, with model and curve where it reads those."""

    build: Callable[[Warehouse], DataFrame]
    columns: str
    sql: str | None = None
    stored: bool = False
    scored: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        w = warehouse.opened(spark, sf_dir, scored=self.scored) if self.stored else Warehouse(spark, sf_dir)
        return shown(self.build(w), self.columns)


KEYS = "subscriber_token:t label_window:s"
OUTCOME = "eligible_subscribers:i observed_renewed_subscribers:i observed_churned_subscribers:i"
RATES = "observed_renewal_rate:f observed_churn_rate:f"
EVENT = "payment_method_id:i payment_plan_days:i plan_list_price:i actual_amount_paid:i is_auto_renew:i transaction_date:d membership_expire_date:d is_cancel:i"
DAY = "num_25:i num_50:i num_75:i num_985:i num_100:i num_unq:i total_secs:f total_secs_was_negative:b source_version:s"
LATEST = "latest_payment_method_id:i latest_payment_plan_days:i latest_plan_list_price:i latest_actual_amount_paid:i latest_is_auto_renew:i latest_is_cancel:i effective_expiration_date:d"
SUBSCRIPTION = " ".join(f"{c}:i" for c in features.SUBSCRIPTION_COUNTS) + f" latest_transaction_date:d {LATEST}"
ACTIVITY = " ".join(f"{c}:{'f' if 'seconds' in c else 'i'}" for c in features.LISTENING_COUNTS) + " latest_activity_date:d"
WINDOW = "history_cutoff:d expiration_window_start:d expiration_window_end:d renewal_observation_end:d"
SNAPSHOT = f"{KEYS} {WINDOW} is_churn:i observed_renewed_within_30_days:i registration_date:d registration_cohort_month:d tenure_days:i registration_method_code:i city_code:i age_reported:i gender:s {SUBSCRIPTION} is_active_at_cutoff:b {ACTIVITY} engagement_segment:s"
OVERVIEW = f"label_window:s history_cutoff:d {OUTCOME} active_subscribers:i {RATES} gross_receipts_lifetime:i gross_receipts_30d:i gross_receipts_90d:i subscription_event_count_lifetime:i cancellation_event_count_lifetime:i cancellation_event_rate:f listening_active_days_30d:i listening_active_days_90d:i full_completion_count_30d:i negative_duration_rows_90d:i"
COHORT = f"label_window:s registration_cohort_month:d {OUTCOME} {RATES} gross_receipts_90d:i"
ENGAGEMENT = f"label_window:s engagement_segment:s {OUTCOME} observed_churn_rate:f average_listening_active_days_30d:f average_listening_seconds_30d:f full_completion_count_30d:i"
SEGMENT = f"label_window:s dimension:s segment_key:s segment_label:s {OUTCOME} {RATES} gross_receipts_90d:i"
DEFINITION = "metric_id:s definition:s grain:s direction:s limitation:s"
PROFILE = "source_rows:i subscribers:i first_date:d last_date:d null_cells:i"
VIOLATIONS = "check_id:s violations:i"
FEATURES = " ".join(f"{c}:{'r' if c.startswith('log_') else 'i'}" for c in (*evaluation.NUMERIC, *evaluation.CATEGORICAL, "is_churn", "bucket", *evaluation.DIAGNOSTICS)) + " tie_breaker:s"
W1, W2 = DEFAULT.windows[0].label_window, DEFAULT.windows[-1].label_window
TOKEN_1 = f"(SELECT subscriber_token FROM review WHERE label_window = '{W2}' ORDER BY gross_receipts_90d DESC, subscriber_token LIMIT 1)"
REQUEST = curve.Scenario(capacity=500, minimum_score=0.3, contact_cost=120.0, offer_cost=900.0, assumed_lift=0.2, lift_uncertainty=0.1)


def _violations(*checks_: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_id, count(*) AS violations FROM ({body}) v{k}" for k, (n, body) in enumerate(checks_))


def _same(w: Warehouse) -> DataFrame:
    return features.sequenced(w.transactions)


def _unique(df: DataFrame, *keys: str) -> DataFrame:
    return checks.repeated_keys(df, list(keys))


def _scores(w: Warehouse, kind: str) -> DataFrame:
    """Scores by a model that was saved and loaded again."""
    folder = f"{scratch(w.spark)}/models/{uuid.uuid4().hex}"
    w.fitted(kind).save(w.spark, folder)
    return evaluation.ChurnModel.load(w.spark, folder).score(w.features).select("tie_breaker", F.col("is_churn").alias("y"), "p")


def _both(w: Warehouse) -> DataFrame:
    """The test rows with the scores of the challenger (p) and of the logistic baseline (base)."""
    base, challenger = w.fitted("logistic"), w.fitted("boosted")
    return written(challenger.score(base.score(w.features).withColumnRenamed("p", "base")).withColumn("y", F.col("is_churn")))


def _decision(w: Warehouse) -> DataFrame:
    """Which model ships, and for whom: the challenger's gates on all and on repeat subscribers, and the newcomers' calibration."""
    rows, found = _both(w), []
    parts = {"all": rows, "repeat": rows.filter("is_repeat_subscriber = 1"), "new": rows.filter("is_repeat_subscriber = 0")}
    for scope, part in parts.items():
        if part.isEmpty():
            found.append((scope, False, None, None))
            continue
        own, base = evaluation.metric_set(part).first(), evaluation.metric_set(part.withColumn("p", F.col("base"))).first()
        intervals = {r["measure"]: r["low"] for r in evaluation.bootstrap(part).collect()} if scope != "new" else {}
        better = (base["log_loss"] - own["log_loss"]) / base["log_loss"]
        limits = (intervals.get("relative_log_loss_improvement"), own["expected_calibration_error"], own["top_decile_lift"], intervals.get("challenger_top_decile_lift"))
        found.append((scope, None not in limits and evaluation.ships(better, *limits), better, own["expected_calibration_error"]))
    decision = evaluation.decision(found[0][1], found[1][1], found[2][3] or 0.0)
    return w.spark.createDataFrame([(*r, decision) for r in found], "scope string, gate_passed boolean, relative_log_loss_improvement double, challenger_ece double, decision string")


def _last_point(w: Warehouse) -> DataFrame:
    """Totals of the published curve, which no score can move."""
    points = ("contacts", "observed_churners", "selected_payment_proxy")
    return w.curve.agg(*(F.max_by(c, "contacts").alias(c) for c in points))


def _built(w: Warehouse) -> DataFrame:
    """Rows of each table of the built warehouse."""
    return checks.counted(*((folder, getattr(w, name)) for name, folder in warehouse.TABLES.items())).withColumnsRenamed({"check_id": "table_name", "violations": "rows"})


def _cached_scenario(w: Warehouse, cached: curve.CachedCurve) -> DataFrame:
    """The scenario by a curve in memory, without a job of its own."""
    return w.spark.createDataFrame(cached.outcomes(REQUEST.validated(10**9, w.settings.group_size)), CASE_SCHEMA)


def _shuffled(w: Warehouse) -> DataFrame:
    """Members in the order of a hash of their token, the same for each run."""
    rows = w.members.select("subscriber_token", F.sha2(F.hex("subscriber_token"), 256).alias("order"))
    return curve.prefix_sums(rows, [F.col("order").asc(), F.col("subscriber_token").asc()], {}, "place").select("subscriber_token", "place")


def _timings(w: Warehouse) -> DataFrame:
    """Median and nearest-rank 95th percentile of the values of each kind of event, exact; no task holds a kind's values."""
    events = w.spark.read.parquet(f"{w.sf_dir}/events.parquet")
    found = quantiles.exact_quantiles(events, ["event_type"], "value", {"median_value": quantiles.MEDIAN, "p95_value": quantiles.Quantile("0.95", True)})
    return found.withColumnRenamed("values", "events")


def _scanned_release(w: Warehouse) -> DataFrame:
    """Members' tokens and private names in the bytes of a release, written for the scan without compression."""
    folder = f"{scratch(w.spark)}/releases/{uuid.uuid4().hex}"
    for table in release.COLUMNS:
        w.released(table).write.option("compression", "none").parquet(f"{folder}/{table}")
    found = bytescan.scanned(w.spark, folder, frozenset({"subscriber_token", "msno", "age_reported"}), w.members.select("subscriber_token"))
    return checks.counted(("real_tokens", found.filter("kind = 'token'")), ("private_names", found.filter("kind = 'name'")))


def _empty_branch(w: Warehouse) -> DataFrame:
    """Members, and a branch that a constant condition switches off: it is pruned from the plan."""
    rows = w.members.select("subscriber_token", "gender", F.lit("member").alias("origin"))
    return rows.unionByName(w.labels.filter(F.lit(False)).select("subscriber_token", F.lit(None).cast("string").alias("gender"), F.lit("label").alias("origin")))


def _subgroup_sql() -> str:
    union = " UNION ALL ".join(f"SELECT '{d}' AS diagnostic, {d} AS group_code, y, p FROM scored" for d in evaluation.DIAGNOSTICS)
    loss = "-avg(CASE y WHEN 1 THEN ln(p) ELSE ln(1 - p) END)"
    ece = f"SELECT diagnostic, group_code, sum(abs(ys - ps)) / sum(n) AS expected_calibration_error FROM (SELECT diagnostic, group_code, {_BIN} AS bin, count(*) AS n, sum(y) AS ys, sum(p) AS ps FROM ({union}) u GROUP BY 1, 2, 3) GROUP BY 1, 2"
    return f"SELECT * FROM (SELECT diagnostic, group_code, count(*) AS rows, avg(y) AS churn_rate, {loss} AS log_loss, avg(p) AS average_probability FROM ({union}) u GROUP BY 1, 2 HAVING count(*) >= 100) JOIN ({ece}) USING (diagnostic, group_code)"


_BIN = " + ".join(f"CAST(p >= {float(e)!r} AS INTEGER)" for e in evaluation.np.linspace(0.0, 1.0, 11)[1:-1])


def _prevalence_sql() -> str:
    fit = f"SELECT avg(is_churn) AS p FROM snap WHERE label_window = '{W1}' AND CAST('0x' || left(hex(subscriber_token), 8) AS BIGINT) % 10 IN ({', '.join(map(str, DEFAULT.fit_buckets))})"
    return f"""SELECT rows, churn_rate, -(churn_rate * ln(p) + (1 - churn_rate) * ln(1 - p)) AS log_loss, p AS average_probability, abs(churn_rate - p) AS expected_calibration_error,
        top_decile_rows, top_decile_churn_rate, top_decile_churn_rate / churn_rate AS top_decile_lift FROM ({fit}) f, (SELECT count(*) AS rows, avg(is_churn) AS churn_rate FROM feat) a,
        (SELECT count(*) AS top_decile_rows, avg(is_churn) AS top_decile_churn_rate FROM (SELECT is_churn, row_number() OVER (ORDER BY tie_breaker) AS place, count(*) OVER () AS everyone FROM feat)
        WHERE place <= greatest(1, ceil(everyone * 0.1))) t"""


def _movement_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{k}' AS kind, '{d}' AS direction, b.{m}::DOUBLE AS comparison_value, a.{m}::DOUBLE AS current_value FROM overview a, overview b WHERE a.label_window = '{W2}' AND b.label_window = '{W1}'" for m, k, d in movement.MOVEMENTS)
    shown_ = "CASE kind WHEN 'rate' THEN round((current_value - comparison_value) * 100, 1) ELSE current_value - comparison_value END"
    return f"""SELECT *, CASE WHEN direction = 'context' OR shown_delta = 0 THEN 'context' WHEN (direction = 'higher') = (shown_delta > 0) THEN 'favorable' ELSE 'adverse' END AS tone FROM (
        SELECT *, current_value - comparison_value AS delta, {shown_} AS shown_delta, round(ifnull((current_value - comparison_value) / nullif(abs(comparison_value), 0), 0) * 100, 1) AS relative_percent FROM ({rows}) m) n"""


def _breaks_sql(mart: str, keys: str, order: str, small: bool) -> str:
    flag = f", least(a.eligible_subscribers, b.eligible_subscribers) < {DEFAULT.minimum_group} AS small_group" if small else ""
    return f"""SELECT {keys}, a.eligible_subscribers AS current_eligible, a.observed_churn_rate AS current_churn_rate, b.eligible_subscribers AS comparison_eligible, b.observed_churn_rate AS comparison_churn_rate,
        round((a.observed_churn_rate - b.observed_churn_rate) * 100, 1) AS change_pp{flag} FROM {mart} a JOIN {mart} b USING ({keys}) WHERE a.label_window = '{W2}' AND b.label_window = '{W1}' ORDER BY {order} LIMIT 7"""


def _scenario_sql() -> str:
    r = REQUEST
    cases = f"(VALUES ('low', {max(0.0, r.assumed_lift - r.lift_uncertainty)!r}::DOUBLE), ('expected', {r.assumed_lift!r}::DOUBLE), ('high', {min(1.0, r.assumed_lift + r.lift_uncertainty)!r}::DOUBLE)) c(case_name, assumed_lift)"
    point = f"SELECT * FROM points WHERE contacts <= {r.capacity} AND minimum_score >= {r.minimum_score} ORDER BY contacts DESC LIMIT 1"
    cost = f"contacts * {r.contact_cost + r.offer_cost}"
    return f"""SELECT case_name, assumed_lift, contacts, minimum_score, observed_churners, round(expected_churners, 4) * assumed_lift AS simulated_retained_subscribers,
        round(risk_weighted_payment_proxy, 2) * assumed_lift AS simulated_retained_gross_receipt_proxy, contacts * {r.contact_cost} AS contact_spend, contacts * {r.offer_cost} AS offer_spend, {cost} AS total_spend,
        round(risk_weighted_payment_proxy, 2) * assumed_lift - {cost} AS simulated_net_value, (round(risk_weighted_payment_proxy, 2) * assumed_lift - {cost}) / ({cost}) AS simulated_roi,
        {cost} / round(risk_weighted_payment_proxy, 2) AS break_even_lift, {cost} / round(risk_weighted_payment_proxy, 2) <= 1 AS break_even_feasible, observed_churners::DOUBLE / contacts AS observed_churn_rate,
        round(expected_churners, 4) / (SELECT round(max(expected_churners), 4) FROM points) AS modeled_risk_capture, contacts / {float(r.capacity)} AS capacity_utilization, everyone AS eligible_subscribers FROM ({point}) p, {cases}"""


_MEASURE_COLUMNS = "renewal_rate:f churn_rate:f"
_SUMS = "sum(observed_renewed_subscribers)::DOUBLE / sum(eligible_subscribers) AS renewal_rate, sum(observed_churned_subscribers)::DOUBLE / sum(eligible_subscribers) AS churn_rate"
_GROUP = ", ".join(f"sum({c}) AS {c}" for c in bi.GROUP)
_DAY_KEYS = "subscriber_token:t activity_date:d"
_STATS = "count(*) AS listening_rows, count(DISTINCT (subscriber_token, activity_date)) AS distinct_days, 0 AS invalid_rows, sum(CAST(total_secs_was_negative AS INTEGER)) AS negative_rows, sum(total_secs) AS total_secs, min(activity_date) AS first_date, max(activity_date) AS last_date"
_STATS_COLUMNS = "listening_rows:i distinct_days:i invalid_rows:i negative_rows:i total_secs:f first_date:d last_date:d"

_POINT = "contacts:i minimum_score:r expected_churners:r observed_churners:i risk_weighted_payment_proxy:f selected_payment_proxy:f"
#: Columns of a scenario's cases.
_CASE = (
    "case_name:s assumed_lift:r contacts:i minimum_score:r observed_churners:i simulated_retained_subscribers:r simulated_retained_gross_receipt_proxy:r "
    "contact_spend:r offer_spend:r total_spend:r simulated_net_value:r simulated_roi:r "
    "break_even_lift:r break_even_feasible:b observed_churn_rate:r modeled_risk_capture:r capacity_utilization:r eligible_subscribers:i"
)
_KINDS = {"s": "string", "i": "long", "r": "double", "b": "boolean"}
CASE_SCHEMA = ", ".join(f"{n} {_KINDS[k]}" for n, k in (x.split(":") for x in _CASE.split()))
_BUILT_VIEWS = {
    "dim_member": "member", "fact_subscription_transaction": "tx", "fact_listening_day": "day", "fact_renewal_gap": "gaps", "subscriber_snapshot": "snap", "retention_overview": "overview",
    "renewal_cohort": "cohort", "engagement_segment": "engagement", "subscription_segment": "segment", "metric_definition": "definition", "review_population": "review",
    "review_transactions": "reviewtx", "review_listening": "reviewday",
}

QUERIES: dict[str, Query] = {
    "retention_overview": Query(lambda w: w.overview, OVERVIEW, "SELECT * FROM overview"),
    "member_canonical": Query(lambda w: w.members, "subscriber_token:t city_code:i age_reported:i gender:s registration_method_code:i registration_date:d", "SELECT * FROM member"),
    "transaction_canonical": Query(lambda w: w.raw_transactions, f"subscriber_token:t {EVENT} source_version:s", "SELECT * FROM rawtx"),
    "listening_canonical": Query(lambda w: w.listening, f"{_DAY_KEYS} {DAY} activity_month:i", "SELECT * FROM day"),
    "label_canonical": Query(lambda w: w.labels, f"{KEYS} is_churn:i", "SELECT * FROM gaps"),
    "transaction_dedup_lineage": Query(lambda w: w.transactions, f"event_key:t subscriber_token:t {EVENT} source_versions:s", "SELECT * FROM tx"),
    "streamed_deliveries": Query(
        lambda w: deliveries.replayed(w.raw_transactions, f"{scratch(w.spark)}/deliveries/{uuid.uuid4().hex}").events(),
        f"event_key:t subscriber_token:t {EVENT} source_versions:s", "SELECT * FROM tx"),
    "dedup_control_totals": Query(
        lambda w: facts.dedup_controls(w.raw_transactions),
        "source_rows:i accepted_rows:i removed_rows:i within_version_removed:i cross_version_events:i accepted_amount:i first_date:d last_date:d",
        f"""SELECT (SELECT count(*) FROM rawtx) AS source_rows, count(*) AS accepted_rows, (SELECT count(*) FROM rawtx) - count(*) AS removed_rows,
        (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM rawtx GROUP BY {oracle.EVENT}, source_version)) AS within_version_removed, sum(CAST(source_versions = 'v1+v2' AS INTEGER)) AS cross_version_events,
        sum(actual_amount_paid) AS accepted_amount, min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM tx"""),
    "source_profile": Query(lambda w: facts.profile(w.raw_transactions, "subscriber_token", "transaction_date"), PROFILE,
        "SELECT count(*) AS source_rows, count(DISTINCT subscriber_token) AS subscribers, min(transaction_date) AS first_date, max(transaction_date) AS last_date, 0 AS null_cells FROM rawtx"),
    "source_profile_approx": Query(lambda w: facts.profile(w.raw_transactions, "subscriber_token", "transaction_date", True), PROFILE),
    "churn_from_renewal_gap": Query(lambda w: w.gaps, f"{KEYS} expiration_date:d next_payment_date:d gap_days:s is_churn:i", "SELECT * FROM gaps"),
    "same_day_sequence": Query(_same, f"event_key:t subscriber_token:t {EVENT} source_versions:s same_day_sequence:i", "SELECT * FROM seq"),
    "latest_event_as_of_cutoff": Query(lambda w: w.subscription, f"{KEYS} latest_transaction_date:d {LATEST}", "SELECT * FROM subf"),
    "subscriber_cutoffs": Query(lambda w: w.cutoffs, f"{KEYS} {WINDOW} is_churn:i", "SELECT * FROM cuts"),
    "subscription_features": Query(lambda w: w.subscription, f"{KEYS} {SUBSCRIPTION}", "SELECT * FROM subf"),
    "listening_features": Query(lambda w: w.activity, f"{KEYS} {ACTIVITY}", "SELECT * FROM actf"),
    "subscriber_snapshot": Query(lambda w: w.snapshot, SNAPSHOT, "SELECT * FROM snap"),
    "renewal_cohort": Query(lambda w: w.cohorts, COHORT, "SELECT * FROM cohort"),
    "engagement_segment": Query(lambda w: w.engagement, ENGAGEMENT, "SELECT * FROM engagement"),
    "subscription_segment": Query(lambda w: w.segments, SEGMENT, "SELECT * FROM segment"),
    "public_retention_overview": Query(lambda w: w.store.overview, OVERVIEW, "SELECT * FROM overview"),
    "public_renewal_cohort": Query(lambda w: w.store.cohorts, COHORT, "SELECT * FROM pcohort"),
    "public_engagement_segment": Query(lambda w: w.store.engagement, ENGAGEMENT, "SELECT * FROM pengagement"),
    "public_subscription_segment": Query(lambda w: w.store.segments, SEGMENT, "SELECT * FROM psegment"),
    "metric_definition": Query(lambda w: w.definitions, DEFINITION, "SELECT * FROM definition"),
    "review_population": Query(lambda w: w.review, SNAPSHOT, "SELECT * FROM review"),
    "review_transactions": Query(
        lambda w: w.review_transactions,
        (f"{KEYS} transaction_date:d membership_expire_date:d payment_method_id:i payment_plan_days:i actual_amount_paid:i is_auto_renew:i is_cancel:i "
            f"same_day_sequence:i"),
        "SELECT * FROM reviewtx"),
    "review_listening_monthly": Query(lambda w: w.review_listening, f"{KEYS} activity_month:d active_days:i listening_seconds:f unique_track_count:i", "SELECT * FROM reviewday"),
    "api_status": Query(lambda w: w.store.status(), "label_window:s history_cutoff:d eligible_subscribers:i", "SELECT * FROM overview"),
    "api_overview": Query(lambda w: w.store.overview_row(w.last), OVERVIEW, f"SELECT * FROM overview WHERE label_window = '{W2}'"),
    "api_cohorts": Query(lambda w: w.store.cohort_rows(w.last, 12), COHORT, f"SELECT * FROM pcohort WHERE label_window = '{W2}' ORDER BY registration_cohort_month DESC LIMIT 12"),
    "api_cohorts_private": Query(lambda w: w.private.cohort_rows(w.last, 48), COHORT, f"SELECT * FROM cohort WHERE label_window = '{W2}' ORDER BY registration_cohort_month DESC LIMIT 48"),
    "api_segments_engagement": Query(lambda w: w.private.segment_rows(w.last), ENGAGEMENT, f"SELECT * FROM engagement WHERE label_window = '{W2}'"),
    **{f"api_segments_{d}": Query(lambda w, d=d: w.store.segment_rows(w.last, d, 16), SEGMENT, f"SELECT * FROM psegment WHERE label_window = '{W2}' AND dimension = '{d}' ORDER BY eligible_subscribers DESC, segment_key LIMIT 16") for d in serve.DIMENSIONS},
    "api_definitions": Query(lambda w: w.store.definition_rows(), DEFINITION, "SELECT * FROM definition"),
    "api_export_overview": Query(lambda w: w.store.export("overview", w.first), OVERVIEW, f"SELECT * FROM overview WHERE label_window = '{W1}'"),
    "api_export_cohorts": Query(lambda w: w.store.export("cohorts", w.first), COHORT, f"SELECT * FROM pcohort WHERE label_window = '{W1}'"),
    "api_export_segments": Query(lambda w: w.store.export("segments", w.first), SEGMENT, f"SELECT * FROM psegment WHERE label_window = '{W1}'"),
    "api_subscribers": Query(
        lambda w: w.private.subscribers(w.last, "Dormant", "churned", 20),
        (f"{KEYS} is_churn:i is_active_at_cutoff:b effective_expiration_date:d engagement_segment:s gross_receipts_90d:i listening_active_days_30d:i "
            f"latest_payment_plan_days:i latest_is_auto_renew:i"),
        f"""SELECT *
            FROM review
            WHERE label_window = '{W2}' AND engagement_segment = 'Dormant' AND is_churn = 1
            ORDER BY gross_receipts_90d DESC, subscriber_token LIMIT 20"""),
    "api_journey_profile": Query(lambda w: w.private.profile(w.token, w.last), SNAPSHOT, f"SELECT * FROM review WHERE label_window = '{W2}' AND subscriber_token = {TOKEN_1}"),
    "api_journey_transactions": Query(
        lambda w: w.private.journey_transactions(w.token, w.last),
        f"{KEYS} transaction_date:d membership_expire_date:d payment_plan_days:i actual_amount_paid:i is_auto_renew:i is_cancel:i",
        f"SELECT * FROM reviewtx WHERE label_window = '{W2}' AND subscriber_token = {TOKEN_1}"),
    "api_journey_listening": Query(
        lambda w: w.private.journey_listening(w.listener, w.last),
        f"{KEYS} activity_month:d active_days:i listening_seconds:f unique_track_count:i",
        f"SELECT * FROM reviewday WHERE label_window = '{W2}' AND subscriber_token = (SELECT min(subscriber_token) FROM reviewday WHERE label_window = '{W2}')"),
    "dq_null_cells": Query(lambda w: checks.null_cells(w.snapshot, ["subscriber_token", "is_churn", "registration_date", "gender", "latest_activity_date"]), "column_name:s violations:i",
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS violations FROM snap" for c in ("subscriber_token", "is_churn", "registration_date", "gender", "latest_activity_date"))),
    "dq_unique": Query(
        lambda w: checks.counted(("member_token", _unique(w.members, "subscriber_token")), ("event_key", _unique(w.transactions, "event_key")), ("metric_id", _unique(w.definitions, "metric_id")), ("raw_event", _unique(w.raw_transactions, *facts.EVENT))),
        VIOLATIONS,
        _violations(("member_token", "SELECT 1 FROM member GROUP BY subscriber_token HAVING count(*) > 1"), ("event_key", "SELECT 1 FROM tx GROUP BY event_key HAVING count(*) > 1"), ("metric_id", "SELECT 1 FROM definition GROUP BY metric_id HAVING count(*) > 1"), ("raw_event", f"SELECT 1 FROM rawtx GROUP BY {oracle.EVENT} HAVING count(*) > 1"))),
    "dq_accepted_values": Query(
        lambda w: checks.counted(("window", checks.unaccepted(w.snapshot, "label_window", [w.first, w.last])), ("churn", checks.unaccepted(w.snapshot, "is_churn", [0, 1])), ("segment", checks.unaccepted(w.snapshot, "engagement_segment", list(w.settings.segments))), ("light_only", checks.unaccepted(w.snapshot, "engagement_segment", ["Light"]))),
        VIOLATIONS,
        _violations(("window", f"SELECT 1 FROM snap WHERE label_window NOT IN ('{W1}', '{W2}')"), ("churn", "SELECT 1 FROM snap WHERE is_churn NOT IN (0, 1)"), ("segment", "SELECT 1 FROM snap WHERE engagement_segment NOT IN ('Dormant', 'Light', 'Steady', 'High')"), ("light_only", "SELECT 1 FROM snap WHERE engagement_segment <> 'Light'"))),
    "dq_unique_combination": Query(
        lambda w: checks.counted(("snapshot", _unique(w.snapshot, "subscriber_token", "label_window")), ("cohort", _unique(w.cohorts, "label_window", "registration_cohort_month")), ("segment", _unique(w.segments, "label_window", "dimension", "segment_key")), ("token_only", _unique(w.snapshot, "subscriber_token"))),
        VIOLATIONS,
        _violations(("snapshot", "SELECT 1 FROM snap GROUP BY subscriber_token, label_window HAVING count(*) > 1"), ("cohort", "SELECT 1 FROM cohort GROUP BY label_window, registration_cohort_month HAVING count(*) > 1"), ("segment", "SELECT 1 FROM segment GROUP BY label_window, dimension, segment_key HAVING count(*) > 1"), ("token_only", "SELECT 1 FROM snap GROUP BY subscriber_token HAVING count(*) > 1"))),
    "dq_outcomes": Query(
        lambda w: checks.counted(("outcomes", checks.unreconciled(w.overview))),
        VIOLATIONS,
        _violations(("outcomes", "SELECT 1 FROM overview WHERE eligible_subscribers <> observed_renewed_subscribers + observed_churned_subscribers OR abs(observed_renewal_rate + observed_churn_rate - 1) > 1e-9"))),
    "dq_group_minimum": Query(
        lambda w: checks.small_groups({"cohort": w.cohorts, "engagement": w.engagement, "segment": w.segments}, {"cohort": ["label_window", "registration_cohort_month"], "engagement": ["label_window", "engagement_segment"], "segment": ["label_window", "dimension", "segment_key"]}, w.settings.minimum_group),
        "relation:s group_key:s eligible_subscribers:i",
        f"""SELECT 'cohort' AS relation, label_window || ':' || registration_cohort_month AS group_key, eligible_subscribers
            FROM cohort
            WHERE eligible_subscribers < {DEFAULT.minimum_group}
            UNION ALL SELECT 'engagement', label_window || ':' || engagement_segment, eligible_subscribers
            FROM engagement
            WHERE eligible_subscribers < {DEFAULT.minimum_group}
            UNION ALL SELECT 'segment', label_window || ':' || dimension || ':' || segment_key, eligible_subscribers
            FROM segment
            WHERE eligible_subscribers < {DEFAULT.minimum_group}"""),
    "dq_cutoff_safety": Query(
        lambda w: checks.counted(("after_cutoff", checks.unsafe(w.snapshot))),
        VIOLATIONS,
        _violations(("after_cutoff", "SELECT 1 FROM snap WHERE latest_transaction_date > history_cutoff OR latest_activity_date > history_cutoff"))),
    "dq_orphans": Query(
        lambda w: checks.counted(*((f"{f}.{k}", checks.orphans(w.star[f], w.star[d], [k])) for f, d, k in bi.RELATIONSHIPS), ("listening_without_payment", checks.orphans(w.listening, w.transactions, ["subscriber_token"]))),
        VIOLATIONS,
        " UNION ALL ".join([*(f"SELECT '{f}.{k}' AS check_id, 0 AS violations" for f, d, k in bi.RELATIONSHIPS), "SELECT 'listening_without_payment', count(*) FROM (SELECT DISTINCT subscriber_token FROM day WHERE subscriber_token NOT IN (SELECT subscriber_token FROM tx)) o"])),
    "dq_member_controls": Query(
        lambda w: facts.member_controls(w.members),
        "member_rows:i distinct_tokens:i null_tokens:i invalid_rows:i null_genders:i null_registrations:i",
        """SELECT count(*) AS member_rows, count(DISTINCT subscriber_token) AS distinct_tokens, count(*) - count(subscriber_token) AS null_tokens, sum(CASE WHEN city_code < 0 OR registration_method_code < 0 OR gender NOT IN ('female', 'male') THEN 1 ELSE 0 END) AS invalid_rows, count(*) - count(gender) AS null_genders, count(*) - count(registration_date) AS null_registrations
            FROM member"""),
    "dq_label_controls": Query(
        lambda w: facts.label_controls(w.labels),
        "label_window:s label_rows:i distinct_tokens:i invalid_rows:i churned:i",
        """SELECT label_window, count(*) AS label_rows, count(DISTINCT subscriber_token) AS distinct_tokens, 0 AS invalid_rows, sum(is_churn) AS churned
            FROM gaps
            GROUP BY 1"""),
    "dq_transaction_controls": Query(
        lambda w: facts.transaction_controls(w.transactions),
        "accepted_rows:i distinct_events:i invalid_rows:i",
        """SELECT count(*) AS accepted_rows, count(DISTINCT event_key) AS distinct_events, sum(CASE WHEN payment_method_id <= 0 OR payment_plan_days < 0 OR plan_list_price < 0 OR actual_amount_paid < 0 THEN 1 ELSE 0 END) AS invalid_rows
            FROM tx"""),
    "listening_controls_by_month": Query(
        lambda w: facts.listening_controls(w.listening),
        f"source_version:s activity_month:i {_STATS_COLUMNS}",
        f"SELECT source_version, activity_month, {_STATS} FROM day GROUP BY 1, 2"),
    "listening_controls_by_version": Query(
        lambda w: facts.listening_controls(w.listening, ("source_version",)),
        f"source_version:s {_STATS_COLUMNS}",
        f"SELECT source_version, {_STATS} FROM day GROUP BY 1"),
    "reconcile_overview": Query(lambda w: checks.reconciled(w.overview, w.labels, w.transactions, w.listening, w.windows), "label_window:s metric:s expected:f actual:f error:f",
        " UNION ALL ".join(f"SELECT label_window, '{m}' AS metric, {m} AS expected, {m} AS actual, 0 AS error FROM overview" for m in checks.RECONCILED)),
    "release_member": Query(lambda w: w.released("member"), "subscriber_key:s city_code:i age_band_start:s gender:s registration_method_code:i registration_month:d", "SELECT * FROM rel_member"),
    "release_transaction": Query(lambda w: w.released("subscription_transaction"), f"event_key:s subscriber_key:s {EVENT} source_versions:s", "SELECT * FROM rel_tx"),
    "release_label": Query(lambda w: w.released("churn_label"), "subscriber_key:s label_window:s is_churn:i", "SELECT * FROM rel_label"),
    "release_listening": Query(lambda w: w.released("listening_day"), f"subscriber_key:s activity_date:d {DAY}", "SELECT * FROM rel_day"),
    "release_verification": Query(
        lambda w: release.verification({t: w.released(t) for t in release.COLUMNS}, {"member": w.members, "subscription_transaction": w.transactions, "churn_label": w.labels, "listening_day": w.listening}),
        "table_name:s released_rows:i fact_rows:i null_keys:i repeated_keys:i",
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS released_rows, count(*) AS fact_rows, 0 AS null_keys, 0 AS repeated_keys FROM {r}" for n, r in (("member", "rel_member"), ("subscription_transaction", "rel_tx"), ("churn_label", "rel_label"), ("listening_day", "rel_day")))),
    "release_byte_scan": Query(
        _scanned_release, VIOLATIONS, " UNION ALL ".join(f"SELECT '{n}' AS check_id, 0 AS violations" for n in ("real_tokens", "private_names"))),
    "bi_dim_label_window": Query(lambda w: w.star["dim_label_window"], "label_window:s history_cutoff:d", "SELECT * FROM overview"),
    "bi_dim_registration_cohort": Query(
        lambda w: w.star["dim_registration_cohort"],
        "registration_cohort_key:s registration_cohort_month:d registration_cohort_label:s registration_cohort_sort:i",
        """SELECT DISTINCT strftime(registration_cohort_month, '%Y-%m-%d') AS registration_cohort_key, registration_cohort_month, strftime(registration_cohort_month, '%B %Y') AS registration_cohort_label, year(registration_cohort_month) * 100 + month(registration_cohort_month) AS registration_cohort_sort
            FROM cohort"""),
    "bi_dim_engagement_segment": Query(
        lambda w: w.star["dim_engagement_segment"],
        "engagement_segment:s engagement_segment_sort:i",
        "SELECT DISTINCT engagement_segment, list_position(['Dormant', 'Light', 'Steady', 'High'], engagement_segment) AS engagement_segment_sort FROM engagement"),
    "bi_dim_subscription_segment": Query(
        lambda w: w.star["dim_subscription_segment"],
        "subscription_segment_key:s dimension:s segment_key:s segment_label:s",
        "SELECT DISTINCT concat(dimension, ':', segment_key) AS subscription_segment_key, dimension, segment_key, segment_label FROM segment"),
    "bi_dim_metric_definition": Query(lambda w: w.star["dim_metric_definition"], DEFINITION, "SELECT * FROM definition"),
    "bi_fct_retention_overview": Query(lambda w: w.star["fct_retention_overview"], "label_window:s " + " ".join(f"{c}:i" for c in bi.OVERVIEW), "SELECT * FROM overview"),
    "bi_fct_renewal_cohort": Query(
        lambda w: w.star["fct_renewal_cohort"],
        f"label_window:s registration_cohort_key:s {OUTCOME} gross_receipts_90d:i",
        "SELECT *, strftime(registration_cohort_month, '%Y-%m-%d') AS registration_cohort_key FROM cohort"),
    "bi_fct_engagement_segment": Query(
        lambda w: w.star["fct_engagement_segment"],
        f"label_window:s engagement_segment:s {OUTCOME} average_listening_active_days_30d:f average_listening_seconds_30d:f full_completion_count_30d:i",
        "SELECT * FROM engagement"),
    "bi_fct_subscription_segment": Query(
        lambda w: w.star["fct_subscription_segment"],
        f"label_window:s subscription_segment_key:s {OUTCOME} gross_receipts_90d:i",
        "SELECT *, concat(dimension, ':', segment_key) AS subscription_segment_key FROM segment"),
    "bi_measures_overview": Query(
        lambda w: bi.overview_measures(w.star, ["label_window"]),
        "label_window:s " + " ".join(f"{c}:i" for c in bi.OVERVIEW) + f" {_MEASURE_COLUMNS} cancellation_event_rate:f",
        f"""SELECT label_window, {', '.join(f'sum({c}) AS {c}' for c in bi.OVERVIEW)}, {_SUMS}, any_value(cancellation_event_rate) AS cancellation_event_rate
            FROM overview
            GROUP BY 1"""),
    "bi_measures_without_window": Query(
        lambda w: bi.overview_measures(w.star, ["context"]),
        f"context:s eligible_subscribers:s {_MEASURE_COLUMNS}",
        "SELECT 'all' AS context, NULL AS eligible_subscribers, NULL AS renewal_rate, NULL AS churn_rate"),
    "bi_measures_cohort": Query(
        lambda w: bi.cohort_measures(w.star, ["label_window"]),
        f"label_window:s {OUTCOME} gross_receipts_90d:i {_MEASURE_COLUMNS}",
        f"SELECT label_window, {_GROUP}, sum(gross_receipts_90d) AS gross_receipts_90d, {_SUMS} FROM cohort GROUP BY 1"),
    "bi_measures_engagement": Query(
        lambda w: bi.engagement_measures(w.star, ["label_window"]),
        f"label_window:s {OUTCOME} full_completion_count_30d:i {_MEASURE_COLUMNS} average_listening_active_days_30d:r average_listening_seconds_30d:r",
        f"""SELECT label_window, {_GROUP}, sum(full_completion_count_30d) AS full_completion_count_30d, {_SUMS}, sum(average_listening_active_days_30d * eligible_subscribers) / sum(eligible_subscribers) AS average_listening_active_days_30d, sum(average_listening_seconds_30d * eligible_subscribers) / sum(eligible_subscribers) AS average_listening_seconds_30d
            FROM engagement
            GROUP BY 1"""),
    "bi_measures_subscription": Query(
        lambda w: bi.subscription_measures(w.star, ["label_window", "dimension"]),
        f"label_window:s dimension:s {OUTCOME} gross_receipts_90d:i {_MEASURE_COLUMNS}",
        f"SELECT label_window, dimension, {_GROUP}, sum(gross_receipts_90d) AS gross_receipts_90d, {_SUMS} FROM segment GROUP BY 1, 2"),
    "bi_controls": Query(
        lambda w: bi.controls(w.star, [w.first, w.last]),
        "control_id:s measure_id:s actual_value:i",
        " UNION ALL ".join(f"SELECT label_window || ':{n}' AS control_id, 'overview_{n}' AS measure_id, {c} AS actual_value FROM overview" for n, c in (("eligible", "eligible_subscribers"), ("renewed", "observed_renewed_subscribers"), ("churned", "observed_churned_subscribers"), ("gross_receipts_lifetime", "gross_receipts_lifetime")))),
    "bi_control_exchange": Query(
        lambda w: bi.exchanged_controls(w.star, [w.first, w.last], f"{scratch(w.spark)}/controls/{uuid.uuid4().hex}"),
        "control_id:s expected_value:f actual_value:f problem:s",
        " UNION ALL ".join(f"SELECT label_window || ':{n}' AS control_id, {c} AS expected_value, {c} AS actual_value, NULL AS problem FROM overview" for n, c in (("eligible", "eligible_subscribers"), ("renewed", "observed_renewed_subscribers"), ("churned", "observed_churned_subscribers"), ("gross_receipts_lifetime", "gross_receipts_lifetime")))),
    "reconcile_window_order": Query(
        lambda w: checks.placed(w.windows, w.overview, "history_cutoff", ["label_window", "history_cutoff"]),
        "position:i column_name:s expected:s actual:s",
        " UNION ALL ".join(f"SELECT row_number() OVER (ORDER BY o.history_cutoff) AS position, '{c}' AS column_name, CAST(win.{c} AS VARCHAR) AS expected, CAST(o.{c} AS VARCHAR) AS actual FROM overview o JOIN win USING (label_window)" for c in ("label_window", "history_cutoff"))),
    "curve_boundary_checks": Query(
        lambda w: w.spark.createDataFrame(sorted(curve.boundary_checks(curve.CachedCurve.of(w.check_curve), w.settings.group_size, REQUEST).items()), "check_name string, passed boolean"),
        "check_name:s passed:b",
        " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) > 0 AS passed FROM points" for n in ("formula_low", "formula_expected", "formula_high", "zero_capacity", "zero_lift", "threshold_one", "full_capacity", "high_cost_negative", "zero_value", "ordered_uncertainty", "whole_prefixes")), True),
    "movement_overview": Query(
        lambda w: movement.movements(w.overview, w.last, w.first),
        "metric:s kind:s direction:s comparison_value:f current_value:f delta:f shown_delta:r relative_percent:r tone:s",
        _movement_sql()),
    "movement_basis": Query(
        lambda w: movement.basis(w.overview, w.last, w.first),
        "label_window:s metric:s numerator:i denominator:i",
        " UNION ALL ".join(f"SELECT label_window, '{m}' AS metric, {n} AS numerator, {d} AS denominator FROM overview" for m, (n, d) in movement.BASIS.items())),
    "cohort_breaks": Query(
        lambda w: movement.cohort_breaks(w.cohorts, w.last, w.first),
        "registration_cohort_month:d current_eligible:i current_churn_rate:f comparison_eligible:i comparison_churn_rate:f change_pp:r",
        _breaks_sql("cohort", "registration_cohort_month", "registration_cohort_month DESC", False)),
    "segment_breaks": Query(
        lambda w: movement.segment_breaks(w.segments, ["dimension", "segment_key"], w.last, w.first, w.settings.minimum_group),
        "dimension:s segment_key:s current_eligible:i current_churn_rate:f comparison_eligible:i comparison_churn_rate:f change_pp:r small_group:b",
        _breaks_sql("segment", "dimension, segment_key", "a.observed_churn_rate DESC, dimension, segment_key", True)),
    "model_features": Query(lambda w: w.features, FEATURES, "SELECT * FROM feat"),
    "model_split_counts": Query(
        lambda w: w.features.groupBy("bucket", "is_repeat_subscriber").agg(F.count("*").alias("rows"), F.sum("is_churn").alias("churned")),
        "bucket:i is_repeat_subscriber:i rows:i churned:i",
        "SELECT bucket, is_repeat_subscriber, count(*) AS rows, sum(is_churn) AS churned FROM feat GROUP BY 1, 2"),
    "metric_log_loss": Query(
        lambda w: w.check_scored.agg(F.count("*").alias("rows"), evaluation.log_loss(F.col("y"), F.col("p")).alias("log_loss")),
        "rows:i log_loss:r",
        "SELECT count(*) AS rows, -avg(CASE y WHEN 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss FROM scored"),
    "metric_ece": Query(
        lambda w: evaluation.calibration_error(w.check_scored),
        "expected_calibration_error:r",
        f"""SELECT sum(abs(ys - ps)) / sum(n) AS expected_calibration_error
            FROM (SELECT {_BIN} AS bin, count(*) AS n, sum(y) AS ys, sum(p) AS ps
            FROM scored
            GROUP BY 1) b"""),
    "metric_top_decile_lift": Query(
        lambda w: evaluation.top_decile(w.check_scored),
        "top_decile_rows:i top_decile_churn_rate:r top_decile_lift:r",
        """SELECT count(*) AS top_decile_rows, avg(y) AS top_decile_churn_rate, avg(y) / (SELECT avg(y)
            FROM scored) AS top_decile_lift
            FROM topten
            WHERE place <= greatest(1, ceil(everyone * 0.1))"""),
    "metric_set_by_repeat": Query(
        lambda w: evaluation.metric_set(w.check_scored, ("is_repeat_subscriber",)),
        ("is_repeat_subscriber:i rows:i churn_rate:r log_loss:r average_probability:r expected_calibration_error:r top_decile_rows:i top_decile_churn_rate:r "
            "top_decile_lift:r"),
        f"""SELECT * FROM (SELECT is_repeat_subscriber, count(*) AS rows, avg(y) AS churn_rate, -avg(CASE y WHEN 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, avg(p) AS average_probability FROM scored GROUP BY 1)
        JOIN (SELECT is_repeat_subscriber, sum(abs(ys - ps)) / sum(n) AS expected_calibration_error FROM (SELECT is_repeat_subscriber, {_BIN} AS bin, count(*) AS n, sum(y) AS ys, sum(p) AS ps FROM scored GROUP BY 1, 2) b GROUP BY 1) USING (is_repeat_subscriber)
        JOIN (SELECT is_repeat_subscriber, count(*) AS top_decile_rows, avg(y) AS top_decile_churn_rate, avg(y) / max(base) AS top_decile_lift FROM (SELECT is_repeat_subscriber, y, avg(y) OVER (PARTITION BY is_repeat_subscriber) AS base, count(*) OVER (PARTITION BY is_repeat_subscriber) AS everyone, row_number() OVER (PARTITION BY is_repeat_subscriber ORDER BY p DESC, tie_breaker) AS place FROM scored) t WHERE place <= greatest(1, ceil(everyone * 0.1)) GROUP BY 1) USING (is_repeat_subscriber)"""),
    "metric_subgroups": Query(
        lambda w: evaluation.subgroups(w.check_scored, evaluation.DIAGNOSTICS, 100),
        "diagnostic:s group_code:i rows:i churn_rate:r log_loss:r average_probability:r expected_calibration_error:r",
        _subgroup_sql()),
    "score_curve": Query(
        lambda w: w.check_curve,
        _POINT,
        """SELECT contacts, round(minimum_score, 8) AS minimum_score, round(expected_churners, 4) AS expected_churners, observed_churners, round(risk_weighted_payment_proxy, 2) AS risk_weighted_payment_proxy, selected_payment_proxy
            FROM points"""),
    "scenario_outcomes": Query(lambda w: curve.outcomes(written(w.check_curve), REQUEST.validated(10**9, w.settings.group_size)), _CASE, _scenario_sql(), True),
    "scenario_cached": Query(lambda w: _cached_scenario(w, curve.CachedCurve.of(w.check_curve)), _CASE, _scenario_sql(), True),
    "model_score_curve": Query(lambda w: w.curve, _POINT, None, True),
    "model_scenario": Query(lambda w: curve.outcomes(w.curve, REQUEST.validated(10**9, w.settings.group_size)), _CASE, None, True),
    "model_scenario_cached": Query(lambda w: _cached_scenario(w, w.cached_curve), _CASE, None, True),
    "model_curve_totals": Query(
        _last_point, "contacts:i observed_churners:i selected_payment_proxy:f",
        "SELECT count(*) AS contacts, sum(is_churn) AS observed_churners, sum(latest_actual_amount_paid) AS selected_payment_proxy FROM feat WHERE is_repeat_subscriber = 1", True),
    "metric_prevalence_reference": Query(
        lambda w: evaluation.metric_set(w.fitted("prevalence").score(w.features).withColumn("y", F.col("is_churn"))),
        "rows:i churn_rate:r log_loss:r average_probability:r expected_calibration_error:r top_decile_rows:i top_decile_churn_rate:r top_decile_lift:r",
        _prevalence_sql()),
    "warehouse_tables": Query(
        _built, "table_name:s rows:i",
        " UNION ALL ".join(f"SELECT '{folder}' AS table_name, count(*) AS rows FROM {view}" for folder, view in _BUILT_VIEWS.items()), True),
    "deterministic_shuffle": Query(
        _shuffled,
        "subscriber_token:t place:i",
        "SELECT subscriber_token, row_number() OVER (ORDER BY sha256(hex(subscriber_token)), subscriber_token) AS place FROM member"),
    "timing_percentiles": Query(
        _timings, "event_type:s events:i median_value:r p95_value:r",
        """SELECT event_type, max(everyone) AS events, median(value) AS median_value, min(CASE WHEN place >= 0.95 * everyone THEN value END) AS p95_value FROM (SELECT event_type, value,
        row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS everyone FROM events WHERE value IS NOT NULL) t GROUP BY 1"""),
    "constant_false_branch": Query(
        _empty_branch,
        "subscriber_token:t gender:s origin:s",
        "SELECT subscriber_token, gender, 'member' AS origin FROM member UNION ALL SELECT subscriber_token, NULL, 'label' FROM gaps WHERE 1 = 0"),
    "model_scores": Query(lambda w: _scores(w, "logistic"), "tie_breaker:s y:i p:f", None, True),
    "challenger_scores": Query(lambda w: _scores(w, "boosted"), "tie_breaker:s y:i p:f", None, True),
    "bootstrap_intervals": Query(lambda w: evaluation.bootstrap(_both(w)), "measure:s low:f high:f", None, True),
    "model_decision": Query(_decision, "scope:s gate_passed:b relative_log_loss_improvement:f challenger_ece:f decision:s", None, True),
    "streaming_event_windows": Query(lambda w: event_windows.replayed(w.spark, w.sf_dir), "window_start:s event_type:s events:i", event_windows.SQL),
}


def _contract_sql() -> str:
    each = []
    for name, keys in bi.GRAIN.items():
        view, null = f"({QUERIES[f'bi_{name}'].sql})", " OR ".join(f"{k} IS NULL" for k in keys)
        wrong = "sum(CAST(eligible_subscribers <> observed_renewed_subscribers + observed_churned_subscribers AS INTEGER))" if name.startswith("fct_") else "0"
        again = f"(SELECT count(*) FROM (SELECT 1 FROM {view} b GROUP BY {', '.join(keys)} HAVING count(*) > 1) c)"
        each.append(f"SELECT '{name}' AS table_name, count(*) AS rows, {again} AS repeated_grain, sum(CAST({null} AS INTEGER)) AS null_grain, {wrong} AS unreconciled FROM {view} a")
    return " UNION ALL ".join(each)


QUERIES["bi_contract"] = Query(lambda w: bi.contract(w.star), "table_name:s rows:i repeated_grain:i null_grain:i unreconciled:i", _contract_sql())
#: These serve what a build holds.
SERVING = ("public_", "api_", "bi_", "metric_", "model_split", "movement_", "cohort_breaks", "segment_breaks", "dq_unique_combination", "dq_outcomes", "dq_group_minimum", "dq_cutoff_safety", "dq_orphans", "dq_accepted_values", "dq_null_cells")
QUERIES = {name: replace(q, stored=True) if name.startswith(SERVING) else q for name, q in QUERIES.items()}
#: These read the published model, scores or curve, or count what a whole build holds.
SCORED = ("model_score_curve", "model_scenario", "model_scenario_cached", "model_curve_totals", "warehouse_tables")
QUERIES |= {name: replace(QUERIES[name], scored=True) for name in SCORED}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle.query(q.sql, q.columns) for name, q in QUERIES.items() if q.sql}

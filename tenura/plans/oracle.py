"""SQL for another engine over the same tables: named common table expressions, put together as a query needs them."""

from __future__ import annotations

import re

from tenura.contracts import DEFAULT, METRICS, Settings
from tenura.operators.evaluation import _LOGGED, EPSILON
from tenura.operators.features import LISTENING_COUNTS, SUBSCRIPTION_COUNTS
from tenura.sources.driver_tables import CHANNELS, KINDS, PLANS, SECOND_DELIVERY

EVENT = "subscriber_token, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew, transaction_date, membership_expire_date, is_cancel"


def ctes(s: Settings = DEFAULT) -> dict[str, str]:
    """Every named relation; each may use those before it."""
    token = lambda k: f"unhex(substr(sha256(CAST({k} AS VARCHAR)), 1, 24))"
    key = lambda x: f"CAST(CAST('0x' || substr(sha256(hex({x}) || '{s.release_salt}'), 1, 16) AS UBIGINT) AS VARCHAR)"
    channel = " ".join(f"WHEN '{n}' THEN {c}" for n, c in CHANNELS.items())
    plan = " ".join(f"WHEN {k} THEN {d}" for k, d in enumerate(PLANS))
    first, last = s.windows[0].label_window, s.windows[-1].label_window
    counts = ", ".join(f"count(CASE WHEN event_type = '{k}' THEN 1 END) AS {n}" for k, n in KINDS.items())
    lists = {w: f"(transaction_date > history_cutoff - {n})" for w, n in (("30d", 30), ("90d", 90))} | {"lifetime": "TRUE"}
    sub = [f"sum(CASE WHEN {lists[w]} THEN 1 ELSE 0 END) AS subscription_event_count_{w}" for w in ("lifetime", "30d", "90d")]
    sub += [f"sum(CASE WHEN {lists[w]} THEN actual_amount_paid ELSE 0 END) AS gross_receipts_{w}" for w in ("lifetime", "30d", "90d")]
    sub += [f"sum(CASE WHEN {lists[w]} THEN is_cancel ELSE 0 END) AS cancellation_event_count_{w}" for w in ("lifetime", "30d")]
    values = {"listening_active_days": "1", "listening_seconds": "total_secs", "unique_track_count": "num_unq", "full_completion_count": "num_100", "play_count": "num_25 + num_50 + num_75 + num_985 + num_100"}
    act = [f"sum(CASE WHEN activity_date > history_cutoff - {n} THEN {v} ELSE 0 END) AS {m}_{n}d" for m, v in values.items() for n in (30, 90)]
    outcome = "count(*) AS eligible_subscribers, sum(1 - is_churn) AS observed_renewed_subscribers, sum(is_churn) AS observed_churned_subscribers"
    renewal, churn = "sum(1 - is_churn)::DOUBLE / count(*) AS observed_renewal_rate", "sum(is_churn)::DOUBLE / count(*) AS observed_churn_rate"
    totals = "gross_receipts_lifetime gross_receipts_30d gross_receipts_90d subscription_event_count_lifetime cancellation_event_count_lifetime listening_active_days_30d listening_active_days_90d full_completion_count_30d negative_duration_rows_90d".split()
    logs = ", ".join(f"ln(1 + {c}::DOUBLE) AS log_{n}" for n, c in _LOGGED.items())
    shape = "label_window, history_cutoff, expiration_window_start, expiration_window_end, renewal_observation_end"
    bounds = ", ".join(f"('{w.label_window}', DATE '{w.history_cutoff}', DATE '{w.expiration_window_start}', DATE '{w.expiration_window_end}', DATE '{w.renewal_observation_end}')" for w in s.windows)
    definitions = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in m) + ")" for m in METRICS)
    group = lambda d, c, label: f"SELECT label_window, '{d}' AS dimension, CAST({c} AS VARCHAR) AS segment_key, {label} AS segment_label, is_churn, gross_receipts_90d FROM snap WHERE {c} IS NOT NULL"
    return {
        "win": f"SELECT * FROM (VALUES {bounds}) v({shape})",
        "member": f"""SELECT {token('c_custkey')} AS subscriber_token, c_nationkey AS city_code, c_custkey % 97 AS age_reported,
            CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, CASE c_mktsegment {channel} ELSE 13 END AS registration_method_code,
            (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey) AS registration_date FROM customer""",
        "delivered": f"""SELECT {token('o_custkey')} AS subscriber_token, CAST(left(o_orderpriority, 1) AS INTEGER) AS payment_method_id, CASE o_orderkey % 4 {plan} END AS payment_plan_days,
            CAST(round(o_totalprice * 100) AS BIGINT) AS plan_list_price,
            CAST(round(o_totalprice * 100) AS BIGINT) - CASE o_orderstatus WHEN 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) // 10 ELSE 0 END AS actual_amount_paid,
            CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS is_auto_renew, CAST(o_orderdate AS DATE) AS transaction_date,
            CAST(o_orderdate AS DATE) + CASE o_orderkey % 4 {plan} END AS membership_expire_date,
            CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS is_cancel, o_orderkey FROM orders""",
        "rawtx": f"""SELECT {EVENT}, CASE o_orderkey % 2 WHEN 0 THEN 'v1' ELSE 'v2' END AS source_version FROM delivered
            UNION ALL SELECT {EVENT}, CASE o_orderkey % 100 WHEN 0 THEN 'v1' ELSE 'v2' END FROM delivered WHERE o_orderkey % 50 = 0""",
        "tx": f"""SELECT unhex(left(sha256(concat_ws('|', hex(subscriber_token), payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew, transaction_date, membership_expire_date, is_cancel)), 24)) AS event_key,
            {EVENT}, string_agg(DISTINCT source_version, '+' ORDER BY source_version) AS source_versions FROM rawtx GROUP BY ALL""",
        "day": f"""SELECT {token('user_id')} AS subscriber_token, activity_date, {', '.join(KINDS.values())}, num_unq, greatest(secs, 0) AS total_secs, secs < 0 AS total_secs_was_negative,
            CASE WHEN activity_date < DATE '{SECOND_DELIVERY}' THEN 'v1' ELSE 'v2' END AS source_version, year(activity_date) * 100 + month(activity_date) AS activity_month
            FROM (SELECT user_id, shifted - CAST(date_diff('day', DATE '1970-01-01', shifted) % (1 + user_id % 12) AS INTEGER) AS activity_date, {counts}, count(DISTINCT props) AS num_unq, sum(CAST(value - 10 AS DECIMAL(18,2))) AS secs
            FROM (SELECT *, CAST(ts AS DATE) - {s.activity_shift_days} AS shifted FROM events) GROUP BY ALL)""",
        "seq": """SELECT *, row_number() OVER (PARTITION BY subscriber_token, transaction_date ORDER BY plan_list_price DESC NULLS LAST, actual_amount_paid DESC NULLS LAST, payment_plan_days DESC NULLS LAST,
            payment_method_id DESC NULLS LAST, is_auto_renew DESC NULLS LAST, CASE is_cancel WHEN 0 THEN membership_expire_date END ASC NULLS LAST,
            CASE is_cancel WHEN 1 THEN membership_expire_date END DESC NULLS LAST, is_cancel NULLS LAST, event_key NULLS LAST) AS same_day_sequence FROM tx""",
        "past": "SELECT seq.*, label_window, history_cutoff FROM seq, win WHERE transaction_date <= history_cutoff",
        "newest": """SELECT * FROM (SELECT *, rank() OVER (PARTITION BY subscriber_token, label_window ORDER BY transaction_date DESC, same_day_sequence DESC) AS place FROM past) WHERE place = 1""",
        "gaps": f"""SELECT n.subscriber_token, n.label_window, n.membership_expire_date AS expiration_date, min(t.transaction_date) AS next_payment_date,
            min(t.transaction_date) - n.membership_expire_date AS gap_days,
            CASE WHEN min(t.transaction_date) - n.membership_expire_date < {s.renewal_gap_days} THEN 0 ELSE 1 END AS is_churn
            FROM newest n LEFT JOIN tx t ON t.subscriber_token = n.subscriber_token AND t.transaction_date > n.history_cutoff AND t.is_cancel = 0 GROUP BY 1, 2, 3""",
        "cuts": "SELECT subscriber_token, is_churn, win.* FROM gaps JOIN win USING (label_window)",
        "subf": f"""SELECT a.*, n.payment_method_id AS latest_payment_method_id, n.payment_plan_days AS latest_payment_plan_days, n.plan_list_price AS latest_plan_list_price,
            n.actual_amount_paid AS latest_actual_amount_paid, n.is_auto_renew AS latest_is_auto_renew, n.is_cancel AS latest_is_cancel, n.membership_expire_date AS effective_expiration_date
            FROM (SELECT subscriber_token, label_window, {', '.join(sub)}, max(transaction_date) AS latest_transaction_date FROM past GROUP BY 1, 2) a JOIN newest n USING (subscriber_token, label_window)""",
        "actf": f"""SELECT subscriber_token, label_window, {', '.join(act)}, sum(CAST(total_secs_was_negative AS INTEGER)) AS negative_duration_rows_90d, max(activity_date) AS latest_activity_date
            FROM day, win WHERE activity_date BETWEEN history_cutoff - 89 AND history_cutoff GROUP BY 1, 2""",
        "snap": f"""SELECT c.*, 1 - is_churn AS observed_renewed_within_30_days, registration_date, CAST(date_trunc('month', registration_date) AS DATE) AS registration_cohort_month,
            history_cutoff - registration_date AS tenure_days, registration_method_code, city_code, age_reported, gender,
            {', '.join(f'ifnull({x}, 0) AS {x}' for x in SUBSCRIPTION_COUNTS)}, latest_transaction_date, latest_payment_method_id, latest_payment_plan_days, latest_plan_list_price,
            latest_actual_amount_paid, latest_is_auto_renew, latest_is_cancel, effective_expiration_date, ifnull(effective_expiration_date >= history_cutoff, FALSE) AS is_active_at_cutoff,
            {', '.join(f'ifnull({x}, 0) AS {x}' for x in LISTENING_COUNTS)}, latest_activity_date,
            CASE WHEN ifnull(listening_active_days_30d, 0) > 15 THEN 'High' WHEN listening_active_days_30d > 5 THEN 'Steady' WHEN listening_active_days_30d > 0 THEN 'Light' ELSE 'Dormant' END AS engagement_segment
            FROM cuts c LEFT JOIN member USING (subscriber_token) LEFT JOIN subf USING (subscriber_token, label_window) LEFT JOIN actf USING (subscriber_token, label_window)""",
        "overview": f"""SELECT label_window, max(history_cutoff) AS history_cutoff, {outcome}, sum(CAST(is_active_at_cutoff AS INTEGER)) AS active_subscribers, {renewal}, {churn},
            {', '.join(f'sum({t}) AS {t}' for t in totals)}, sum(cancellation_event_count_lifetime)::DOUBLE / nullif(sum(subscription_event_count_lifetime), 0) AS cancellation_event_rate FROM snap GROUP BY 1""",
        "cohort": f"SELECT label_window, registration_cohort_month, {outcome}, {renewal}, {churn}, sum(gross_receipts_90d) AS gross_receipts_90d FROM snap WHERE registration_cohort_month <= date_trunc('month', history_cutoff) GROUP BY 1, 2",
        "engagement": f"""SELECT label_window, engagement_segment, {outcome}, {churn}, sum(listening_active_days_30d)::DOUBLE / count(*) AS average_listening_active_days_30d,
            sum(listening_seconds_30d)::DOUBLE / count(*) AS average_listening_seconds_30d, sum(full_completion_count_30d) AS full_completion_count_30d FROM snap GROUP BY 1, 2""",
        "segment": f"""SELECT label_window, dimension, segment_key, segment_label, {outcome}, {renewal}, {churn}, sum(gross_receipts_90d) AS gross_receipts_90d FROM (
            {group('payment_method', 'latest_payment_method_id', "'Method ' || latest_payment_method_id")} UNION ALL {group('plan_duration', 'latest_payment_plan_days', "latest_payment_plan_days || ' days'")}
            UNION ALL {group('registration_method', 'registration_method_code', "'Channel ' || registration_method_code")}
            UNION ALL {group('auto_renew', 'latest_is_auto_renew', "CASE latest_is_auto_renew WHEN 1 THEN 'Auto-renew on' ELSE 'Auto-renew off' END")}) GROUP BY 1, 2, 3, 4""",
        "pcohort": f"SELECT * FROM cohort WHERE eligible_subscribers >= {s.minimum_group}",
        "pengagement": f"SELECT * FROM engagement WHERE eligible_subscribers >= {s.minimum_group}",
        "psegment": f"SELECT * FROM segment WHERE eligible_subscribers >= {s.minimum_group}",
        "definition": f"SELECT * FROM (VALUES {definitions}) v(metric_id, definition, grain, direction, limitation)",
        "review": f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY label_window ORDER BY gross_receipts_90d DESC NULLS LAST, subscriber_token) AS place FROM snap) WHERE place <= {s.review_subscribers}",
        "reviewtx": f"""SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.subscriber_token, p.label_window ORDER BY p.transaction_date DESC, p.same_day_sequence DESC) AS place
            FROM past p JOIN review r ON r.subscriber_token = p.subscriber_token AND r.label_window = p.label_window) WHERE place <= {s.review_events}""",
        "reviewday": """SELECT d.subscriber_token, r.label_window, CAST(date_trunc('month', d.activity_date) AS DATE) AS activity_month, count(*) AS active_days, sum(total_secs) AS listening_seconds, sum(num_unq) AS unique_track_count
            FROM day d JOIN review r ON r.subscriber_token = d.subscriber_token AND d.activity_date BETWEEN r.history_cutoff - 179 AND r.history_cutoff GROUP BY 1, 2, 3""",
        "feat": f"""SELECT CASE WHEN registration_date <= history_cutoff THEN history_cutoff - registration_date END AS tenure_days, CAST(registration_date > history_cutoff AS INTEGER) AS invalid_registration,
            CAST(registration_date IS NULL AS INTEGER) AS missing_registration, {logs}, ifnull(history_cutoff - latest_transaction_date, 9999) AS days_since_transaction,
            ifnull(effective_expiration_date - history_cutoff, -9999) AS days_to_expiration, ifnull(latest_plan_list_price, 0) AS latest_plan_list_price, ifnull(latest_actual_amount_paid, 0) AS latest_actual_amount_paid,
            listening_active_days_30d, listening_active_days_90d, ifnull(history_cutoff - latest_activity_date, 9999) AS days_since_activity, negative_duration_rows_90d,
            CAST(latest_transaction_date IS NULL AS INTEGER) AS missing_transaction, CAST(latest_activity_date IS NULL AS INTEGER) AS missing_listening,
            CASE WHEN registration_date <= history_cutoff THEN ifnull(registration_method_code, -1) ELSE -1 END AS registration_method_code, ifnull(latest_payment_method_id, -1) AS latest_payment_method_id,
            ifnull(latest_payment_plan_days, -1) AS latest_payment_plan_days, ifnull(latest_is_auto_renew, 2) AS latest_is_auto_renew, ifnull(latest_is_cancel, 2) AS latest_is_cancel, CAST(is_active_at_cutoff AS INTEGER) AS is_active_at_cutoff,
            list_position(['Dormant', 'Light', 'Steady', 'High'], engagement_segment) - 1 AS engagement_segment_code, is_churn, CAST('0x' || left(hex(subscriber_token), 8) AS BIGINT) % 10 AS bucket, lower(hex(subscriber_token)) AS tie_breaker,
            CAST(subscriber_token IN (SELECT subscriber_token FROM snap WHERE label_window = '{first}') AS INTEGER) AS is_repeat_subscriber, ifnull(latest_is_auto_renew, 2) AS diagnostic_auto_renew,
            list_position(['Dormant', 'Light', 'Steady', 'High'], engagement_segment) - 1 AS diagnostic_engagement,
            CASE WHEN age_reported < 10 OR age_reported > 80 THEN 0 WHEN age_reported < 25 THEN 1 WHEN age_reported < 35 THEN 2 WHEN age_reported < 50 THEN 3 WHEN age_reported <= 80 THEN 4 ELSE 0 END AS diagnostic_age_band,
            CASE gender WHEN 'male' THEN 1 WHEN 'female' THEN 2 ELSE 0 END AS diagnostic_gender, gross_receipts_90d
            FROM snap WHERE label_window = '{last}' AND ifnull(latest_transaction_date <= history_cutoff, TRUE) AND ifnull(latest_activity_date <= history_cutoff, TRUE)""",
        "scored": "SELECT is_churn AS y, 0.05 + 0.9 * ((CAST('0x' || left(tie_breaker, 8) AS BIGINT) % 1000) / 1000.0::DOUBLE) AS p, latest_actual_amount_paid AS receipts, * FROM feat",
        "topten": "SELECT *, row_number() OVER (ORDER BY p DESC, tie_breaker) AS place, count(*) OVER () AS everyone FROM scored",
        "points": f"""SELECT * FROM (SELECT row_number() OVER o AS contacts, p AS minimum_score, sum(p) OVER o AS expected_churners, sum(y) OVER o AS observed_churners, sum(p * receipts) OVER o AS risk_weighted_payment_proxy,
            sum(receipts) OVER o AS selected_payment_proxy, count(*) OVER () AS everyone FROM scored WHERE is_repeat_subscriber = 1 WINDOW o AS (ORDER BY p DESC, tie_breaker ROWS UNBOUNDED PRECEDING))
            WHERE contacts % {s.group_size} = 0 OR contacts = everyone""",
        "rel_member": f"""SELECT {key('subscriber_token')} AS subscriber_key, city_code, CASE WHEN age_reported >= 10 AND age_reported < 100 THEN age_reported - age_reported % 10 END AS age_band_start, gender,
            registration_method_code, CAST(date_trunc('month', registration_date) AS DATE) AS registration_month FROM member""",
        "rel_tx": f"SELECT {key('event_key')} AS event_key, {key('subscriber_token')} AS subscriber_key, tx.* EXCLUDE (event_key, subscriber_token) FROM tx",
        "rel_label": f"SELECT {key('subscriber_token')} AS subscriber_key, label_window, is_churn FROM gaps",
        "rel_day": f"SELECT {key('subscriber_token')} AS subscriber_key, day.* EXCLUDE (subscriber_token, activity_month) FROM day",
        "eps": f"SELECT {EPSILON!r}::DOUBLE AS e",
    }


def query(body: str, columns: str, settings: Settings = DEFAULT) -> str:
    """body with the relations that it needs in front, and its columns cast as declared."""
    every = ctes(settings)
    names = list(every)
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+\(?{n}\b", text):
                needed.add(n)
                todo.append(every[n])
    head = ",\n".join(f"{n} AS MATERIALIZED ({every[n]})" for n in names if n in needed)
    casts = {"i": "CAST({c} AS BIGINT)", "f": "CAST({c} AS DOUBLE)", "r": "round(CAST({c} AS DOUBLE), 6) + 0.0", "s": "CAST({c} AS VARCHAR)", "d": "strftime({c}, '%Y-%m-%d')", "b": "CAST({c} AS BOOLEAN)", "t": "lower(hex({c}))"}
    shown = ", ".join(f"{casts[k].format(c=n)} AS {n}" for n, k in (x.split(":") for x in columns.split()))
    return f"{'WITH ' + head if head else ''}\nSELECT {shown} FROM ({body}) final"

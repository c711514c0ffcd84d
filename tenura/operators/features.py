"""Cutoff-safe features: everything that a subscriber had done by a window's cutoff."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenura.functions.columns import churn_from_gap, engagement_segment, month_of

LATEST = {
    "payment_method_id": "latest_payment_method_id", "payment_plan_days": "latest_payment_plan_days", "plan_list_price": "latest_plan_list_price",
    "actual_amount_paid": "latest_actual_amount_paid", "is_auto_renew": "latest_is_auto_renew", "is_cancel": "latest_is_cancel", "membership_expire_date": "effective_expiration_date",
}
SUBSCRIPTION_COUNTS = tuple(f"{m}_{s}" for m in ("subscription_event_count", "gross_receipts") for s in ("lifetime", "30d", "90d")) + ("cancellation_event_count_lifetime", "cancellation_event_count_30d")
LISTENING_SUMS = {"listening_seconds": "total_secs", "unique_track_count": "num_unq", "full_completion_count": "num_100"}
LISTENING_COUNTS = tuple(f"{m}_{s}" for m in ("listening_active_days", *LISTENING_SUMS, "play_count") for s in ("30d", "90d")) + ("negative_duration_rows_90d",)
KEY = ("subscriber_token", "label_window")


def sequenced(transactions: DataFrame) -> DataFrame:
    """transactions with same_day_sequence, the order of a subscriber's events within a day.

    Partitioned by subscriber, so that the aggregation by subscriber that follows
    needs no further shuffle.
    """
    expiry, cancel = F.col("membership_expire_date"), F.col("is_cancel")
    order = [F.col(c).desc_nulls_last() for c in ("plan_list_price", "actual_amount_paid", "payment_plan_days", "payment_method_id", "is_auto_renew")]
    order += [F.when(cancel == 0, expiry).asc_nulls_last(), F.when(cancel == 1, expiry).desc_nulls_last(), cancel.asc_nulls_last(), F.col("event_key").asc_nulls_last()]
    spread = transactions.repartition("subscriber_token")
    return spread.withColumn("same_day_sequence", F.row_number().over(W.partitionBy("subscriber_token", "transaction_date").orderBy(*order)))


class Timeline:
    """The windows' cutoffs, and the days so long before them, as sorted boundaries that cut time into intervals.

    An event is added up once, by (subscriber, interval); a window's features are sums over
    a subscriber's intervals. So the work on events doesn't grow with the windows, and
    no event is joined to one. Windows are a few rows, which the driver reads.
    """

    def __init__(self, windows: DataFrame, lookbacks: tuple[int, ...] = ()):
        rows = [(r["label_window"], r["history_cutoff"]) for r in windows.select("label_window", "history_cutoff").collect()]
        self.days = sorted({c - timedelta(n) for _, c in rows for n in (0, *lookbacks)})
        place = lambda day: F.lit(self.days.index(day))
        fields = lambda label, c: [F.lit(label).alias("label_window"), place(c).alias("upto"), *(place(c - timedelta(n)).alias(f"after_{n}") for n in lookbacks)]
        self.windows = F.array(*(F.struct(*fields(label, c)) for label, c in rows))

    def interval(self, day: Column) -> Column:
        """The first boundary that a day doesn't pass; one more than there are where it passes all, null for no day."""
        out = F.when(day.isNull(), None)
        for k, limit in enumerate(self.days):
            out = out.when(day <= F.lit(limit), k)
        return out.otherwise(len(self.days))

    def by_window(self, events: DataFrame, day: str, measures: dict[str, Column]) -> DataFrame:
        """A row for each subscriber and window, with upto, the lookbacks' after_ and parts: interval and measures of the subscriber's intervals."""
        interval = self.interval(F.col(day))
        parts = events.groupBy("subscriber_token", interval.alias("interval")).agg(*(c.alias(n) for n, c in measures.items()))
        lists = parts.groupBy("subscriber_token").agg(F.collect_list(F.struct("interval", *measures)).alias("parts"))  # one for each interval at most
        return lists.select("subscriber_token", "parts", F.explode(self.windows).alias("window")).select("subscriber_token", "window.*", "parts")


def upto_cutoff(after: str | None = None) -> Column:
    """The intervals up to a window's cutoff, those of a lookback where its column is given."""
    return F.filter("parts", lambda p: (p["interval"] <= F.col("upto")) & (p["interval"] > F.col(after) if after else F.lit(True)))


def total(parts: Column, measure: str, kind: str = "bigint") -> Column:
    """The sum of a measure over intervals; 0 without one."""
    return F.aggregate(parts, F.lit(0).cast(kind), lambda t, p: (t + F.coalesce(p[measure], F.lit(0).cast(kind))).cast(kind))


def subscription_features(transactions: DataFrame, windows: DataFrame) -> DataFrame:
    """Counts, receipts and the latest event by (subscriber, window), from one aggregation of the events."""
    timeline, day = Timeline(windows, (30, 90)), F.col("transaction_date")
    measures = {
        "events": F.count("*"), "receipts": F.sum("actual_amount_paid"), "cancels": F.count_if(F.col("is_cancel") == 1),
        "last": F.max(F.struct("transaction_date", "same_day_sequence", *LATEST)),
    }
    rows = timeline.by_window(sequenced(transactions.filter(day <= F.lit(timeline.days[-1]))), "transaction_date", measures)
    spans = {"lifetime": upto_cutoff(), "30d": upto_cutoff("after_30"), "90d": upto_cutoff("after_90")}
    columns = {f"subscription_event_count_{s}": total(p, "events") for s, p in spans.items()} | {f"gross_receipts_{s}": total(p, "receipts") for s, p in spans.items()}
    columns |= {f"cancellation_event_count_{s}": total(p, "cancels") for s, p in spans.items() if s != "90d"}
    last = F.array_max(F.transform(upto_cutoff(), lambda p: p["last"]))
    out = rows.select(*KEY, *(c.alias(n) for n, c in columns.items()), last.alias("last")).filter("subscription_event_count_lifetime > 0")
    return out.select(*KEY, *SUBSCRIPTION_COUNTS, F.col("last.transaction_date").alias("latest_transaction_date"), *(F.col(f"last.{c}").alias(n) for c, n in LATEST.items()))


def listening_features(listening: DataFrame, windows: DataFrame, bounds: tuple | None = None) -> DataFrame:
    """30- and 90-day activity by (subscriber, window).

    bounds (first and last cutoff) adds literal limits, by month and by day, which
    reach the scan: a range that comes from a joined table never prunes folders.
    """
    day = F.col("activity_date")
    if bounds:
        low, high = F.date_sub(F.lit(bounds[0]), 90), F.lit(bounds[1])
        month = lambda d: F.year(d) * 100 + F.month(d)
        listening = listening.filter(F.col("activity_month").between(month(low), month(high)) & (day > low) & (day <= high))
    timeline = Timeline(windows, (30, 90))
    plays = sum((F.col(c) for c in ("num_50", "num_75", "num_985", "num_100")), F.col("num_25"))
    measures = {"days": F.count("*"), **{n: F.sum(c) for n, c in LISTENING_SUMS.items()}, "play_count": F.sum(plays), "negative": F.count_if("total_secs_was_negative"), "latest": F.max("activity_date")}
    rows = timeline.by_window(listening.filter(day.between(F.lit(timeline.days[0]), F.lit(timeline.days[-1]))), "activity_date", measures)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["parts"].dataType.elementType}
    spans = {"30d": upto_cutoff("after_30"), "90d": upto_cutoff("after_90")}
    columns = {f"listening_active_days_{s}": total(p, "days") for s, p in spans.items()}
    columns |= {f"{n}_{s}": total(p, n, kinds[n]) for n in (*LISTENING_SUMS, "play_count") for s, p in spans.items()}
    columns |= {"negative_duration_rows_90d": total(spans["90d"], "negative"), "latest_activity_date": F.array_max(F.transform(spans["90d"], lambda p: p["latest"]))}
    out = rows.select(*KEY, *(c.alias(n) for n, c in columns.items())).filter("listening_active_days_90d > 0")
    return out.select(*KEY, *LISTENING_COUNTS, "latest_activity_date")


def renewal_gaps(transactions: DataFrame, windows: DataFrame, gap_days: int = 30) -> DataFrame:
    """Each known subscriber's window label: the gap from the expiry at the cutoff to the next payment after it."""
    timeline = Timeline(windows)
    measures = {"events": F.count("*"), "last": F.max(F.struct("transaction_date", "same_day_sequence", "membership_expire_date")), "first_payment": F.min(F.when(F.col("is_cancel") == 0, F.col("transaction_date")))}
    rows = timeline.by_window(sequenced(transactions), "transaction_date", measures)
    later = F.filter("parts", lambda p: p["interval"] > F.col("upto"))
    expiry = F.array_max(F.transform(upto_cutoff(), lambda p: p["last"]))["membership_expire_date"]
    renewed = F.array_min(F.transform(later, lambda p: p["first_payment"]))
    out = rows.select(*KEY, total(upto_cutoff(), "events").alias("events"), expiry.alias("expiration_date"), renewed.alias("next_payment_date")).filter("events > 0")
    gap = F.datediff("next_payment_date", "expiration_date")
    return out.select(*KEY, "expiration_date", "next_payment_date", gap.alias("gap_days"), churn_from_gap(gap, gap_days).alias("is_churn"))


def subscriber_cutoffs(labels: DataFrame, windows: DataFrame) -> DataFrame:
    """Labels with their window's dates; in the order of the window relation."""
    return labels.select(*KEY, "is_churn").join(F.broadcast(windows), "label_window")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def snapshot(cutoffs: DataFrame, members: DataFrame, subscription: DataFrame, listening: DataFrame) -> DataFrame:
    """One row per label: state as of the cutoff. All joins keep the labels' rows."""
    joined = cutoffs.join(members, "subscriber_token", "left").join(subscription, list(KEY), "left").join(listening, list(KEY), "left")
    active = F.coalesce(F.col("effective_expiration_date") >= F.col("history_cutoff"), F.lit(False))
    return joined.select(
        *KEY, "history_cutoff", "expiration_window_start", "expiration_window_end", "renewal_observation_end", "is_churn",
        (1 - F.col("is_churn")).alias("observed_renewed_within_30_days"), "registration_date", month_of(F.col("registration_date")).alias("registration_cohort_month"),
        F.datediff("history_cutoff", "registration_date").alias("tenure_days"), "registration_method_code", "city_code", "age_reported", "gender",
        *map(zero, SUBSCRIPTION_COUNTS), "latest_transaction_date", *LATEST.values(), active.alias("is_active_at_cutoff"),
        *map(zero, LISTENING_COUNTS), "latest_activity_date", engagement_segment(F.col("listening_active_days_30d")).alias("engagement_segment"),
    )

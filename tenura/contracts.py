"""Windows, source families and settings that every job takes as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class LabelWindow:
    """A discrete analysis period; everything up to its cutoff is history."""

    label_window: str
    history_cutoff: date

    @property
    def expiration_window_start(self) -> date:
        return self.history_cutoff + timedelta(days=1)

    @property
    def expiration_window_end(self) -> date:
        return self.history_cutoff + timedelta(days=30)

    @property
    def renewal_observation_end(self) -> date:
        return self.history_cutoff + timedelta(days=60)


@dataclass(frozen=True)
class Settings:
    """What differs between deployments."""

    windows: tuple[LabelWindow, ...] = (LabelWindow("2000-06", date(2000, 6, 20)), LabelWindow("2000-07", date(2000, 6, 30)))
    minimum_group: int = 100
    renewal_gap_days: int = 30
    review_subscribers: int = 500
    review_events: int = 24
    group_size: int = 100
    #: The model whose scores a build publishes: logistic, boosted or prevalence.
    score_model: str = "logistic"
    #: Split buckets of the first window that models are fitted and calibrated on; the last window is the test.
    fit_buckets: tuple[int, ...] = (0, 1)
    calibration_buckets: tuple[int, ...] = (2,)
    release_salt: str = "5f" * 32
    #: The activity table's days are this much later than the payment table's.
    activity_shift_days: int = 8604
    segments: tuple[str, ...] = ("Dormant", "Light", "Steady", "High")
    denied_columns: frozenset[str] = field(default_factory=lambda: frozenset({"subscriber_token", "event_key", "msno", "gender", "age_reported", "city_code", "registration_date"}))


DEFAULT = Settings()


def windows_frame(spark: SparkSession, settings: Settings = DEFAULT) -> DataFrame:
    """The windows as a relation, a row each; always small."""
    rows = [(w.label_window, w.history_cutoff, w.expiration_window_start, w.expiration_window_end, w.renewal_observation_end) for w in settings.windows]
    return spark.createDataFrame(rows, "label_window string, history_cutoff date, expiration_window_start date, expiration_window_end date, renewal_observation_end date")


def _field(name: str, kind: T.DataType, sensitivity: str = "internal", null_policy: str = "reject", allowed: str = "any") -> T.StructField:
    return T.StructField(name, kind, True, {"sensitivity": sensitivity, "null_policy": null_policy, "allowed": allowed})


_I = T.IntegerType()
#: Columns of the source families' CSV files, in file order (fixed values of the source format).
FAMILIES = {
    "members": T.StructType([_field("msno", T.StringType(), "restricted"), _field("city", _I, "sensitive", "keep"), _field("bd", _I, "sensitive", "keep"), _field("gender", T.StringType(), "sensitive", "keep"), _field("registered_via", _I, null_policy="keep"), _field("registration_init_time", _I, null_policy="keep")]),
    "labels": T.StructType([_field("msno", T.StringType(), "restricted"), _field("is_churn", _I, allowed="0/1")]),
    "transactions": T.StructType([_field("msno", T.StringType(), "restricted"), *(_field(n, _I) for n in ("payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel"))]),
    "listening": T.StructType([_field("msno", T.StringType(), "restricted"), *(_field(n, _I) for n in ("date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")), _field("total_secs", T.DoubleType())]),
}
SENSITIVITIES = ("restricted", "sensitive", "internal", "public")
METADATA = ("sensitivity", "null_policy", "allowed")

#: The six public metrics. Ids, grain and direction are fixed values of the published definitions; the sentences say what the snapshot computes.
METRICS = (
    ("active_subscribers", "How many have a latest payment whose membership end isn't before the cutoff.", "subscriber at cutoff", "higher", "Follows from payments alone: a payment that was never delivered looks like a lapse."),
    ("gross_receipts", "What the payments up to the cutoff add up to, over all time or the last 30 or 90 days.", "subscription transaction", "context", "Refunds and taxes aren't told apart, and amounts aren't spread over the days they pay for."),
    ("observed_renewal_rate", "One less the observed churn rate.", "label window", "higher", "Tells what happened in the window, whatever caused it."),
    ("observed_churn_rate", "The share of a window's subscribers without a payment in the 30 days behind their membership's end.", "label window", "lower", "A payment on the thirtieth day or later counts as none."),
    ("cancellation_event_rate", "The share of payments up to the cutoff that are cancellations.", "subscription transaction", "lower", "Who cancels twice counts twice, and may renew later."),
    ("listening_active_days", "How many pairs of subscriber and day have activity in the last 30 or 90 days.", "subscriber-day", "context", "A day without a row may be one that wasn't recorded."),
)


def contract_problems(families: dict[str, T.StructType] = FAMILIES) -> list[str]:
    """What a set of family contracts lacks; empty when complete."""
    out = []
    for family, schema in families.items():
        names = schema.fieldNames()
        if len(set(names)) != len(names):
            out.append(f"{family}: repeated field")
        for f in schema:
            missing = [m for m in METADATA if not f.metadata.get(m)]
            if missing:
                out.append(f"{family}.{f.name}: no {', '.join(missing)}")
            elif f.metadata["sensitivity"] not in SENSITIVITIES:
                out.append(f"{family}.{f.name}: unknown sensitivity")
    return out

"""Score curve and scenario arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenura.operators.scratch import written

POINT = ("contacts", "minimum_score", "expected_churners", "observed_churners", "risk_weighted_payment_proxy", "selected_payment_proxy")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], rank: str = "rank") -> DataFrame:
    """Running sums and the rank over a global order, without one task that sees all rows.

    Rows are range-partitioned and written; each partition's totals, a row per
    partition, give the offsets of the next; running sums are then local.
    """
    spread = written(df.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    totals = spread.groupBy("slice").agg(F.count("*").alias(rank), *(F.sum(c).alias(n) for n, c in sums.items()))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # over a row per slice
    offsets = totals.select("slice", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in (rank, *sums)))
    local = W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = spread.join(F.broadcast(offsets), "slice")
    own = {rank: F.col(f"{rank}_before") + F.row_number().over(W.partitionBy("slice").orderBy(*order))}
    own |= {n: F.col(f"{n}_before") + F.sum(c).over(local) for n, c in sums.items()}
    return rows.select(*df.columns, *(c.alias(n) for n, c in own.items()))


def places_within(df: DataFrame, by: list[str], order: list[Column], size: Column) -> DataFrame:
    """df with above, the sum of size over the rows before it in its group, without one task that sees a whole group."""
    run = prefix_sums(df, [*(F.col(c).asc() for c in by), *order], {"upto": size}, "rank")
    before = F.col("upto") - size
    starts = run.groupBy(*by).agg(F.min(before).alias("start"))
    joined = run.join(starts, by) if by else run.join(F.broadcast(starts))
    return joined.select(*df.columns, (before - F.col("start")).alias("above"))


def score_curve(scored: DataFrame, group: int = 100) -> DataFrame:
    """Cumulative points at each group-th contact and at the last one, from (p, y, receipts, tie_breaker).

    Sums are of decimals (a probability to 16 places, money to 2), which add up to the
    same in any order: points don't depend on how rows are laid out.
    """
    money, chance = F.greatest(F.col("receipts"), F.lit(0)).cast("decimal(18,2)"), F.col("p").cast("decimal(17,16)")
    sums = {"expected": chance, "observed": F.col("y").cast("long"), "risk": chance * money, "paid": money}
    rows = prefix_sums(scored.select("p", "y", "receipts", "tie_breaker"), [F.col("p").desc(), F.col("tie_breaker").asc()], sums)
    last = rows.agg(F.max("rank").alias("last"))
    picked = rows.join(F.broadcast(last)).filter((F.col("rank") % group == 0) | (F.col("rank") == F.col("last")))
    return picked.select(
        F.col("rank").cast("long").alias("contacts"), F.round("p", 8).alias("minimum_score"), F.round("expected", 4).cast("double").alias("expected_churners"),
        F.col("observed").cast("long").alias("observed_churners"), F.round("risk", 2).cast("double").alias("risk_weighted_payment_proxy"), F.round("paid", 2).cast("double").alias("selected_payment_proxy"))


@dataclass(frozen=True)
class Scenario:
    """A capacity-bounded request."""

    capacity: int
    minimum_score: float = 0.0
    contact_cost: float = 0.0
    offer_cost: float = 0.0
    assumed_lift: float = 0.0
    lift_uncertainty: float = 0.0

    def validated(self, eligible: int, group: int) -> Scenario:
        """This request, or ValueError where it leaves its domain."""
        if isinstance(self.capacity, bool) or not isinstance(self.capacity, int) or not 0 <= self.capacity <= eligible:
            raise ValueError(f"capacity is a whole number from 0 to {eligible}")
        if 0 < self.capacity < group:
            raise ValueError(f"a positive capacity is {group} at least")
        limits = {"minimum_score": 1.0, "assumed_lift": 1.0, "lift_uncertainty": 0.5, "contact_cost": 10_000.0, "offer_cost": 10_000.0}
        for name, most in limits.items():
            if not 0 <= getattr(self, name) <= most:  # false for nan, too
                raise ValueError(f"{name} is a number from 0 to {most:g}")
        return self


def selected_point(curve: DataFrame, request: Scenario) -> DataFrame:
    """The last point before the first that breaks capacity or score; a row of zeros where the first one does."""
    broken = (F.col("contacts") > request.capacity) | (F.col("minimum_score") < request.minimum_score)
    first = curve.agg(F.min(F.when(broken, F.col("contacts"))).alias("stop"))
    reached = curve.join(F.broadcast(first)).filter(F.col("stop").isNull() | (F.col("contacts") < F.col("stop")))
    best = reached.agg(F.max_by(F.struct(*POINT), "contacts").alias("best"))
    zero = {"contacts": F.lit(0).cast("long"), "minimum_score": F.lit(float(request.minimum_score)), "observed_churners": F.lit(0).cast("long")}
    return best.select(*(F.coalesce(F.col(f"best.{c}"), zero.get(c, F.lit(0.0))).alias(c) for c in POINT))


def outcomes(curve: DataFrame, request: Scenario) -> DataFrame:
    """Low, expected and high outcome of a request: three rows."""
    spark = curve.sparkSession
    low, high = max(0.0, request.assumed_lift - request.lift_uncertainty), min(1.0, request.assumed_lift + request.lift_uncertainty)
    lifts = spark.createDataFrame([("low", low), ("expected", float(request.assumed_lift)), ("high", high)], "case_name string, assumed_lift double")
    totals = curve.agg(F.max("contacts").alias("eligible_subscribers"), F.max_by("expected_churners", "contacts").alias("total_expected"))
    rows = lifts.join(F.broadcast(selected_point(curve, request))).join(F.broadcast(totals))
    contacts = F.col("contacts").cast("double")
    spend = {"contact_spend": contacts * request.contact_cost, "offer_spend": contacts * request.offer_cost}
    total = spend["contact_spend"] + spend["offer_spend"]
    value = F.col("risk_weighted_payment_proxy") * F.col("assumed_lift")
    even = total / F.when(F.col("risk_weighted_payment_proxy") != 0, F.col("risk_weighted_payment_proxy"))
    return rows.select(
        "case_name", "assumed_lift", "contacts", "minimum_score", "observed_churners",
        (F.col("expected_churners") * F.col("assumed_lift")).alias("simulated_retained_subscribers"), value.alias("simulated_retained_gross_receipt_proxy"),
        *(c.alias(n) for n, c in spend.items()), total.alias("total_spend"), (value - total).alias("simulated_net_value"),
        ((value - total) / F.when(total != 0, total)).alias("simulated_roi"), even.alias("break_even_lift"), F.coalesce(even <= 1, F.lit(False)).alias("break_even_feasible"),
        F.when(contacts > 0, F.col("observed_churners") / F.when(contacts > 0, contacts)).otherwise(0.0).alias("observed_churn_rate"),
        F.when(contacts > 0, F.col("expected_churners") / F.when(F.col("total_expected") != 0, F.col("total_expected"))).otherwise(0.0).alias("modeled_risk_capture"),
        (contacts / F.lit(float(request.capacity) if request.capacity else None).cast("double")).alias("capacity_utilization"), "eligible_subscribers",
    )


#: Points that a cached curve may hold in memory (48 bytes each).
MOST_POINTS = 2_000_000


class CachedCurve:
    """A written curve in the memory of one process, which answers requests without a job."""

    def __init__(self, points: dict[str, np.ndarray]):
        order = np.argsort(points["contacts"])
        self.points = {name: values[order] for name, values in points.items()}

    @classmethod
    def of(cls, points: DataFrame, most: int = MOST_POINTS) -> CachedCurve:
        """A curve's points; refused where there are more than so many."""
        if points.limit(most + 1).count() > most:
            raise ValueError(f"a cached curve has {most} points at most")
        found = points.toPandas()
        return cls({name: found[name].to_numpy() for name in POINT})

    @classmethod
    def read(cls, spark: SparkSession, path: str, most: int = MOST_POINTS) -> CachedCurve:
        """The curve below a folder that write_curve filled."""
        return cls.of(spark.read.schema(CURVE_SCHEMA).json(path), most)

    def selected(self, request: Scenario) -> dict[str, float]:
        """The last point before the first one that breaks capacity or score; zeros where the first one does."""
        p = self.points
        broken = (p["contacts"] > request.capacity) | (p["minimum_score"] < request.minimum_score)
        stop = int(np.argmax(broken)) if broken.any() else len(broken)
        if not stop:
            return dict.fromkeys(POINT, 0) | {"minimum_score": float(request.minimum_score)}
        return {name: values[stop - 1].item() for name, values in p.items()}

    def outcomes(self, request: Scenario) -> list[dict]:
        """What outcomes() gives for the request, as three records."""
        at, whole = self.selected(request), {name: (values[-1].item() if len(values) else 0) for name, values in self.points.items()}
        contacts, risk, expected = at["contacts"], at["risk_weighted_payment_proxy"], at["expected_churners"]
        spend = contacts * request.contact_cost + contacts * request.offer_cost
        over = lambda a, b: a / b if b else None
        low, high = max(0.0, request.assumed_lift - request.lift_uncertainty), min(1.0, request.assumed_lift + request.lift_uncertainty)
        even = over(spend, risk)
        same = {
            "contacts": contacts, "minimum_score": at["minimum_score"], "observed_churners": at["observed_churners"], "contact_spend": contacts * request.contact_cost, "offer_spend": contacts * request.offer_cost,
            "total_spend": spend, "break_even_lift": even, "break_even_feasible": even is not None and even <= 1, "observed_churn_rate": at["observed_churners"] / contacts if contacts else 0.0,
            "modeled_risk_capture": over(expected, whole["expected_churners"]) if contacts else 0.0, "capacity_utilization": over(float(contacts), float(request.capacity)), "eligible_subscribers": whole["contacts"],
        }
        out = []
        for name, lift in (("low", low), ("expected", float(request.assumed_lift)), ("high", high)):
            value = risk * lift
            out.append({"case_name": name, "assumed_lift": lift, "simulated_retained_subscribers": expected * lift, "simulated_retained_gross_receipt_proxy": value, "simulated_net_value": value - spend, "simulated_roi": over(value - spend, spend), **same})
        return out


def boundary_checks(cached: CachedCurve, group: int, base: Scenario) -> dict[str, bool]:
    """The named checks that a curve passes before it is served; an amount may be off by 1e-6 at most."""
    everyone = int(cached.points["contacts"][-1]) if len(cached.points["contacts"]) else 0
    ask = lambda **changed: {c["case_name"]: c for c in cached.outcomes(replace(base, **changed).validated(everyone, group))}
    usual, at, found = ask(), cached.selected(base), {}
    for name, case in usual.items():
        value, spend = at["risk_weighted_payment_proxy"] * case["assumed_lift"], at["contacts"] * (base.contact_cost + base.offer_cost)
        pairs = [("simulated_retained_subscribers", at["expected_churners"] * case["assumed_lift"]), ("simulated_retained_gross_receipt_proxy", value), ("total_spend", spend), ("simulated_net_value", value - spend)]
        found[f"formula_{name}"] = all(abs(case[k] - v) <= 1e-6 for k, v in pairs)
    none, free = ask(capacity=0)["expected"], ask(assumed_lift=0.0, lift_uncertainty=0.0)["expected"]
    found["zero_capacity"] = none["contacts"] == 0 and none["simulated_net_value"] == 0
    found["zero_lift"] = free["simulated_net_value"] == -free["total_spend"]
    found["threshold_one"] = ask(minimum_score=1.0)["expected"]["contacts"] in (0, int((cached.points["minimum_score"] >= 1).sum() * group))
    found["full_capacity"] = ask(capacity=everyone, minimum_score=0.0)["expected"]["contacts"] == everyone
    dear = ask(contact_cost=10_000.0, offer_cost=10_000.0)["expected"]
    found["high_cost_negative"] = dear["simulated_net_value"] < 0 or dear["contacts"] == 0 or dear["simulated_retained_gross_receipt_proxy"] >= dear["total_spend"]
    worthless = CachedCurve({n: np.array([{"contacts": 100, "expected_churners": 50.0}.get(n, 0.0)]) for n in POINT}).outcomes(Scenario(100, 0.0, 1.0, 1.0, 0.5))[1]
    found["zero_value"] = worthless["simulated_retained_gross_receipt_proxy"] == 0 and worthless["simulated_net_value"] == -200
    retained = [usual[n]["simulated_retained_subscribers"] for n in ("low", "expected", "high")]
    found["ordered_uncertainty"] = retained == sorted(retained)
    found["whole_prefixes"] = bool((np.diff(cached.points["contacts"]) > 0).all() and (np.diff(cached.points["minimum_score"]) <= 0).all())
    return found


CURVE_SCHEMA = "contacts long, minimum_score double, expected_churners double, observed_churners long, risk_weighted_payment_proxy double, selected_payment_proxy double"


def write_curve(points: DataFrame, path: str) -> None:
    """The points as JSON, a line each, in files by ranges of contacts."""
    typed = points.select(*(F.col(n).cast(t).alias(n) for n, t in (x.split() for x in CURVE_SCHEMA.split(", "))))
    typed.repartitionByRange(F.col("contacts")).sortWithinPartitions("contacts").write.mode("errorifexists").json(path)

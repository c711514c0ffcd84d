"""Churn model: features, split, fitting, metrics and the ship gate."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenura.functions.columns import token_bucket
from tenura.operators.boosting import Boosted, Parameters
from tenura.operators.boosting import fit as boosted
from tenura.operators.curve import places_within, prefix_sums
from tenura.operators.promote import read_report, write_report
from tenura.operators.quantiles import MEDIAN, SMALL, exact_quantiles, values_at
from tenura.operators.tasks import ship

_LOGGED = {
    "subscription_events_lifetime": "subscription_event_count_lifetime", "subscription_events_30d": "subscription_event_count_30d", "subscription_events_90d": "subscription_event_count_90d",
    **{f"gross_receipts_{s}": f"gross_receipts_{s}" for s in ("lifetime", "30d", "90d")},
    "cancellation_events_lifetime": "cancellation_event_count_lifetime", "cancellation_events_30d": "cancellation_event_count_30d",
    **{f"{n}_{s}": f"{c}_{s}" for n, c in (("listening_seconds", "listening_seconds"), ("unique_tracks", "unique_track_count"), ("full_completions", "full_completion_count"), ("play_count", "play_count")) for s in ("30d", "90d")},
}
LOG_FEATURES = tuple(f"log_{n}" for n in _LOGGED)
NUMERIC = ("tenure_days", "invalid_registration", "missing_registration", *LOG_FEATURES, "days_since_transaction", "days_to_expiration", "latest_plan_list_price", "latest_actual_amount_paid", "listening_active_days_30d", "listening_active_days_90d", "days_since_activity", "negative_duration_rows_90d", "missing_transaction", "missing_listening")
CATEGORICAL = ("registration_method_code", "latest_payment_method_id", "latest_payment_plan_days", "latest_is_auto_renew", "latest_is_cancel", "is_active_at_cutoff", "engagement_segment_code")
DIAGNOSTICS = ("is_repeat_subscriber", "diagnostic_auto_renew", "diagnostic_engagement", "diagnostic_age_band", "diagnostic_gender")
DENIED = frozenset("subscriber_token is_churn observed_renewed_within_30_days label_window history_cutoff expiration_window_start expiration_window_end renewal_observation_end registration_date registration_cohort_month latest_transaction_date effective_expiration_date latest_activity_date age_reported gender city_code is_repeat_subscriber".split())
EPSILON = float(np.finfo(np.float64).eps)


def features(snapshot: DataFrame, window: str, earlier: str) -> DataFrame:
    """29 numeric and 7 categorical features of a window's rows, with target, bucket, tie-breaker and diagnostics."""
    cutoff, registered = F.col("history_cutoff"), F.col("registration_date")
    since = lambda day: F.datediff(cutoff, day)
    flag = lambda c: c.cast("int")
    safe = lambda c: F.col(c).isNull() | (F.col(c) <= cutoff)
    code = F.lit(-1)
    for k, name in enumerate(("Dormant", "Light", "Steady", "High")):
        code = F.when(F.col("engagement_segment") == name, k).otherwise(code)
    age, gender = F.col("age_reported"), F.lower(F.coalesce("gender", F.lit("")))
    band = F.when(age.between(10, 24), 1).when(age.between(25, 34), 2).when(age.between(35, 49), 3).when(age.between(50, 80), 4).otherwise(0)
    known = registered.isNotNull() & (registered <= cutoff)
    columns = {
        "tenure_days": F.when(known, since(registered)), "invalid_registration": flag(registered > cutoff), "missing_registration": flag(registered.isNull()),
        **{f"log_{n}": F.log1p(F.greatest(F.col(c), F.lit(0)).cast("double")) for n, c in _LOGGED.items()},
        "days_since_transaction": F.coalesce(since(F.col("latest_transaction_date")), F.lit(9999)), "days_to_expiration": F.coalesce(F.datediff("effective_expiration_date", "history_cutoff"), F.lit(-9999)),
        "latest_plan_list_price": F.coalesce("latest_plan_list_price", F.lit(0)), "latest_actual_amount_paid": F.coalesce("latest_actual_amount_paid", F.lit(0)),
        "listening_active_days_30d": F.col("listening_active_days_30d"), "listening_active_days_90d": F.col("listening_active_days_90d"),
        "days_since_activity": F.coalesce(since(F.col("latest_activity_date")), F.lit(9999)), "negative_duration_rows_90d": F.col("negative_duration_rows_90d"),
        "missing_transaction": flag(F.col("latest_transaction_date").isNull()), "missing_listening": flag(F.col("latest_activity_date").isNull()),
        "registration_method_code": F.when(known, F.coalesce("registration_method_code", F.lit(-1))).otherwise(-1),
        **{c: F.coalesce(c, F.lit(-1)) for c in ("latest_payment_method_id", "latest_payment_plan_days")},
        **{c: F.coalesce(c, F.lit(2)) for c in ("latest_is_auto_renew", "latest_is_cancel")},
        "is_active_at_cutoff": flag(F.col("is_active_at_cutoff")), "engagement_segment_code": code,
        "is_churn": F.col("is_churn"), "bucket": token_bucket(F.col("subscriber_token")), "tie_breaker": F.lower(F.hex("subscriber_token")),
        "is_repeat_subscriber": flag(F.col("seen_before").isNotNull()), "diagnostic_auto_renew": F.coalesce("latest_is_auto_renew", F.lit(2)),
        "diagnostic_engagement": code, "diagnostic_age_band": band, "diagnostic_gender": F.when(gender == "male", 1).when(gender == "female", 2).otherwise(0),
    }
    before = snapshot.filter(F.col("label_window") == earlier).select("subscriber_token", F.lit(1).alias("seen_before")).distinct()
    rows = snapshot.filter((F.col("label_window") == window) & safe("latest_transaction_date") & safe("latest_activity_date")).join(before, "subscriber_token", "left")
    return rows.select(*(c.alias(n) for n, c in columns.items()))


def invalid_scores(scored: DataFrame) -> DataFrame:
    """Rows whose probability is missing, not finite or outside [0, 1]."""
    p = F.col("p")
    return scored.filter(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))


def require_scores(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """scored, once each of rows has exactly one valid probability."""
    n = scored.agg(F.count("*").alias("n"), F.count_distinct("tie_breaker").alias("kinds")).first()
    wanted, bad = rows.count(), invalid_scores(scored).count()
    if n["n"] != wanted or n["kinds"] != wanted or bad:
        raise ValueError(f"{n['n']} scores of {n['kinds']} rows for {wanted}, {bad} invalid")
    return scored


def require_allowed(names: tuple[str, ...] = (*NUMERIC, *CATEGORICAL)) -> None:
    """Raise where a feature is among the denied columns, or there twice."""
    if DENIED & set(names) or len(set(names)) < len(names):
        raise ValueError(f"features that a model may not see: {sorted(DENIED & set(names))}")


def log_loss(y: Column, p: Column) -> Column:
    """The mean log loss, an aggregate."""
    safe = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.avg(F.when(y == 1, F.log(safe)).otherwise(F.log(1 - safe)))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Equal-width bins by their literal edges; a bin holds its left edge, the last one also 1."""
    edges = np.linspace(0.0, 1.0, bins + 1)[1:-1]
    return sum(((p >= F.lit(float(e))).cast("int") for e in edges), F.lit(0))


def calibration_error(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error of (y, p), by group."""
    bins = scored.groupBy(*by, calibration_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ys"), F.sum("p").alias("ps"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("ys") - F.col("ps"))) / F.sum("n")).alias("expected_calibration_error"))


def top_decile(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lift of the best-scored tenth, ties in order of tie_breaker, by group.

    Rows are placed by range-partitioned running sums, never in one task: first the
    counts by score, which tell the score at the border, then the rows of that score.
    """
    keys, count = list(by), F.col("n")
    counts = scored.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("y").alias("ys"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("ys").alias("churned"))
    totals = totals.withColumn("selected", F.greatest(F.lit(1), F.ceil(F.col("rows") * 0.1).cast("long")))
    with_totals = lambda df: df.join(totals, keys) if keys else df.join(F.broadcast(totals))
    ranked = with_totals(places_within(counts, keys, [F.col("p").desc()], count)).withColumn("room", F.col("selected") - F.col("above")).filter("room > 0")
    full = ranked.filter("n <= room").select(*by, "ys", "n")
    border = ranked.filter("n > room").select(*(F.col(c).alias(f"edge_{c}") for c in by), F.col("p").alias("edge"), "room")
    same = F.col("p") == F.col("edge")
    for c in by:
        same = same & (F.col(c) == F.col(f"edge_{c}"))
    # a row of border per group
    at = scored.select(*by, "p", "y", "tie_breaker").join(border if keys else F.broadcast(border), same).select(*by, "y", "tie_breaker", "room")
    partial = places_within(at, keys, [F.col("tie_breaker").asc()], F.lit(1)).filter("above < room").groupBy(*by).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("ys"), F.count("*").alias("n"))
    taken = full.unionByName(partial).groupBy(*by).agg(F.sum("ys").alias("hits"), F.sum("n").alias("top_decile_rows"))
    rate = F.col("hits") / F.nullif(F.col("top_decile_rows"), F.lit(0))
    return with_totals(taken).select(*by, "top_decile_rows", rate.alias("top_decile_churn_rate"), (rate / F.nullif(F.col("churned") / F.col("rows"), F.lit(0.0))).alias("top_decile_lift"))


def metric_set(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, churn rate, log loss, calibration, lift and mean probability, by group."""
    y, p = F.col("y"), F.col("p")
    base = scored.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(y).alias("churn_rate"), log_loss(y, p).alias("log_loss"), F.avg(p).alias("average_probability"))
    parts = [calibration_error(scored, by), top_decile(scored, by)]
    return reduce(lambda a, b: a.join(b, list(by)) if by else a.join(F.broadcast(b)), parts, base)


def subgroups(scored: DataFrame, diagnostics: tuple[str, ...], minimum: int) -> DataFrame:
    """Rows, churn rate, log loss and calibration error of every diagnostic group of at least a size."""
    long = scored.select("y", "p", F.explode(F.array(*(F.struct(F.lit(d).alias("diagnostic"), F.col(d).cast("int").alias("group_code")) for d in diagnostics))).alias("g")).select("y", "p", "g.*")
    by = ("diagnostic", "group_code")
    base = long.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("y").alias("churn_rate"), log_loss(F.col("y"), F.col("p")).alias("log_loss"), F.avg("p").alias("average_probability"))
    return base.filter(F.col("rows") >= minimum).join(calibration_error(long, by), list(by))


@dataclass(frozen=True)
class Logistic:
    """A linear margin as plain numbers: (median, mean, weight by standard deviation) of each numeric feature, and the weights of the codes that were seen."""

    intercept: float
    numbers: dict[str, tuple[float, float, float]]
    codes: dict[str, dict[str, float]]

    def with_margin(self, rows: DataFrame) -> DataFrame:
        """rows with the column margin, in built-in functions; an unknown code has no weight."""
        terms = [(number(c, median) - F.lit(mean)) * F.lit(weight) for c, (median, mean, weight) in self.numbers.items()]
        for c, weights in self.codes.items():
            if weights:
                known = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair))
                terms.append(F.coalesce(F.try_element_at(known, code(c)), F.lit(0.0)))
        return rows.withColumn("margin", reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))


@dataclass(frozen=True)
class Prevalence:
    """The same margin for every row: the reference that a model has to beat, and what is left where the target has one value."""

    margin: float

    def with_margin(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("margin", F.lit(self.margin))


@dataclass(frozen=True)
class ChurnModel:
    """A fitted scorer and the sigmoid of its margin that calibrates it."""

    kind: str
    scorer: Logistic | Boosted | Prevalence
    slope: float
    intercept: float

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with their calibrated probability p."""
        p = 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("margin") + F.lit(self.intercept))))
        return self.scorer.with_margin(rows).withColumn("p", p).select(*rows.columns, "p")

    def save(self, spark: SparkSession, path: str) -> None:
        """The model's numbers as JSON below a new folder."""
        own = self.scorer.as_dict() if isinstance(self.scorer, Boosted) else asdict(self.scorer)
        write_report(spark, {"kind": self.kind, "slope": self.slope, "intercept": self.intercept, "scorer": own}, f"{path}/model.json")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChurnModel:
        own = read_report(spark, f"{path}/model.json")
        kinds = {"logistic": lambda x: Logistic(**x), "boosted": Boosted.from_dict, "prevalence": lambda x: Prevalence(**x)}
        return cls(own["kind"], kinds[own["kind"]](own["scorer"]), own["slope"], own["intercept"])


def number(column: str, median: float) -> Column:
    """A numeric feature, the median where it is missing."""
    return F.coalesce(F.nullif(F.col(column).cast("double"), F.lit(float("nan"))), F.lit(median))


def code(column: str) -> Column:
    """A coded feature as text, -1 where it is missing."""
    return F.coalesce(F.col(column).cast("int"), F.lit(-1)).cast("string")


def typed(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    """rows with features as the stages of a fit take them."""
    return rows.select(*(number(c, medians[c]).alias(f"n_{c}") for c in NUMERIC), *(code(c).alias(f"c_{c}") for c in CATEGORICAL), F.col("is_churn").cast("double").alias("label"))


def medians_of(rows: DataFrame) -> dict[str, float]:
    """The exact median of each numeric feature's values, missing ones aside; 0 where it has none.

    Few rows are sorted in one aggregation, more by brackets; the result is the same.
    """
    if rows.limit(SMALL + 1).count() <= SMALL:
        values = (F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in NUMERIC)
        found = rows.agg(*(F.median(v).alias(c) for c, v in zip(NUMERIC, values, strict=True))).first()
        return {c: found[c] if found[c] is not None else 0.0 for c in NUMERIC}
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in NUMERIC)))
    found = exact_quantiles(rows.select(pairs.alias("x")).select("x.*"), ["feature"], "value", {"median": MEDIAN}, nan_counts=False)
    return {c: 0.0 for c in NUMERIC} | {r["feature"]: r["median"] for r in found.collect() if r["median"] is not None}


def prevalence(train: DataFrame) -> ChurnModel:
    """The reference: every row has the churn rate of the rows that models are fitted on, smoothed where that is 0 or 1."""
    n = train.agg(F.count("*").alias("n"), F.sum("is_churn").alias("yes")).first()
    yes, no = n["yes"] or 0, n["n"] - (n["yes"] or 0)
    if not yes or not no:
        yes, no = yes + 1, no + 1
    return ChurnModel("prevalence", Prevalence(float(np.log(yes / no))), 1.0, 0.0)


def fit(train: DataFrame, calibrate: DataFrame, kind: str = "logistic", boosting_parameters: Parameters = Parameters()) -> ChurnModel:
    """A model fitted on train and calibrated on calibrate: L2 logistic regression or boosted trees; the prevalence where either has one class."""
    require_allowed()
    classes = [df.agg(F.count_distinct("is_churn")).first()[0] for df in (train, calibrate)]
    if kind == "prevalence" or min(classes) < 2:
        return prevalence(train)
    scorer = _logistic(train) if kind == "logistic" else boosted(train, NUMERIC, CATEGORICAL, "is_churn", boosting_parameters)
    held = scorer.with_margin(calibrate).select("margin", F.col("is_churn").cast("double").alias("label"))
    return ChurnModel(kind, scorer, *sigmoid(held))


#: Rows of a partition while a logistic model is fitted, which takes a job for each of its steps.
FIT_ROWS = 100_000


def _logistic(train: DataFrame) -> Logistic:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    numeric, coded = [f"n_{c}" for c in NUMERIC], [f"c_{c}" for c in CATEGORICAL]
    indexed, hot, medians, n = [f"{c}_x" for c in coded], [f"{c}_h" for c in coded], medians_of(train), max(1, train.count())
    stages = [
        StringIndexer(inputCols=coded, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=numeric, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="scaled"), VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
        LogisticRegression(maxIter=250, regParam=1.0 / n, elasticNetParam=0.0, standardization=False),
    ]
    fitted = Pipeline(stages=stages).fit(typed(train, medians).coalesce(-(-n // FIT_ROWS))).stages
    labels, scaler, model = fitted[0].labelsArray, fitted[3], fitted[5]
    weights = [float(w) for w in model.coefficients]
    numbers = {c: (medians[c], float(m), weights[k] / float(d) if d else 0.0) for k, (c, m, d) in enumerate(zip(NUMERIC, scaler.mean, scaler.std, strict=True))}
    codes, at = {}, len(NUMERIC)
    for c, own in zip(CATEGORICAL, labels, strict=True):
        codes[c] = dict(zip(own, weights[at : at + len(own)], strict=True))
        at += len(own)
    return Logistic(float(model.intercept), numbers, codes)


def sigmoid(held: DataFrame) -> tuple[float, float]:
    """Slope and intercept that calibrate (margin, label), with smoothed targets as two weighted rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = held.agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).first()
    high, low = (n["yes"] + 1) / (n["yes"] + 2), 1 / (n["no"] + 2)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("t"), target.alias("w")), F.struct(F.lit(0.0).alias("t"), (1 - target).alias("w"))))
    rows = held.select("margin", both.alias("x")).select("margin", F.col("x.t").alias("label"), F.col("x.w").alias("weight"))
    found = LogisticRegression(weightCol="weight", maxIter=100).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(rows))
    return float(found.coefficients[0]), float(found.intercept)


#: Rows of a block, which one task holds while replicates draw from it, and how many replicates (fixed values of the evaluation).
BLOCK_ROWS, REPLICATES, SEED = 250_000, 100, 731
MEASURES = ("relative_log_loss_improvement", "baseline_log_loss", "challenger_log_loss", "challenger_ece", "challenger_top_decile_lift")


def stratified_sample(scored: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """Exactly size rows, each class in its share of all rows: those with the smallest keyed hashes of their tie-breaker.

    The hash that ends a class is found by rank; ties at it, which only repeated
    tie-breakers or collisions give, are told apart by tie_breaker and p.
    """
    counts = {r["y"]: r["n"] for r in scored.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
    total = sum(counts.values())
    if size >= total:
        return scored
    wanted = {1: round(size * counts.get(1, 0) / total)}
    wanted[0] = size - wanted[1]
    keyed = scored.withColumn("value", F.xxhash64("tie_breaker", F.lit(seed)))
    spark = scored.sparkSession
    places = spark.createDataFrame([(y, wanted[y], n) for y, n in counts.items() if wanted[y]], "y int, rank long, n long")
    last = values_at(keyed.select(F.col("y").cast("int").alias("y"), "value"), ["y"], places).select(F.col("y").alias("of_y"), F.col("rank").alias("wanted"), F.col("value").alias("last"))
    near = keyed.join(F.broadcast(last), F.col("y") == F.col("of_y")).filter(F.col("value") <= F.col("last"))
    below = near.filter(F.col("value") < F.col("last")).groupBy("y").agg(F.count("*").alias("below")).withColumnRenamed("y", "of")
    at_end = near.filter(F.col("value") == F.col("last")).join(F.broadcast(below), F.col("y") == F.col("of"), "left")
    place = F.row_number().over(W.partitionBy("y").orderBy("tie_breaker", "p"))  # over the rows of one hash
    ends = at_end.withColumn("place", place).filter(F.col("place") <= F.col("wanted") - F.coalesce("below", F.lit(0)))
    return near.filter(F.col("value") < F.col("last")).select(*scored.columns).unionByName(ends.select(*scored.columns))


def block_draws(n: int, block: int, number: int, seed: int = SEED, size: int = BLOCK_ROWS) -> tuple[int, int]:
    """How many of a replicate's n draws from n rows fall on blocks before this one, and how many on it.

    The draws are halved by binomials down to the block, so that all blocks have a
    multinomial's counts and no task needs a list of them.
    """
    low, high, before, draws = 0, -(-n // size), 0, n
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * size / (min(high * size, n) - low * size)
        left = int(np.random.default_rng([seed, number, low, high]).binomial(draws, share))
        if block < middle:
            high, draws = middle, left
        else:
            low, before, draws = middle, before + left, draws - left
    return before, draws


def block_sums(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, block: int, replicates: int = REPLICATES, seed: int = SEED, size: int = BLOCK_ROWS) -> np.ndarray:
    """What each replicate's draws from a block add to the sums that measures() takes, a row a replicate.

    rows are the block's (y, base, p) in the order of the top decile. The draws before
    it tell how many of its own are still in that decile.
    """
    y, base, p = rows
    losses = [-np.where(y == 1, np.log(q), np.log1p(-q)) for q in (np.clip(x, EPSILON, 1 - EPSILON) for x in (base, p))]
    place, count, found = np.digitize(p, np.linspace(0.0, 1.0, 11)[1:-1]), max(1, int(np.ceil(n * 0.1))), []
    for number in range(replicates):
        before, draws = block_draws(n, block, number, seed, size)
        # what a seed lacks counts as 0: the first block's draws are those of [seed, number]
        weight = np.bincount(np.random.default_rng([seed, number, block]).integers(0, len(y), draws), minlength=len(y))
        differences = np.bincount(place, weight * y, 10) - np.bincount(place, weight * p, 10)
        taken = np.clip(count - before - (np.cumsum(weight) - weight), 0, weight)
        found.append([*((weight * x).sum() for x in losses), (weight * y).sum(), (taken * y).sum(), *differences])
    return np.array(found, dtype=float)


def measures(sums: np.ndarray, n: int) -> list[float]:
    """MEASURES of a replicate of n rows, from the sums over all its blocks."""
    base, loss, churned, hits = sums[0] / n, sums[1] / n, sums[2], sums[3]
    lift = hits / max(1, int(np.ceil(n * 0.1))) / (churned / n) if churned else float("nan")
    return [(base - loss) / base, base, loss, np.abs(sums[4:]).sum() / n, lift]


def bootstrap(scored: DataFrame, replicates: int = REPLICATES, size: int | None = None, seed: int = SEED, block: int = BLOCK_ROWS) -> DataFrame:
    """(measure, low, high): 95% intervals of p over base, from paired replicates of as many draws as rows, with replacement.

    Every row may be drawn; only where a size is given do replicates draw from a fixed
    stratified sample of so many rows. Rows are placed in the order of the top decile and
    dealt to tasks as blocks of consecutive ones, whose sums are added up by replicate. A
    block's draws come of its number and the replicate's, so that a task that runs again
    draws the same; sums are rounded once, in whatever order blocks come. Without rows
    there are no intervals.
    """
    spark = scored.sparkSession
    rows = scored.select("tie_breaker", "y", "p", "base")
    rows = rows if size is None else stratified_sample(rows, size, seed)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "measure string, low double, high double")

    def draw(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        own = group.column("block")[0].as_py()
        found = block_sums(tuple(group.column(c).to_numpy() for c in ("y", "base", "p")), n, own, replicates, seed, block)
        return pa.table({"replicate": np.arange(replicates), "sums": list(found)})

    def finish(group: pa.Table) -> pa.Table:
        sums = np.array([fsum(column) for column in zip(*group.column("sums").to_pylist(), strict=True)])
        found = [group.column("replicate")[0].as_py(), *measures(sums, n)]
        return pa.table([pa.array([x], from_pandas=True) for x in found], ["replicate", *MEASURES])

    ship(spark)
    order = [F.col("p").desc(), F.col("tie_breaker").asc(), F.col("base").asc(), F.col("y").asc()]
    placed = prefix_sums(rows, order, {}, "place").select("place", F.expr(f"(place - 1) div {block}").alias("block"), "y", "base", "p")
    sums = placed.groupBy("block").applyInArrow(draw, "replicate long, sums array<double>")
    each = sums.groupBy("replicate").applyInArrow(finish, "replicate long, " + ", ".join(f"{m} double" for m in MEASURES))  # a row a block
    long = each.unpivot("replicate", list(MEASURES), "measure", "value")
    return long.groupBy("measure").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))  # of the replicates


def ships(improvement: float, improvement_low: float, ece: float, lift: float, lift_low: float) -> bool:
    """Whether a challenger passes all five conditions."""
    return improvement >= 0.05 and improvement_low > 0 and ece <= 0.03 and lift >= 2.0 and lift_low > 1.0


def decision(all_rows: bool, repeat_rows: bool, new_ece: float) -> str:
    """The release decision from the gates on all and on repeat subscribers, and the newcomers' calibration."""
    if not (all_rows and repeat_rows):
        return "retain_baseline"
    return "ship_challenger_repeat_only" if new_ece > 0.03 else "ship_challenger"

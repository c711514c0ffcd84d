"""The canonical facts from the order, customer and event tables.

Each expression is deterministic and in integers or decimals, so that another
engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.contracts import DEFAULT, Settings
from tenura.functions.columns import subscriber_token

#: Registration channels of the market segments; others have 13.
CHANNELS = {"AUTOMOBILE": 3, "BUILDING": 4, "FURNITURE": 7, "HOUSEHOLD": 9}
KINDS = {"signup": "num_25", "view": "num_50", "click": "num_75", "error": "num_985", "purchase": "num_100"}
#: Days of plans by order number.
PLANS = (90, 180, 365, 730)
#: The first day of the second delivery of activity.
SECOND_DELIVERY = "2000-06-25"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim_member: a row per customer."""
    first = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("registration_date"))
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    channel = F.lit(13)
    for name, code in CHANNELS.items():
        channel = F.when(segment == name, code).otherwise(channel)
    return read(spark, sf_dir, "customer").join(first, "c_custkey", "left").select(
        subscriber_token(key).alias("subscriber_token"),
        F.col("c_nationkey").cast("int").alias("city_code"),
        (key % 97).cast("int").alias("age_reported"),
        F.when(key % 3 == 0, "female").when(key % 3 == 1, "male").alias("gender"),
        channel.alias("registration_method_code"),
        "registration_date",
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment events as delivered: two versions, with repeats within and across them."""
    key = F.col("o_orderkey")
    listed = F.round(F.col("o_totalprice") * 100).cast("long")
    plan = F.element_at(F.array(*map(F.lit, PLANS)), (key % 4 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    rows = read(spark, sf_dir, "orders").select(
        subscriber_token(F.col("o_custkey")).alias("subscriber_token"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"),
        plan.alias("payment_plan_days"),
        listed.alias("plan_list_price"),
        F.when(F.col("o_orderstatus") == "P", listed - F.expr("CAST(round(o_totalprice * 100) AS BIGINT) div 10")).otherwise(listed).alias("actual_amount_paid"),
        (F.col("o_orderstatus") == "O").cast("int").alias("is_auto_renew"),
        day.alias("transaction_date"),
        F.date_add(day, plan).alias("membership_expire_date"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")).cast("int").alias("is_cancel"),
        key.alias("order_number"),
    )
    number = F.col("order_number")
    own, other = F.when(number % 2 == 0, "v1").otherwise("v2"), F.when(number % 100 == 0, "v1").when(number % 50 == 0, "v2")
    versions = F.array_compact(F.array(own, other))
    return rows.withColumn("source_version", F.explode(versions)).drop("order_number")


def raw_listening(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> DataFrame:
    """fact_listening_day: a row per subscriber and day, from all events; a subscriber's days are those of their rhythm, every 1 to 12 days, so that all segments occur."""
    user = F.col("user_id")
    shifted = F.date_sub(F.to_date("ts"), settings.activity_shift_days)
    day = F.date_sub(shifted, (F.unix_date(shifted) % (1 + user % 12)).cast("int"))
    seconds = F.sum((F.col("value") - 10).cast("decimal(18,2)"))
    counts = [F.count_if(F.col("event_type") == kind).cast("int").alias(name) for kind, name in KINDS.items()]
    daily = read(spark, sf_dir, "events").groupBy(user.alias("user_id"), day.alias("activity_date")).agg(*counts, F.count_distinct("props").cast("int").alias("num_unq"), seconds.alias("seconds"))
    return daily.select(
        subscriber_token(F.col("user_id")).alias("subscriber_token"),
        "activity_date",
        *KINDS.values(),
        "num_unq",
        F.greatest("seconds", F.lit(0).cast("decimal(28,2)")).cast("decimal(18,2)").alias("total_secs"),
        (F.col("seconds") < 0).alias("total_secs_was_negative"),
        F.when(F.col("activity_date") < F.lit(SECOND_DELIVERY).cast("date"), "v1").otherwise("v2").alias("source_version"),
        F.expr("year(activity_date) * 100 + month(activity_date)").cast("int").alias("activity_month"),
    )

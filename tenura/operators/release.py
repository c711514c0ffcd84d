"""The row-level public release: new keys, generalised attributes, and its verification."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.columns import age_band_start, month_of, public_key
from tenura.operators.promote import read_report, write_report

#: The release's columns (fixed values of the published format).
COLUMNS = {
    "member": ("subscriber_key", "city_code", "age_band_start", "gender", "registration_method_code", "registration_month"),
    "subscription_transaction": ("event_key", "subscriber_key", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel", "source_versions"),
    "churn_label": ("subscriber_key", "label_window", "is_churn"),
    "listening_day": ("subscriber_key", "activity_date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs", "total_secs_was_negative", "source_version"),
}


#: The setting that holds the publication salt, so that it comes from the deployment's secrets and from no file of this package.
SALT_SETTING = "spark.tenura.release.salt"


def publication_salt(spark: SparkSession, default: str | None = None) -> str:
    """The salt of the session's settings, or the default where none is set; refused unless it has 256 bits in hexadecimal."""
    salt = spark.conf.get(SALT_SETTING, default) or ""
    if len(salt) != 64 or set(salt) - set("0123456789abcdef"):
        raise ValueError(f"{SALT_SETTING} has 64 lower-case hexadecimal digits, as new_salt() makes them")
    return salt


def new_salt() -> str:
    """A salt to keep among the deployment's secrets: whoever loses it can't publish under the same keys again."""
    return secrets.token_hex(32)


def released(table: str, fact: DataFrame, salt: str) -> DataFrame:
    """One of the release's tables from its fact."""
    keyed = fact.withColumn("subscriber_key", public_key(F.col("subscriber_token"), salt))
    if table == "member":
        known = F.when(F.col("gender").isin("female", "male"), F.col("gender"))
        keyed = keyed.withColumns({"age_band_start": age_band_start(F.col("age_reported")), "gender": known, "registration_month": month_of(F.col("registration_date"))})
    elif table == "subscription_transaction":
        keyed = keyed.withColumn("event_key", public_key(F.col("event_key"), salt))
    return keyed.select(*COLUMNS[table])


def verification(tables: dict[str, DataFrame], facts: dict[str, DataFrame]) -> DataFrame:
    """(table_name, released_rows, fact_rows, null_keys, repeated_keys) of each table."""
    grain = {"member": ["subscriber_key"], "subscription_transaction": ["event_key"], "churn_label": ["subscriber_key", "label_window"], "listening_day": ["subscriber_key", "activity_date"]}
    out = None
    for name, df in tables.items():
        keys = grain[name]
        counts = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("released_rows"), F.coalesce(F.sum(F.when(F.col(keys[0]).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"))
        row = counts.join(F.broadcast(facts[name].agg(F.count("*").alias("fact_rows")))).select(F.lit(name).alias("table_name"), "released_rows", "fact_rows", "null_keys", "repeated_keys")
        out = row if out is None else out.unionByName(row)
    return out


def write_release(tables: dict[str, DataFrame], path: str) -> None:
    """All tables below a new folder: events in two parts by the key's parity, labels by window, activity by month."""
    for name, df in tables.items():
        if name == "subscription_transaction":
            df = df.withColumn("part", F.col("event_key") % 2)
            writer = df.write.partitionBy("part")
        elif name == "churn_label":
            writer = df.withColumn("window", F.col("label_window")).write.partitionBy("window")
        elif name == "listening_day":
            writer = df.withColumn("activity_month", F.date_format("activity_date", "yyyyMM").cast("int")).write.partitionBy("activity_month")
        else:
            writer = df.write
        writer.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/{name}")


def wrong_pseudonyms(table: str, released_rows: DataFrame, fact: DataFrame, salt: str) -> DataFrame:
    """Keys that only one side has, when those of the fact are computed again: (subscriber_key, released_rows, fact_rows)."""
    count = lambda df, name: df.groupBy("subscriber_key").agg(F.count("*").alias(name))
    again = count(fact.select(public_key(F.col("subscriber_token"), salt).alias("subscriber_key")), "fact_rows")
    both = count(released_rows.select("subscriber_key"), "released_rows").join(again, "subscriber_key", "full")
    return both.filter(~F.col("released_rows").eqNullSafe(F.col("fact_rows"))).select("subscriber_key", "released_rows", "fact_rows")


def verified_files(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, files, bytes, rows) of a written release; raises where a table's columns aren't the format's."""
    out = None
    for name, columns in COLUMNS.items():
        rows = spark.read.parquet(f"{path}/{name}")
        found = [c for c in rows.columns if c not in ("part", "window") and not (c == "activity_month" and name == "listening_day")]
        if tuple(found) != columns:
            raise ValueError(f"{name} has the columns {found}")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/{name}").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        row = files.join(F.broadcast(rows.agg(F.count("*").alias("rows")))).select(F.lit(name).alias("table_name"), "files", "bytes", "rows")
        out = row if out is None else out.unionByName(row)
    return out


def manifest(spark: SparkSession, path: str) -> dict:
    """What a written release holds: path, rows and bytes of each file, and the totals. Rows come from footers; a row for each file reaches the driver."""
    files, names = [], list(COLUMNS)
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        sizes = _files(spark, f"{path}/{name}").withColumnRenamed("path", "at")
        found = sizes.join(rows, F.col("at") == F.col("path"), "left").collect()
        files += [{"path": f"{name}/" + r["at"].split(f"/{name}/", 1)[1], "rows": r["rows"] or 0, "bytes": r["length"]} for r in found]
    files.sort(key=lambda f: f["path"])
    return {"files": files, "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files)}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")


def write_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, written beside the tables."""
    found = manifest(spark, path)
    write_report(spark, found, f"{path}/manifest.json")
    return found


def manifest_problems(spark: SparkSession, path: str) -> list[str]:
    """Where a release isn't what its manifest says: totals that don't add up, files that are missing, new or of another size or count."""
    said, found = read_report(spark, f"{path}/manifest.json"), manifest(spark, path)
    out = [f"{k} don't add up" for k in ("rows", "bytes") if said[k] != sum(f[k] for f in said["files"])]
    a, b = ({f["path"]: f for f in m["files"]} for m in (said, found))
    out += [f"{p} is missing" for p in sorted(a.keys() - b.keys())] + [f"{p} isn't listed" for p in sorted(b.keys() - a.keys())]
    return out + [f"{p} has {b[p][k]} {k}, not {a[p][k]}" for p in sorted(a.keys() & b.keys()) for k in ("rows", "bytes") if a[p][k] != b[p][k]]

"""Column builders shared by facts, features and releases; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_HEX = 24


def subscriber_token(source_id: Column) -> Column:
    """The first 12 bytes of the SHA-256 of a source id."""
    return F.unhex(F.substring(F.sha2(source_id.cast("string"), 256), 1, TOKEN_HEX))


def event_key(token: Column, *parts: Column) -> Column:
    """12 bytes that stand for a whole event; the token goes in as hex, since binary doesn't survive concat_ws."""
    text = F.concat_ws("|", F.hex(token), *(p.cast("string") for p in parts))
    return F.unhex(F.substring(F.sha2(text, 256), 1, TOKEN_HEX))


def public_key(token: Column, salt: str) -> Column:
    """A salted 64-bit pseudonym; unsigned, so decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat(F.hex(token), F.lit(salt)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def compact_date(value: Column) -> Column:
    """A YYYYMMDD integer as a date; 0 and null are null."""
    return F.when(value.isNotNull() & (value != 0), F.to_date(value.cast("string"), "yyyyMMdd"))


def token_bucket(token: Column, buckets: int = 10) -> Column:
    """A portable split bucket from the token's first four bytes."""
    return F.pmod(F.conv(F.substring(F.hex(token), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def within(day: Column, cutoff: Column, days: int) -> Column:
    """day is one of the last so many days up to the cutoff, which counts."""
    return (day > F.date_sub(cutoff, days)) & (day <= cutoff)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def churn_from_gap(gap_days: Column, limit: int = 30) -> Column:
    """1 where there is no renewal or only after the limit, else 0."""
    return F.when(gap_days.isNull() | (gap_days >= limit), 1).otherwise(0)


def age_band_start(age: Column) -> Column:
    return F.when(age.between(10, 99), (F.floor(age / 10) * 10).cast("int"))


def engagement_segment(active_days: Column) -> Column:
    """Dormant 0, Light up to 5, Steady up to 15, High beyond."""
    days = F.coalesce(active_days, F.lit(0))
    return F.when(days == 0, "Dormant").when(days <= 5, "Light").when(days <= 15, "Steady").otherwise("High")

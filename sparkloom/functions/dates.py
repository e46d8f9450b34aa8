"""Dates: freshness, durations, liveness. `as_of` is always a parameter; nothing reads a clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400_000_000
#: Limits in days and their labels.
RANGES = ((30, "Within 30 days"), (90, "Within 90 days"), (180, "Within 180 days"), (365, "Within 365 days"))
OLDER, UNKNOWN = "Older than a year", "Unknown"
RANGE_ORDER = (*(label for _, label in RANGES), OLDER, UNKNOWN)


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without zone (taken as UTC), or of an ISO text; null for what is none."""
    return F.unix_micros(ts.try_cast("timestamp"))


def freshness(updated: Column, as_of: Column) -> Column:
    """struct<days int, range string, index double>: age in whole days, its label by the exact age, and an index that
    halves every 180 days. Dates in the future have age 0, missing or bad ones are Unknown."""
    old = (micros(as_of) - micros(updated)) / F.lit(float(DAY))
    age = F.when(old.isNotNull(), F.greatest(F.lit(0.0), old))  # greatest() alone passes over nulls
    label = F.when(age.isNull(), UNKNOWN)
    for days, name in RANGES:
        label = label.when(age <= days, name)
    return F.struct(F.floor(age).cast("int").alias("days"), label.otherwise(OLDER).alias("range"), F.round(100 * F.pow(F.lit(2.0), -age / 180), 1).alias("index"))


def range_rank(label: Column) -> Column:
    """0 for the freshest range; null for Unknown and other labels."""
    out = F.when(label == OLDER, len(RANGES))
    for i, (_, name) in enumerate(RANGES):
        out = out.when(label == name, i)
    return out


def seconds_between(start: Column, end: Column) -> Column:
    """Null if either is missing or the end comes first."""
    s = (micros(end) - micros(start)) / F.lit(1e6)
    return F.when(s >= 0, s)


def whole_days(start: Column, end: Column) -> Column:
    """Days rounded down, also below zero."""
    return F.floor((micros(end) - micros(start)) / F.lit(float(DAY)))


def liveness_bucket(known: Column, archived: Column, last: Column, as_of: Column) -> Column:
    """struct<bucket, label, days>. An unknown record, then an archived one, then one without activity; then by age in
    days: up to 90 active, up to 365 slowing, else stale."""
    days = whole_days(last, as_of)
    said = lambda b, t, d=None: F.struct(F.lit(b).alias("bucket"), F.lit(t).alias("label"), (F.lit(None) if d is None else d).cast("long").alias("days"))
    return (
        F.when(~F.coalesce(known, F.lit(False)), said("unknown", "Not yet observed"))
        .when(F.coalesce(archived, F.lit(False)), said("archived", "Archived by its owner"))
        .when(days.isNull(), said("unknown", "No push activity observed"))
        .when(days <= 90, said("active", "Active", days))
        .when(days <= 365, said("slowing", "Slowing down", days))
        .otherwise(said("stale", "Inactive", days))
    )

"""Dates: parsing, reference dates, ages and cadence. ``as_of`` is always an argument; nothing reads the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def as_timestamp(as_of: datetime | str) -> Column:
    return F.lit(as_of).cast("timestamp")


def parse_posted_at(raw: Column) -> Column:
    """ISO dates and times, with or without offset, as instants; anything else, epoch numbers included, is null."""
    text = F.trim(raw)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    offset = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    fixed = F.when(text.rlike(r"T.*[+-]\d{4}$"), offset).otherwise(text)
    return F.when(iso, F.try_to_timestamp(fixed))


def not_after(moment: Column, limit: Column) -> Column:
    """The moment, or null where it lies after the limit."""
    return F.when(moment <= limit, moment)


def feed_date(posted_at: Column, first_seen_at: Column) -> Column:
    """Date the feed filters by: the posting's own where it precedes the first sighting."""
    return F.when(posted_at < first_seen_at, posted_at).otherwise(first_seen_at)


def reference_date(posted_at: Column, first_seen_at: Column) -> Column:
    """Date that scoring counts age from."""
    return F.coalesce(posted_at, first_seen_at)


def age_days(moment: Column, as_of: datetime | str) -> Column:
    """Whole days since the moment, rounded down also below zero."""
    return F.floor((F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp(moment)) / DAY).cast("int")


def within_days(moment: Column, days: int, as_of: datetime | str) -> Column:
    """The whole cutoff day counts."""
    return F.to_date(moment) >= F.date_sub(F.to_date(as_timestamp(as_of)), days)


def months_after(day: Column, months: int) -> Column:
    """Same day of the month, or the month's last."""
    return F.add_months(day, months)


def sheet_date(cell: Column) -> Column:
    """struct(day, marked, readable) of a cell: empty, ``?`` or dd/mm/yyyy."""
    text = F.trim(F.regexp_replace(cell, r"(?U)\s+", " "))
    day = F.try_to_date(text, "d/M/yyyy") if hasattr(F, "try_to_date") else F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date")
    ok = text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.struct(F.when(ok, day).alias("day"), (text == "?").alias("marked"), ((text == "") | (text == "?") | (ok & day.isNotNull())).alias("readable"))


def folder_date(leaf: Column, oldest: Column) -> Column:
    """struct(day, estimated): the day that a folder is named after, else that of its oldest file."""
    ok = leaf.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$")
    day = F.when(ok, F.try_to_timestamp(leaf, F.lit("d-M-yyyy")).cast("date"))
    return F.struct(F.coalesce(day, oldest).alias("day"), day.isNull().alias("estimated"))


def age_label(days: Column) -> Column:
    """``3d`` below two weeks, else whole weeks."""
    return F.when(days < 14, F.concat(days.cast("string"), F.lit("d"))).otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit("w")))


def days_left(deadline: Column, as_of: datetime | str) -> Column:
    return F.ceil((F.unix_timestamp(deadline) - F.unix_timestamp(as_timestamp(as_of))) / DAY).cast("int")


def due(priority: Column, last_attempt: Column, as_of: datetime | str) -> Column:
    """Priority 1 is always due, 2 after a day, 3 after a week; never attempted is due."""
    since = F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp(last_attempt)
    wait = F.when(priority == 2, DAY).when(priority == 3, 7 * DAY).otherwise(0)
    return (priority <= 1) | last_attempt.isNull() | (since >= wait)


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def date_in_text(day: Column, text: Column) -> Column:
    """Whether year, day number and month (number or name) of a date all stand in the text."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("int"))
    low = F.lower(text)
    name = F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1)
    month = F.array_contains(numbers, F.month(day)) | low.contains(name) | low.contains(F.left(name, F.lit(3)))
    return F.coalesce(F.array_contains(numbers, F.year(day)) & F.array_contains(numbers, F.dayofmonth(day)) & month, F.lit(False))

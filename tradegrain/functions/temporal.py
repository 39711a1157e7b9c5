"""Elapsed time, calendar parts and the separate lateness rules.

Timestamps are TIMESTAMP_NTZ, so nothing here depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradegrain.functions.numeric import ratio

SECONDS_PER_DAY = 86400.0


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Exact seconds with six decimals; sums of it do not depend on row order."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)")


def elapsed_days(later: Column, earlier: Column) -> Column:
    return elapsed_seconds(later, earlier).cast("double") / SECONDS_PER_DAY


def mean_elapsed(later: Column, earlier: Column, unit_seconds: float = SECONDS_PER_DAY) -> Column:
    """Average elapsed time in the given unit from an exact sum of seconds."""
    seconds = elapsed_seconds(later, earlier)
    return ratio(F.sum(seconds), F.count(seconds)) / unit_seconds


def days_truncated(later: Column, earlier: Column) -> Column:
    """The day field of an interval: -1.5 days gives -1."""
    return F.extract(F.lit("DAY"), later - earlier)


def days_floored(later: Column, earlier: Column) -> Column:
    """Whole days rounded down: -1.5 days gives -2."""
    return F.floor(elapsed_days(later, earlier))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM").cast("timestamp_ntz")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def lenient_timestamp(text: Column) -> Column:
    """Parse text; a value that is no timestamp becomes null. The session zone plays no part."""
    return text.try_cast("timestamp_ntz")


def strict_timestamp(text: Column) -> Column:
    """Parse text; a value that is no timestamp fails the query."""
    return text.cast("timestamp_ntz")


# One function per lateness rule: they disagree on part-days and on missing dates.


def late_by_clock(delivered: Column, promised: Column) -> Column:
    """Delivered after the promised instant; null when either is missing."""
    return delivered > promised


def late_or_not(delay_days: Column) -> Column:
    """Fractional delay above zero; a missing delay is not late."""
    return F.coalesce(delay_days > 0, F.lit(False))


def late_label(is_late: Column) -> Column:
    return F.when(is_late, "Late").otherwise("On-Time")


def late_by_truncated_days(delivered: Column, promised: Column) -> Column:
    """At least one whole day late by the interval's day field; null when undelivered."""
    return days_truncated(delivered, promised) > 0


def late_by_floored_days(delivered: Column, promised: Column) -> Column:
    """At least one whole day late by floored days; a missing date is not late."""
    return F.coalesce(days_floored(delivered, promised) > 0, F.lit(False))


def delivered_label(delivered: Column, promised: Column) -> Column:
    """Two-way label for rows that have both dates."""
    return F.when(delivered > promised, "Late").otherwise("On Time")


def delivery_outcome(delivered: Column, promised: Column) -> Column:
    """Three-way label; rows with a missing date are ``Unknown``."""
    return (
        F.when(delivered <= promised, "On Time").when(delivered > promised, "Late").otherwise("Unknown")
    )

"""Dates and times as they are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMATS = ["h:mm a", "h:mma", "h a", "ha", "HH:mm", "HH:mm:ss"]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def title_date(title: Column) -> Column:
    """Date at the end of a title such as "Council - Sep 30, 2026"; null without one."""
    found = F.regexp_extract(title, r"\b([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}), (\d{4})\b", 0)
    short = F.regexp_replace(found, r"^([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}), (\d{4})$", "$1 $2 $3")
    return F.to_date(F.try_to_timestamp(short, F.lit("MMM d yyyy")))


def printed_date(text: Column) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in DATE_FORMATS])


def combined(date_text: Column, time_text: Column) -> Column:
    """Timestamp of a printed date and time; midnight if the time can't be read, null if the date can't."""
    day = printed_date(date_text)
    clock = F.upper(F.regexp_replace(F.trim(time_text), r"(?i)\b([ap])\.?m\.?", "$1m"))
    at = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), clock), F.lit("yyyy-MM-dd " + f)) for f in TIME_FORMATS])
    seconds = F.coalesce(F.unix_seconds(at), F.lit(0))
    return F.when(day.isNotNull(), F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3_600_000_000.0


def percentage(part: Column, whole: Column) -> Column:
    """Share in per cent with one decimal; zero of nothing is zero."""
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(F.lit(0.0))


def late_addition(created: Column, meeting_created: Column, meeting_at: Column) -> Column:
    """True for rows added over six hours after their meeting's row and in the last 72 hours before it."""
    return (created > meeting_created + F.expr("interval 6 hours")) & (created >= meeting_at - F.expr("interval 72 hours")) & (created <= meeting_at)


def sync_due(last_sync: Column, recent: Column, now: Column) -> Column:
    """True if a source has not been visited for 12 hours (two or more recent meetings), a day (one), or a week."""
    hours = F.when(recent >= 2, 12).when(recent == 1, 24).otherwise(168)
    return last_sync.isNull() | (hours_between(now, last_sync) >= hours)

"""ISO times: precision, truncation, canonical forms, window checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precisions from coarse to fine, and the length of an ISO text cut to each.
LENGTHS = {"year": 4, "month": 7, "day": 10, "hour": 13, "minute": 16, "second": 19}


def precision_of(iso: Column) -> Column:
    """Date parts tell year, month or day; a time tells hour, minute or, with other seconds than zero, second."""
    date, time = F.split(iso, "T")[0], F.regexp_replace(F.get(F.split(iso, "T"), F.lit(1)), r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    parts, clock = F.size(F.split(date, "-")), F.size(F.split(time, ":"))
    by_date = F.when(parts == 1, "year").when(parts == 2, "month").otherwise("day")
    by_time = F.when(clock == 1, "hour").when((clock == 2) | time.endswith(":00"), "minute").otherwise("second")
    return F.when(iso.contains("T"), by_time).otherwise(by_date)


def coarser(a: Column, b: Column) -> Column:
    """The coarser of two precisions; an unknown one counts as year."""
    order = F.array(*map(F.lit, LENGTHS))
    rank = lambda c: F.greatest(F.coalesce(F.array_position(order, c), F.lit(1)), F.lit(1))
    return F.element_at(order, F.least(rank(a), rank(b)).cast("int"))


def truncate_to(iso: Column, precision: Column) -> Column:
    lengths = F.create_map(*(F.lit(x) for kv in LENGTHS.items() for x in kv))
    return F.substr(iso, F.lit(1), F.coalesce(lengths[precision], F.lit(4)))


def canonical_iso(iso: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(iso), r"(?i)(?:z|\+00:?00)$", ""))


def expand_single_day(start: Column, end: Column) -> tuple[Column, Column]:
    """A window of one day, from midnight to midnight or the day's last second, ends at the next midnight."""
    midnight = F.date_trunc("day", start)
    single = (start == midnight) & ((end == midnight) | (end == midnight + F.expr("interval 1 day - interval 1 second")))
    return F.when(single, midnight + F.expr("interval 1 day")).otherwise(end), single


def bumped_end(start: Column, end: Column) -> Column:
    """The end, a day later if it is on the day of the start."""
    return F.when(F.to_date(start) == F.to_date(end), end + F.expr("interval 1 day")).otherwise(end)


def duration_class(start: Column, end: Column) -> Column:
    seconds = F.unix_seconds(end) - F.unix_seconds(start)
    return F.when(seconds <= 0, "invalid").when(seconds > 3650 * 86400, "long").when(seconds < 3600, "short").otherwise("ok")


def names_year(text: Column) -> Column:
    return text.rlike(r"\b(?:19|20)\d{2}\b")


def parse_utc(iso: Column) -> Column:
    """The moment that an ISO text tells, null for one that tells none."""
    return F.try_to_timestamp(iso)

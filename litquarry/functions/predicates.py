"""Column predicates: text filters, tag sets, half-open time windows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def icontains(column: Column, needle: str) -> Column:
    """Case-insensitive substring; wildcards have no meaning."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def composite_keys(source: Column, name: Column, keys: Iterable[str]) -> Column:
    """``source:name`` keys match both columns, plain keys the name; any may match. The first colon splits."""
    found = []
    for key in keys:
        head, colon, tail = key.partition(":")
        found.append((source == head) & (name == tail) if colon else name == key)
    return any_of(found)


def overlaps(start: Column, end: Column, query_start: Column, query_end: Column) -> Column:
    """A closed window meets a half-open query window; an empty query meets nothing."""
    return (query_start < query_end) & (start < query_end) & (end >= query_start)


def from_date(start: Column, end: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Only a first date: the window ends on it or later. Only a last one: it starts on it or before. Both: they overlap."""
    if first is not None and last is not None:
        return overlaps(start, end, first, last)
    return end >= first if first is not None else start <= last if last is not None else F.lit(True)


def end_of_day(moment: Column) -> Column:
    return F.date_trunc("day", moment) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")


def has_all(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0, F.lit(False))


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def nonempty_window(start: Column, end: Column) -> Column:
    return start.isNotNull() & end.isNotNull() & (start <= end)


def regex_bank(text: Column, exclude: list[str], strong: list[str], medium: list[str]) -> Column:
    """Excluding patterns veto; one strong or two medium patterns accept; null and empty text never."""
    hit = lambda p: text.rlike(f"(?i){p}")
    score = reduce(lambda a, b: a + b, [hit(p).cast("int") for p in medium], F.lit(0))
    return F.coalesce((text != "") & ~any_of(map(hit, exclude)) & (any_of(map(hit, strong)) | (score >= 2)), F.lit(False))


def client_order(fields: Iterable[str], allowed: Iterable[str], tie: str) -> list[Column]:
    """Sort keys for the fields that are allowed, in the order asked for, each once; a leading minus turns one round."""
    known, keys, seen = set(allowed), [], set()
    for field in fields:
        name = field.removeprefix("-")
        if name in known and name not in seen:
            seen.add(name)
            keys.append(F.desc_nulls_first(name) if field.startswith("-") else F.asc_nulls_last(name))
    return [*keys, F.asc(tie)]


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))

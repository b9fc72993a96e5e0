"""Whether two answers to the same question agree, for each kind of call. An answer that cannot be parsed is null and agrees with none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litquarry.functions.statistics import same_within, set_metrics

TIME = "start string, end string, precision string, error boolean"
WAVELENGTH = "type string, unit string, values array<double>"
STRUCTURE = "instruments array<struct<name: string>>"


def parsed(text: Column, schema: str) -> Column:
    """A JSON answer as a struct; null for anything else than a JSON object."""
    return F.when(F.get_json_object(text, "$").startswith("{"), F.from_json(text, schema))


def _both(a: Column, b: Column, agree: Column) -> Column:
    return F.coalesce(a.isNotNull() & b.isNotNull() & agree, F.lit(False))


def same_sets(a: Column, b: Column) -> Column:
    """Two arrays hold the same elements, however often and in whatever order."""
    return _both(a, b, F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b))))


def times_agree(a: Column, b: Column) -> Column:
    """Both tell an error, or neither does and start, end and precision are equal."""
    wrong = lambda x: F.coalesce(x["error"], F.lit(False))
    equal = ~wrong(a) & ~wrong(b) & a["start"].eqNullSafe(b["start"]) & a["end"].eqNullSafe(b["end"]) & a["precision"].eqNullSafe(b["precision"])
    return _both(a, b, (wrong(a) & wrong(b)) | equal)


def identifications_agree(a: Column, b: Column, a_unknown: Column, b_unknown: Column) -> dict[str, Column]:
    """``agree``: both unknown, or the same indices. Also whether the first index is the same, and the Jaccard index."""
    return {
        "agree": (a_unknown & b_unknown) | (~a_unknown & ~b_unknown & same_sets(a, b)),
        "same_first": F.coalesce(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(False)),
        "jaccard": F.when(a.isNotNull() & b.isNotNull(), set_metrics(a, b)["jaccard"]).otherwise(F.lit(0.0)),
    }


def selections_agree(a: Column, b: Column) -> Column:
    """The same indices, or both ambiguous, which a zero tells."""
    vague = lambda x: F.array_contains(x, 0)
    return same_sets(a, b) | _both(a, b, vague(a) & vague(b))


def detectors_agree(a: Column, b: Column) -> Column:
    """Equal, or both without one."""
    return a.eqNullSafe(b)


def observables_agree(a: Column, b: Column) -> Column:
    """Equal without regard to case, or both without one."""
    return F.lower(a).eqNullSafe(F.lower(b))


def wavelengths_agree(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    return _both(a, b, a["type"].eqNullSafe(b["type"]) & a["unit"].eqNullSafe(b["unit"]) & same_within(a["values"], b["values"], tolerance))


def verdicts_agree(a: Column, b: Column) -> Column:
    return _both(a, b, a == b)


def structures_agree(a: Column, b: Column) -> dict[str, Column]:
    """``agree``: the same names of instruments. The counts and the Jaccard index are details."""
    names = lambda x: F.coalesce(F.transform(x["instruments"], lambda i: i["name"]), F.array().cast("array<string>"))
    return {
        "agree": _both(a, b, same_sets(names(a), names(b))),
        "n_a": F.when(a.isNotNull(), F.size(names(a))),
        "n_b": F.when(b.isNotNull(), F.size(names(b))),
        "jaccard": F.when(a.isNotNull() & b.isNotNull(), set_metrics(names(a), names(b), both_empty=1.0)["jaccard"]),
    }


def disagreement_class(answers: Column) -> Column:
    """How an item's answers differ: none against values, two values, several, or otherwise."""
    each = F.array_distinct(answers)
    none = F.array_contains(each, "NONE")
    value = F.exists(each, lambda x: ~x.isin("NONE", "PARSE_ERROR"))
    return F.when(none & value, "NONE_vs_VALUE").when((F.size(each) == 2) & ~none, "VALUE_vs_VALUE").when(F.size(each) > 2, "MULTIPLE_VALUES").otherwise("OTHER")


def grounding_correct(results: Column, should_match: Column, code: Column, mission: Column) -> Column:
    """Some result (an array of structs with code and mission) is the expected one, or there is none where none is expected."""
    found = F.exists(results, lambda r: (r["code"] == code) & (r["mission"] == mission))
    return F.when(F.size(results) == 0, ~should_match).otherwise(should_match & F.coalesce(found, F.lit(False)))


#: Fields of an answer whose wording varies without a difference in meaning.
VOLATILE = ("raw_response", "original_text", "is_approximate", "error_message")


def canonical_answer(fields: dict[str, Column]) -> Column:
    """Fields as JSON in lower case, in order of their names, without the volatile ones; ISO times without their UTC mark.

    Without a start and an end the precision says nothing and is null. Null fields are written.
    """
    kept = {k: v for k, v in sorted(fields.items()) if k not in VOLATILE}
    for k in ("start_datetime", "end_datetime"):
        if k in kept:
            kept[k] = F.lower(F.regexp_replace(F.regexp_replace(F.trim(kept[k]), r"\+00:00$", ""), "[Zz]$", ""))
    if {"start_datetime", "end_datetime", "precision"} <= set(kept):
        kept["precision"] = F.when(kept["start_datetime"].isNotNull() | kept["end_datetime"].isNotNull(), kept["precision"])
    return F.lower(F.to_json(F.struct(*(v.alias(k) for k, v in kept.items())), {"ignoreNullFields": "false"}))

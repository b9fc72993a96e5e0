"""Parsers of answer texts as column expressions: verdicts, lists of numbers, candidates, cadences, wavelengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from litquarry.functions.text import BLANKS

_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
#: Units of length in metres.
UNITS = {"angstrom": 1e-10, "nm": 1e-9, "um": 1e-6, "mm": 1e-3, "cm": 1e-2, "m": 1.0}
#: The criteria of a validation answer and their labels.
CRITERIA = {
    "name_type": "Name/Type alignment",
    "mission_ref": "Mission reference match",
    "temporal": "Temporal compatibility",
    "capability": "Scientific capability match",
    "domain": "Domain consistency",
}
#: Marks of errors that pass by themselves.
TRANSIENT = (
    "serviceunavailable", "service unavailable", "throttl", "toomanyrequests",
    "too many requests", "429", "rate exceeded", "rate limit",
    "unexpected error", "try your request again", "try again",
    "expired", "security token", "internalserver", "internal server",
    "internalfailure", "connection", "timed out", "timeout", "503", "500", "502",
    "modelnotready", "model not ready",
)


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def index_list(text: Column) -> Column:
    """Numbers in brackets, else bare ones; null where there are none."""
    bracketed = F.regexp_extract_all(text, F.lit(r"\(([0-9]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"\b([0-9]+)\b"), F.lit(1))
    chosen = F.when(F.size(bracketed) > 0, bracketed).when(F.size(bare) > 0, bare)
    return F.transform(chosen, lambda x: x.cast("int"))


def says_unknown(text: Column) -> Column:
    return text.rlike(r"(?i)\bunknown\b")


def cadence_list(text: Column) -> Column:
    """Comma-separated durations; NONE is null."""
    return F.when(F.upper(F.trim(text)) != "NONE", F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def candidate(text: Column, candidates: Column) -> Column:
    """The answer if it is one of the candidates, else null."""
    answer = F.btrim(text, F.lit(BLANKS))
    return F.when((F.upper(answer) != "UNCERTAIN") & F.array_contains(candidates, answer), answer)


def verdict(text: Column) -> Column:
    """From a final decision, else a conclusion, else a decision in JSON; null if none."""
    word = lambda pattern: _nonempty(F.regexp_extract(text, pattern, 1))
    return F.lower(F.coalesce(word(r"(?is)final\s+decision\W*(accept|reject)"), word(r"(?is)conclusion\W*(accept|reject)"), word(r'(?is)"decision"\s*:\s*"(accept|reject)')))


def judge_verdict(text: Column) -> Column:
    """What the last line that begins with ``VERDICT:`` says, in lower case: a, b, tie or neither; anything else is an error."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.upper(F.trim(x))), lambda x: x.startswith("VERDICT:"))
    told = F.trim(F.replace(F.try_element_at(lines, F.lit(-1)), F.lit("VERDICT:"), F.lit("")))
    return F.when(told.isin("A", "B", "TIE", "NEITHER"), F.lower(told)).otherwise("error")


def validation_verdict(text: Column) -> Column:
    """(decision, one field for each criterion) of a validation answer; what is not found is invalid or a fail. Asterisks don't count."""
    clean = F.replace(text, F.lit("*"), F.lit(""))
    result = lambda label: F.coalesce(F.lower(_nonempty(F.regexp_extract(clean, rf"(?is){label}:.*?→\s*(pass|fail)", 1))), F.lit("fail"))
    decision = F.coalesce(F.lower(_nonempty(F.regexp_extract(clean, r"(?i)FINAL\s+DECISION:\s*(valid|invalid)", 1))), F.lit("invalid"))
    return F.struct(decision.alias("decision"), *(result(label).alias(name) for name, label in CRITERIA.items()))


def candidate_lines(text: Column) -> Column:
    """``1. CODE (name)`` lines as a map of number to code."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*[0-9]+\.\s+[^\n(]+?\s*\([^)\n]*\)"), F.lit(0))
    entry = lambda s: F.struct(F.regexp_extract(s, r"([0-9]+)\.", 1).cast("int").alias("k"), F.regexp_extract(s, r"[0-9]+\.\s+([^(]+?)\s*\(", 1).alias("v"))
    return F.map_from_entries(F.transform(lines, entry))


#: Field labels of an instrument's description and the fields that they begin.
LABELS = {
    "General Comments": "general_comments",
    "Time Range": "time_range",
    "Wavelength(s)": "wavelengths",
    "Physical Observable": "physical_observable",
    "Additional Comments": "additional_comments",
}


def field_of(line: Column) -> tuple[Column, Column]:
    """The field that a bullet's label begins and what follows it; null for other lines."""
    label, value = (F.regexp_extract(line, r"^-\s+\**(General Comments|Time Range|Wavelength\(s\)|Physical Observable|Additional Comments)\**:\s*(.*)", k) for k in (1, 2))
    return F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.nullif(label, F.lit(""))], F.when(label != "", F.trim(value))


def supporting_quote(line: Column) -> Column:
    """The quote of a line: after its label in straight or curly quotes, open to the end, or bare; or a line all in italics."""
    label = r"^\s*-?\s*\**Supporting Quote\**:\s*"
    pick = lambda pattern: F.when(line.rlike(pattern), F.trim(F.regexp_extract(line, pattern, 1)))
    opened = lambda pattern: F.when(line.rlike(pattern), F.trim(F.regexp_replace(F.regexp_extract(line, pattern, 1), '[*"”]+$', "")))
    return F.coalesce(pick(label + '["“](.*?)["”]\\s*$'), opened(label + '["“](.*)'), pick(label + r"(\S.*?)\s*$"), pick('^\\s*\\*["“](.*?)["”]\\*\\s*$'), opened('^\\s*\\*["“](.*)'))


def period_time(time_range: Column, quotes: Column) -> Column:
    """A period's time range, or its first time quote where that is blank."""
    return F.when(F.trim(time_range) == "", F.coalesce(F.get(quotes, F.lit(0)), time_range)).otherwise(time_range)


def path_tokens(path: Column) -> Column:
    """The names and the numbers in brackets of a path, in order, as texts."""
    cut = F.transform(F.split(path, r"\."), lambda s: F.when(s.rlike(r"^\w+\[\d+\]$"), F.split(F.regexp_replace(s, r"\]$", ""), r"\[")).otherwise(F.array(s)))
    return F.flatten(cut)


def repaired_index(token: Column, index: Column, names: Column, codes: Column) -> Column:
    """The place (from 0) of the mission that an answer ``token(index)`` means, or null.

    The index holds where the token fits its mission; else a neighbour that fits, the one before first; else the index
    itself. An index out of range gives way to the first mission that fits. Names fit when they are equal without
    regard to case and marks, or the token has three letters or more and is part of one.
    """
    norm = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    nt = norm(token)
    segment = lambda c: F.element_at(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", ""), "/"), -1)
    fit = lambda a, b: (nt == a) | (nt == b) | ((F.length(nt) >= 3) & (F.contains(a, nt) | F.contains(b, nt)))
    fits = F.transform(F.arrays_zip(names.alias("n"), codes.alias("c")), lambda x: (nt != "") & fit(norm(x["n"]), norm(segment(x["c"]))))
    at = lambda i: (i >= 0) & F.coalesce(F.get(fits, i), F.lit(False))
    inside = (index >= 0) & (index < F.size(names))
    near = F.when(at(index), index).when(at(index - 1), index - 1).when(at(index + 1), index + 1).otherwise(index)
    first = F.nullif(F.array_position(fits, True), F.lit(0)) - 1
    return F.when(inside, near).otherwise(first).cast("int")


def wavelengths(text: Column) -> Column:
    """Single values, lists and ranges with one unit at the end, as sorted distinct (min, max) in metres; malformed is null."""
    unit = F.lower(F.regexp_extract(text, r"(?i)(angstrom|nm|um|mm|cm|m)\s*$", 1))
    scale = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.nullif(unit, F.lit(""))]
    body = F.regexp_replace(text, r"(?i)\s*(angstrom|nm|um|mm|cm|m)\s*$", "")
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x))
    fits = F.forall(parts, lambda x: x.rlike(rf"^{_NUMBER}(?:\s*-\s*{_NUMBER})?$"))
    number = lambda x, k: F.split(x, r"\s*-\s*")[k].cast("double") * scale
    both = lambda x: F.struct(number(x, 0).alias("min"), F.when(x.contains("-"), F.get(F.split(x, r"\s*-\s*"), F.lit(1)).cast("double") * scale).otherwise(number(x, 0)).alias("max"))
    return F.when(fits & scale.isNotNull(), F.array_sort(F.array_distinct(F.transform(F.when(fits, parts), both))))


def category_of(parameter: Column) -> Column:
    """Quote categories from parameter names: empty is general, ``general`` the instrument, ``name:kind`` by what follows the first colon."""
    low = F.trim(F.lower(parameter))
    kind = F.regexp_extract(low, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(F.coalesce(parameter, F.lit("")) == "", "general").when(low == "general", "instrument").when(kind == "wavelength", "wavelength").when(kind == "physobs", "observable").otherwise("time_range")


def is_transient(error: Column) -> Column:
    """Whether an error's text has a mark of one that passes by itself."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in TRANSIENT])

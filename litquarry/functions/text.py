"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curly quotes and blanks.
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’", "“”"
BLANKS = " \t\n\x0b\x0c\r"


def percent_encode(text: Column) -> Column:
    """As URLs carry it, with no character left as safe but letters, digits and ``-._~``."""
    encoded = F.url_encode(text)
    for found, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(new))
    return encoded


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def anchors(text: Column, stop: list[str], shortest: int = 4) -> Column:
    """Tokens that are long enough and not stop words."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= shortest) & ~t.isin(stop))


def distinctive(text: Column) -> Column:
    """Runs of digits and runs of two or more letters that are all upper case, in lower case, sorted."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    found = F.concat(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.filter(runs, lambda t: (F.length(t) >= 2) & (F.upper(t) == t)))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def sibling_conflict(quote: Column, segment: Column) -> Column:
    """Whether a distinctive token of the quote, other than a year, is missing from the segment: then it is another one of its kind."""
    held = F.regexp_extract_all(F.lower(segment), F.lit("[0-9a-z]+"), F.lit(0))
    told = F.filter(distinctive(quote), lambda t: ~t.rlike("^(?:19|20)[0-9]{2}$"))
    return F.size(F.array_except(told, held)) > 0


#: What marks a quote as mathematical, and special signs.
MATH_MARKS = (
    "=", "+", "-", "*", "/", "(", ")", "[", "]", "{", "}",
    "alpha", "beta", "gamma", "delta", "lambda", "sigma", "theta",
    "equation", "formula", "coefficient", "matrix", "norm",
)
SPECIAL = "°′″×±≈≤≥"
#: Coverage, least and most length ratio, anchors, by the kind of content; later kinds win.
THRESHOLDS = {
    "plain": (0.6, 0.6, 1.8, 2),
    "math": (0.5, 0.4, 2.5, 1),
    "dash": (0.55, 0.5, 2.0, 1),
    "hyphen": (0.5, 0.4, 2.5, 1),
    "cross": (0.7, 0.7, 1.5, 2),
}


def adaptive_thresholds(quote: Column, parameter: Column) -> dict[str, Column]:
    """What a match of a quote has to reach, by its content, its parameter and its length."""
    low, name = F.lower(quote), F.lower(F.coalesce(parameter, F.lit("")))
    any_in = lambda c, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(c, m))
    dashes = F.char_length(quote) - F.char_length(F.translate(quote, "–-—", ""))
    kinds = {
        "cross": F.contains(name, F.lit("cross")),
        "hyphen": F.contains(name, F.lit("hyphen")),
        "dash": (dashes > 2) | F.contains(name, F.lit("dash")),
        "math": any_in(low, MATH_MARKS) | any_in(quote, SPECIAL),
    }
    pick = lambda k: F.coalesce(*(F.when(c, F.lit(THRESHOLDS[n][k])) for n, c in kinds.items()), F.lit(THRESHOLDS["plain"][k]))
    length = F.char_length(quote)
    return {
        "coverage": F.when(length > 100, F.least(F.lit(0.7), F.round(pick(0) + 0.1, 2))).otherwise(pick(0)),
        "least_ratio": pick(1),
        "most_ratio": pick(2),
        "anchors": F.when(length < 30, 1).otherwise(pick(3)),
    }


def looks_junk(text: Column, *, most_lines: float = 0.10, most_same: float = 0.8) -> Column:
    """Without characters, with too many lines for them, or mostly one and the same line. Blanks around the text don't count.

    Equal lines are neighbours once sorted, so one pass over the sorted lines finds the longest run.
    """
    lines = F.split(F.btrim(text, F.lit(BLANKS)), "\n")
    n, chars = F.size(lines), F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    start = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["line"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    modal = F.aggregate(F.array_sort(lines), start, step, lambda s: s["best"])
    return F.coalesce((chars == 0) | (n / chars > most_lines) | (modal / n > most_same), F.lit(True))


def length_class(text: Column, *, most: int = 500_000, warn: int = 200_000) -> Column:
    return F.when(F.length(text) > most, "error").when(F.length(text) > warn, "warning").otherwise("ok")


def clean_quote(text: Column) -> Column:
    """Without asterisks, straight or curly quotes and blanks around it; ``10^{12}`` becomes ``1012``, a caret after no digit stays."""
    peeled = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS + "*\"'" + DOUBLE_QUOTES + SINGLE_QUOTES))
    return F.regexp_replace(peeled, r"([0-9])\s*\^\s*\{?([0-9]+)\}?", "$1$2")


def strip_reasoning(text: Column) -> Column:
    """Without a reasoning block and the fence around code."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<reasoning>.*?</reasoning>", ""), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def display_name(instrument: Column, observatory: Column) -> Column:
    """A catalog id's own part: without its known prefix and its observatory's path, slashes as hyphens. Other ids stay."""
    name = instrument
    for agency in ("SMWG", "NASA"):
        ours, theirs = f"spase://{agency}/Instrument/", f"spase://{agency}/Observatory/"
        rest = F.substring(instrument, len(ours) + 1, 1 << 20)
        path = F.when(observatory.startswith(theirs), F.concat(F.substring(observatory, len(theirs) + 1, 1 << 20), F.lit("/")))
        own = F.when(rest.startswith(path), F.substr(rest, F.length(path) + 1)).otherwise(rest)
        name = F.when(instrument.startswith(ours), F.translate(own, "/", "-")).otherwise(name)
    return name


#: Numbered spacecraft of one mission and their names.
NUMBERED = {
    "Cluster/C1": "Cluster-Rumba",
    "Cluster/C2": "Cluster-Salsa",
    "Cluster/C3": "Cluster-Samba",
    "Cluster/C4": "Cluster-Tango",
}


def renamed_id(instrument: Column) -> Column:
    """An instrument id of a numbered spacecraft as that of the named one; null for others."""
    prefix = "spase://SMWG/Instrument/"
    found = [F.when(instrument.startswith(f"{prefix}{old}/"), F.concat(F.lit(f"{prefix}{new}/"), F.substring(instrument, len(f"{prefix}{old}/") + 1, 1 << 20))) for old, new in NUMBERED.items()]
    return F.coalesce(*found)


def norm_token(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def journal_of(bibcode: Column) -> Column:
    """The journal's letters from the fifth character on."""
    return F.regexp_extract(F.substring(bibcode, 5, 100), r"^([A-Za-z&]+(?:\.[A-Za-z&]+)*)", 1)


def normalize_doi(doi: Column) -> Column:
    """Lower case, without the resolver's address in front."""
    return F.lower(F.regexp_replace(doi, r"^https?://doi\.org/", ""))


def arxiv_id(identifiers: Column) -> Column:
    """What follows ``arXiv:`` in the first identifier that begins so, else null."""
    return F.get(F.transform(F.filter(identifiers, lambda x: x.startswith("arXiv:")), lambda x: F.substring(x, 7, 1 << 20)), F.lit(0))


def safe_name(text: Column) -> Column:
    """A file name: ampersands and slashes become underscores."""
    return F.translate(text, "&/", "__")


def text_stats(text: Column) -> dict[str, Column]:
    """Length, estimated tokens, distinct characters, and whether it is empty or blank."""
    plain = F.coalesce(text, F.lit(""))
    return {
        "n_chars": F.char_length(plain),
        "tokens": F.floor(F.char_length(plain) / 3.5),
        "distinct_chars": F.size(F.array_distinct(F.filter(F.split(plain, ""), lambda c: c != ""))),
        "is_empty": plain == "",
        "is_blank": F.btrim(plain, F.lit(BLANKS)) == "",
    }


def short_id(*columns: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *columns)), 1, digits)

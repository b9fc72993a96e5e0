"""Comparisons of two answers for each kind of call, and the parsers that read them, over answers made of the calls.

Each call is asked of two models. The second one's answer differs in ways that depend on the call, or cannot be parsed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from litquarry.functions import compare, parsers, times
from litquarry.plans.registry import query
from litquarry.sources.roles import calls, instruments, usages


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def form(moment: str | Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    return F.date_format(moment, pattern)


def forms(rest: Column, *choices: str | Column) -> Column:
    """One of some texts by the number ``rest``."""
    return reduce(lambda w, kc: w.when(rest == kc[0], kc[1]), list(enumerate(choices))[1:], F.when(rest == 0, choices[0]))


@query(
    """, t AS (SELECT call_id, tokens % 4 = 0 AS ea, tokens % 6 = 0 AS eb, tokens % 7 = 0 AS broken, tokens % 3 = 1 AS shifted, call_id % 5 = 0 AS coarse FROM calls)
    SELECT call_id, NOT broken AND (ea AND eb OR NOT ea AND NOT eb AND NOT shifted AND NOT coarse) AS agree FROM t""",
    "calls",
)
def h1_time(read):
    said = lambda shift, precision, error: text('{"start": "', form(F.col("created_at") + shift), '", "end": "', form(F.col("created_at") + F.expr("interval 1 hour")), '", "precision": "', precision, '", "error": ', error, "}")
    none = F.expr("interval 0 hour")
    a = said(none, F.lit("second"), F.col("tokens") % 4 == 0)
    b = F.when(F.col("tokens") % 7 == 0, "about noon").otherwise(F.when(F.col("tokens") % 3 == 1, said(F.expr("interval 1 minute"), F.lit("second"), F.col("tokens") % 6 == 0)).otherwise(said(none, F.when(F.col("call_id") % 5 == 0, "day").otherwise("second"), F.col("tokens") % 6 == 0)))
    return calls(read).select("call_id", compare.times_agree(*(compare.parsed(x, compare.TIME) for x in (a, b))).alias("agree"))


@query(
    """, t AS (SELECT call_id, call_type = 'error' AS ua, call_type = 'error' AND tokens % 2 = 0 AS ub, CASE WHEN call_type <> 'error' THEN [tokens % 5, 7] END AS a,
      CASE WHEN call_type = 'error' AND tokens % 2 = 0 THEN NULL WHEN tokens % 3 = 0 THEN [7, tokens % 5] ELSE [tokens % 5, tokens % 2 + 6] END AS b FROM calls)
    SELECT call_id, ua AND ub OR NOT ua AND NOT ub AND coalesce(list_sort(list_distinct(a)) = list_sort(list_distinct(b)), false) AS agree, coalesce(a[1] = b[1], false) AS same_first,
    CASE WHEN a IS NULL OR b IS NULL THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS jaccard FROM t""",
    "calls",
)
def h2_mission_identification(read):
    """Answers name missions by numbers in brackets, or say that they are unknown."""
    unknown = F.col("call_type") == "error"
    a = F.when(unknown, "UNKNOWN").otherwise(text("HELIOS (", F.col("tokens") % 5, "), other (7)"))
    b = F.when(unknown & (F.col("tokens") % 2 == 0), "it is Unknown").when(F.col("tokens") % 3 == 0, text("7 and ", F.col("tokens") % 5)).otherwise(text("A (", F.col("tokens") % 5, ") B (", F.col("tokens") % 2 + 6, ")"))
    met = compare.identifications_agree(parsers.index_list(a), parsers.index_list(b), parsers.says_unknown(a), parsers.says_unknown(b))
    return calls(read).select("call_id", met["agree"].alias("agree"), met["same_first"].alias("same_first"), F.round(met["jaccard"], 6).alias("jaccard"))


@query(
    """, w AS (SELECT call_id, regexp_extract_all(lower(json_extract_string(props, '$.k') || ',' || model || ' or ' || tokens % 7), '[0-9]+') AS a, regexp_extract_all(tokens % 7 || '; ' || CASE WHEN call_id % 3 = 0 THEN model ELSE model % 10 END || ' (' || tokens || ')', '[0-9]+') AS b FROM calls)
    SELECT call_id, list_sort(list_distinct(list_transform(a, lambda x: CAST(x AS INT)))) = list_sort(list_distinct(list_transform(b, lambda x: CAST(x AS INT)))) OR (list_contains(a, '0') AND list_contains(b, '0')) AS agree FROM w""",
    "calls",
)
def h3_selection(read):
    """Numbers that two answers name, in another order and with other marks; zero in both says that both are unsure."""
    small = F.col("tokens") % 7
    a = text("(", F.col("tokens"), "), (", F.col("model"), ") or (", small, ")")
    b = text("(", small, ") then (", F.when(F.col("call_id") % 3 == 0, F.col("model")).otherwise(F.col("model") % 10), "); (", F.col("tokens"), ")")
    return calls(read).select("call_id", compare.selections_agree(parsers.index_list(a), parsers.index_list(b)).alias("agree"))




@query(
    """, s AS (SELECT call_id, 'PT' || tokens || 'S, PT' || model || 'M' || CASE WHEN tokens % 2 = 0 THEN ', PT' || tokens || 'S' ELSE ',' END AS a, CASE WHEN tokens % 5 = 0 THEN ' none ' ELSE 'PT' || model || 'M ,PT' || (tokens + call_id % 2) || 'S' END AS b FROM calls),
    p AS (SELECT call_id, list_sort(list_distinct(list_filter(list_transform(string_split(a, ','), lambda x: trim(x)), lambda x: x <> ''))) AS x, CASE WHEN upper(trim(b)) = 'NONE' THEN [] ELSE list_sort(list_distinct(list_transform(string_split(b, ','), lambda x: trim(x)))) END AS y FROM s)
    SELECT call_id, x = y AS agree FROM p""",
    "calls",
)
def h4_cadence(read):
    """Durations of the calls' numbers in two orders, some repeated; NONE is an empty list."""
    one, two = text("PT", F.col("tokens"), "S"), text("PT", F.col("model"), "M")
    a = F.concat(one, F.lit(", "), two, F.when(F.col("tokens") % 2 == 0, F.concat(F.lit(", "), one)).otherwise(","))
    b = F.when(F.col("tokens") % 5 == 0, " none ").otherwise(F.concat(two, F.lit(" ,"), text("PT", F.col("tokens") + F.col("call_id") % 2, "S")))
    read_list = lambda x: F.coalesce(parsers.cadence_list(x), F.array().cast("array<string>"))
    return calls(read).select("call_id", compare.same_sets(read_list(a), read_list(b)).alias("agree"))


@query(
    """SELECT call_id, CASE WHEN tokens % 4 = 0 THEN call_type = 'click' WHEN call_type = 'click' THEN false ELSE tokens % 3 > 0 END AS detector, CASE WHEN call_type = 'click' THEN tokens % 4 = 0 ELSE tokens % 4 > 0 END AS observable FROM calls""",
    "calls",
)
def h5_detector_and_observable(read):
    """Answers among candidates; UNCERTAIN and others than candidates are none. Case counts for detectors only."""
    known = F.array(F.lit("COR1"), F.lit("Cor1"), F.lit("intensity"), F.lit("Intensity"))
    kind = F.col("call_type") == "click"
    pick = lambda x: parsers.candidate(x, known)
    a = pick(F.when(kind, "UNCERTAIN").otherwise("COR1"))
    b = pick(F.when(F.col("tokens") % 4 == 0, "EUVI").when(F.col("tokens") % 3 == 0, "Cor1").otherwise(" COR1 "))
    c = pick(F.when(kind, "uncertain").otherwise("Intensity"))
    d = pick(F.when(F.col("tokens") % 4 == 0, "density").otherwise("intensity"))
    return calls(read).select("call_id", compare.detectors_agree(a, b).alias("detector"), compare.observables_agree(c, d).alias("observable"))


@query(
    """SELECT call_id, CASE call_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN tokens % 2 = 0 ELSE false END AS agree FROM calls""",
    "calls",
)
def h6_wavelength(read):
    """The same values in another order, another unit, another type, values 0 or 0.002 apart, and no JSON."""
    rest = F.col("call_id") % 5
    said = lambda kind, unit, values: text('{"type": "', F.lit(kind), '", "unit": "', F.lit(unit), '", "values": [', values, "]}")
    a = said("list", "nm", text(F.col("tokens"), ", 171.1"))
    b = forms(rest, said("list", "nm", text("171.1004, ", F.col("tokens"))), said("list", "angstrom", text(F.col("tokens"), ", 171.1")), said("range", "nm", text(F.col("tokens"), ", 171.1")), said("list", "nm", text(F.col("tokens"), ", ", 171.1 + (F.col("tokens") % 2) * 0.002)), "171.1 nm")
    return calls(read).select("call_id", compare.wavelengths_agree(*(compare.parsed(x, compare.WAVELENGTH) for x in (a, b))).alias("agree"))


@query(
    r""", s AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' Final Decision: ' WHEN 1 THEN ' Conclusion: ' ELSE ' ' END || CASE WHEN length(text) % 2 = 0 THEN 'accept' ELSE 'reject' END AS a, 'FINAL DECISION: ' || CASE WHEN length(text) % 3 = 0 THEN 'Accept' ELSE 'Reject' END AS b FROM conversations),
    p AS (SELECT conv_id, turn, lower(regexp_extract(a, '(?i)(?:final decision|conclusion): (accept|reject)$', 1)) AS x, lower(regexp_extract(b, '(?i): (accept|reject)$', 1)) AS y FROM s)
    SELECT conv_id, turn, x <> '' AND x = y AS agree FROM p""".replace(", s AS", "WITH s AS", 1),
)
def h7_validation(read):
    """Whole turns that end in a decision, in two forms or in none, against decisions in capitals."""
    n, words = F.char_length("text"), F.coalesce("text", F.lit(""))
    form = F.when(F.col("turn") % 3 == 0, " Final Decision: ").when(F.col("turn") % 3 == 1, " Conclusion: ").otherwise(" ")
    a = F.concat(words, form, F.when(n % 2 == 0, "accept").otherwise("reject"))
    b = F.concat(F.lit("FINAL DECISION: "), F.when(n % 3 == 0, "Accept").otherwise("Reject"))
    return read("conversations").select("conv_id", "turn", compare.verdicts_agree(parsers.verdict(a), parsers.verdict(b)).alias("agree"))




@query(
    """, n AS (SELECT paper_id, list(instrument ORDER BY instrument) FILTER (configuration = 'F') AS a, list(instrument ORDER BY instrument) FILTER (configuration = 'O') AS b, count(*) FILTER (configuration = 'F') AS na, count(*) FILTER (configuration = 'O') AS nb FROM usages JOIN instruments USING (instrument_id) GROUP BY 1)
    SELECT paper_id, list_distinct(coalesce(a, [])) = [] AND list_distinct(coalesce(b, [])) = [] OR coalesce(list_sort(list_distinct(a)) = list_sort(list_distinct(b)), false) AS agree, CAST(na AS INT) AS n_a, CAST(nb AS INT) AS n_b,
    round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::DOUBLE, 6) AS jaccard FROM n""",
    "usages",
    "instruments",
)
def h8_structure(read):
    """The instruments that either configuration of a paper lists, as JSON documents."""
    named = usages(read).join(instruments(read).select("instrument_id", "instrument"), "instrument_id")
    listed = lambda k: F.array_agg(F.when(F.col("configuration") == k, F.struct(F.col("instrument").alias("name"))))
    per = named.groupBy("paper_id").agg(F.array_compact(listed("F")).alias("a"), F.array_compact(listed("O")).alias("b"))
    a, b = (compare.parsed(F.to_json(F.struct(F.col(c).alias("instruments"))), compare.STRUCTURE) for c in "ab")
    met = compare.structures_agree(a, b)
    return per.select("paper_id", *(F.round(v, 6).alias(k) if k == "jaccard" else v.alias(k) for k, v in met.items()))


@query(
    """, a AS (SELECT call_id % 4000 AS item_id, CASE WHEN tokens % 5 = 0 THEN 'NONE' WHEN tokens % 7 = 0 THEN 'PARSE_ERROR' WHEN call_id % 4000 < 1000 THEN 'PT' || tokens % 2 || 'S' ELSE 'PT' || call_id % 4000 % 3 * (tokens % 3) || 'S' END AS answer FROM calls),
    s AS (SELECT item_id, list_distinct(list(answer)) AS each FROM a GROUP BY 1)
    SELECT item_id, CASE WHEN list_contains(each, 'NONE') AND len(list_filter(each, lambda x: x NOT IN ('NONE', 'PARSE_ERROR'))) > 0 THEN 'NONE_vs_VALUE' WHEN len(each) = 2 AND NOT list_contains(each, 'NONE') THEN 'VALUE_vs_VALUE' WHEN len(each) > 2 THEN 'MULTIPLE_VALUES' ELSE 'OTHER' END AS class FROM s""",
    "calls",
)
def h9_disagreement_class(read):
    item = F.col("call_id") % 4000
    answer = F.when(F.col("tokens") % 5 == 0, "NONE").when(F.col("tokens") % 7 == 0, "PARSE_ERROR").when(item < 1000, text("PT", F.col("tokens") % 2, "S")).otherwise(text("PT", (item % 3) * (F.col("tokens") % 3), "S"))
    told = calls(read).groupBy(item.alias("item_id")).agg(F.collect_set(answer).alias("each"))
    return told.select("item_id", compare.disagreement_class(F.col("each")).alias("class"))


@query(
    """, r AS (SELECT paper_id, list({'c': instrument, 'm': mission}) FILTER (status = 'approved') AS found, min(instrument) AS code, max(mission) AS mission, count(*) % 2 = 1 AS wanted FROM usages JOIN instruments USING (instrument_id) GROUP BY 1)
    SELECT paper_id, CASE WHEN found IS NULL THEN NOT wanted ELSE wanted AND len(list_filter(found, lambda r: r.c = code AND r.m = mission)) > 0 END AS correct FROM r""",
    "usages",
    "instruments",
)
def h10_grounding(read):
    """Approved instruments of a paper as results; its first name and last mission are expected, or none if it has an even number of usages."""
    named = usages(read).join(instruments(read).select("instrument_id", "instrument", "mission"), "instrument_id")
    results = F.array_compact(F.array_agg(F.when(F.col("status") == "approved", F.struct(F.col("instrument").alias("code"), "mission"))))
    per = named.groupBy("paper_id").agg(results.alias("found"), F.min("instrument").alias("code"), F.max("mission").alias("mission"), (F.count("*") % 2 == 1).alias("wanted"))
    return per.select("paper_id", compare.grounding_correct(F.col("found"), F.col("wanted"), F.col("code"), F.col("mission")).alias("correct"))


# --- parsers -----------------------------------------------------------------------------------------------------


@query(
    """SELECT call_id, CASE call_id % 6 WHEN 0 THEN 'general_comments' WHEN 1 THEN 'time_range' WHEN 2 THEN 'wavelengths' WHEN 3 THEN 'physical_observable' WHEN 4 THEN 'additional_comments' END AS field,
    CASE WHEN call_id % 6 < 5 THEN call_type || ' ' || tokens END AS value FROM calls""",
    "calls",
)
def r2_field_label(read):
    value = text(F.col("call_type"), " ", F.col("tokens"))
    line = forms(F.col("call_id") % 6, text("- **General Comments**: ", value, "  "), text("-  Time Range:", value), text("- **Wavelength(s)**: ", value), text("- Physical Observable**: ", value), text("- **Additional Comments**:   ", value), text("* Time Range: ", value))
    return calls(read).select("call_id", *(c.alias(n) for n, c in zip(("field", "value"), parsers.field_of(line), strict=True)))


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(text, chr(10))[1] AS line FROM conversations WHERE text IS NOT NULL), s AS (SELECT conv_id, turn, trim(line) AS q FROM w WHERE trim(line) <> '' AND NOT contains(line, '"'))
    SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN q END AS quote FROM s""",
)
def r3_quote(read):
    """The first line of every turn as a quote: behind its label in straight quotes, in curly ones or bare, and in a line of another label."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    rows = read("conversations").where("text IS NOT NULL").select("conv_id", "turn", line.alias("line")).where((F.trim("line") != "") & ~F.contains("line", F.lit('"')))
    said = forms(F.col("turn") % 4, text('- **Supporting Quote**: "', F.col("line"), '"  '), text("  - Supporting Quote: “", F.col("line"), "”"), text("- **Supporting Quote**: ", F.col("line")), text("- **Time Range**: ", F.col("line")))
    return rows.select("conv_id", "turn", parsers.supporting_quote(said).alias("quote"))




@query(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN repeat(' ', CAST(length(text) % 3 AS INT)) ELSE substr(text, 1, 30) END AS given, string_split(text, chr(10)) AS quotes FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN trim(given) = '' THEN quotes[1] ELSE given END AS time_range FROM s""",
)
def r4_period_fallback(read):
    """The beginning of every turn as a time range, or blanks, for which the turn's first line stands."""
    rows = read("conversations").where("text IS NOT NULL")
    given = F.when(F.col("turn") % 3 == 0, F.repeat(F.lit(" "), (F.char_length("text") % 3).cast("int"))).otherwise(F.substring("text", 1, 30))
    return rows.select("conv_id", "turn", parsers.period_time(given, F.split("text", "\n")).alias("time_range"))


@query(
    """SELECT call_id, CASE call_id % 5 WHEN 0 THEN tokens + 1.5 WHEN 1 THEN 1.5 WHEN 2 THEN 10 WHEN 3 THEN NULL ELSE 5 END::DOUBLE AS low, CASE call_id % 5 WHEN 0 THEN tokens + 1.5 WHEN 1 THEN tokens + 2 WHEN 2 THEN tokens + 11 WHEN 3 THEN NULL ELSE 5 END::DOUBLE AS high,
    CASE call_id % 5 WHEN 1 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS n FROM calls""",
    "calls",
)
def r5_wavelengths(read):
    """Nanometres from single values, lists, ranges, malformed texts and repeated values."""
    said = forms(F.col("call_id") % 5, text(F.col("tokens") + 1.5, " nm"), text(F.col("tokens") + 2, ", 1.5 nm"), text("10 - ", F.col("tokens") + 11, " nm"), text(F.col("tokens"), " parsecs"), "5, 5 nm")
    got = calls(read).select("call_id", parsers.wavelengths(said).alias("w"))
    nm = lambda x: F.round(x * 1e9, 3)
    return got.select("call_id", nm(F.get("w", F.lit(0))["min"]).alias("low"), nm(F.try_element_at("w", F.lit(-1))["max"]).alias("high"), F.when(F.col("w").isNotNull(), F.size("w")).alias("n"))


@query(
    """WITH s AS (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:6], ', ') || CASE WHEN turn % 2 = 0 THEN ', ,' ELSE '' END AS said FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN upper(trim(said)) = 'NONE' THEN NULL ELSE array_to_string(list_filter(list_transform(string_split(said, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS cadences FROM s""",
)
def r6_cadences(read):
    """The first six words of every turn as a list between commas, some with empty entries."""
    said = F.concat(F.array_join(F.slice(F.split("text", " "), 1, 6), ", "), F.when(F.col("turn") % 2 == 0, ", ,").otherwise(""))
    return read("conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(parsers.cadence_list(said), "|").alias("cadences"))




@query("SELECT call_id, CASE WHEN tokens % 3 = 0 AND call_type <> 'error' THEN call_type END AS chosen FROM calls", "calls")
def r7_candidate(read):
    said = F.when(F.col("tokens") % 3 == 0, text(" ", F.col("call_type"), "\t")).when(F.col("tokens") % 3 == 1, "Uncertain").otherwise(F.upper("call_type"))
    known = F.array(F.lit("click"), F.lit("view"), F.lit("purchase"), F.lit("signup"), F.lit("UNCERTAIN"))
    return calls(read).select("call_id", parsers.candidate(said, known).alias("chosen"))


@query("SELECT call_id, 'A' || tokens AS first, CASE WHEN call_type = 'click' THEN NULL ELSE 'B/' || call_id END AS second, CASE WHEN call_type = 'click' THEN 1 ELSE 2 END AS lines FROM calls", "calls")
def r11_candidate_lines(read):
    said = text("Choose:\n1. A", F.col("tokens"), " (first (one))\n", F.when(F.col("call_type") == "click", "2 B (no point)").otherwise(text(" 12.  B/", F.col("call_id"), "  (second)")), "\n13. none")
    got = calls(read).select("call_id", parsers.candidate_lines(said).alias("m"))
    return got.select("call_id", F.try_element_at("m", F.lit(1)).alias("first"), F.try_element_at("m", F.lit(12)).alias("second"), F.size("m").alias("lines"))


MISSIONS = ["Alpha", "Beta One", "Gamma-3", "Delta", "Park Sol"]


@query(
    """SELECT call_id, CASE call_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 3 END AS mission FROM calls""",
    "calls",
)
def r13_index_repair(read):
    """Right, one too high, one too low, out of range but named, named elsewhere (the number stays), and neither."""
    token = forms(F.col("call_id") % 6, "BETA-ONE", "beta one", "Beta", "ParkSol", "alpha", "nowhere")
    index = forms(F.col("call_id") % 6, F.lit(1), F.lit(2), F.lit(0), F.lit(17), F.lit(3), F.lit(-1)).cast("int")
    names = F.array(*map(F.lit, MISSIONS))
    return calls(read).select("call_id", parsers.repaired_index(token, index, names, names).alias("mission"))


@query(
    """SELECT call_id, '{"end_datetime":' || CASE WHEN call_type = 'click' THEN 'null' ELSE '"' || strftime(created_at, '%Y-%m-%dt%H:%M:%S') || '"' END || ',"precision":' || CASE WHEN call_type = 'click' THEN 'null' ELSE '"minute"' END || ',"start_datetime":' || CASE WHEN call_type = 'click' THEN 'null' ELSE '"' || strftime(created_at, '%Y-%m-%dt%H:%M:%S') || '"' END || '}' AS canonical FROM calls""",
    "calls",
)
def r15_canonical(read):
    has = F.col("call_type") != "click"
    fields = {
        "start_datetime": F.when(has, text(form("created_at"), F.when(F.col("call_id") % 2 == 0, "Z").otherwise("+00:00"))),
        "end_datetime": F.when(has, text(" ", form("created_at"))),
        "precision": F.when(F.col("call_id") % 2 == 0, "Minute").otherwise("minute"),
        "raw_response": F.col("props"),
        "is_approximate": F.col("tokens") > 3,
    }
    return calls(read).select("call_id", compare.canonical_answer(fields).alias("canonical"))


PRECISIONS = "['year', 'month', 'day', 'hour', 'minute', 'second']"


@query(
    f"""SELECT call_id, CASE WHEN tokens % 7 = 6 OR call_id % 7 = 6 THEN 'year' ELSE {PRECISIONS}[least(tokens % 7, call_id % 7) + 1] END AS coarsest FROM calls""",
    "calls",
)
def d2_coarsest(read):
    name = lambda k: forms(k % 7, *times.LENGTHS, "unknown")
    return calls(read).select("call_id", times.coarser(name(F.col("tokens")), name(F.col("call_id"))).alias("coarsest"))


@query(
    """SELECT call_id, CASE WHEN call_type = 'view' THEN date_trunc('day', created_at) + INTERVAL 1 DAY WHEN call_type = 'click' THEN created_at + INTERVAL 1 DAY ELSE created_at + INTERVAL 2 DAY END AS win_end FROM calls""",
    "calls",
)
def d9_end_bump(read):
    """A window that ends on the day it starts on ends a day later."""
    kind, start = F.col("call_type"), F.col("created_at")
    end = F.when(kind == "view", F.date_trunc("day", start)).when(kind == "click", start).otherwise(start + F.expr("interval 2 day"))
    return calls(read).select("call_id", times.bumped_end(start, end).alias("win_end"))

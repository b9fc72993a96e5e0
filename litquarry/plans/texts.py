"""Texts, quotes in documents, answer parsing, comparisons and times over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions import parsers, text, times
from litquarry.operators import locate
from litquarry.plans.registry import query
from litquarry.sources.roles import calls, usages

#: Words that no quote is anchored on, made for the test tables.
STOP = ["that", "this", "with", "thon", "esen", "hein"]


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[0-9a-z]+')) AS n_tokens FROM documents")
def f3_tokens(read):
    return read("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    """SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda x: length(x) >= 4 AND x NOT IN ('that', 'this', 'with', 'thon', 'esen', 'hein')), ' ') AS anchors FROM benchmark""",
)
def f4_anchors(read):
    return read("benchmark").select("item_id", F.array_join(text.anchors(F.col("text"), STOP), " ").alias("anchors"))


@query(
    """SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(html, '[0-9]+'), list_filter(regexp_extract_all(html, '[A-Za-z]+'), lambda r: length(r) >= 2 AND upper(r) = r)), lambda x: lower(x)))), ' ') AS names FROM pages""",
)
def f5_distinctive(read):
    return read("pages").select("page_id", F.array_join(text.distinctive(F.col("html")), " ").alias("names"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2),
    m AS (SELECT doc_id, sum(n) AS n, sum(n * length(line)) AS chars, max(n) AS modal FROM c GROUP BY 1)
    SELECT d.doc_id, coalesce(chars = 0 OR n / chars::DOUBLE > 0.10 OR modal / n::DOUBLE > 0.8, true) AS junk FROM documents d LEFT JOIN m USING (doc_id)""",
)
def f7_junk(read):
    return read("documents").select("doc_id", text.looks_junk(F.col("text")).alias("junk"))


@query("SELECT doc_id, CASE WHEN length(text) > 50000 THEN 'error' WHEN length(text) > 2000 THEN 'warning' ELSE 'ok' END AS class, CAST(floor(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def f8_length_and_tokens(read):
    return read("documents").select("doc_id", text.length_class(F.col("text"), most=50_000, warn=2_000).alias("class"), F.floor(F.char_length("text") / 3.5).alias("tokens"))


@query(
    r"""SELECT item_id, regexp_replace(trim('**“' || text || ' 10^{' || strlen(text) || '} x^2 7 ^ 3”*', ' *"''“”‘’' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([0-9])\s*\^\s*\{?([0-9]+)\}?', '\1\2', 'g') AS quote FROM benchmark"""
)
def f11_clean_quote(read):
    told = F.concat(F.lit("**“"), "text", F.lit(" 10^{"), F.octet_length("text"), F.lit("} x^2 7 ^ 3”*"))
    return read("benchmark").select("item_id", text.clean_quote(told).alias("quote"))


@query("SELECT conv_id, turn, trim(text) AS answer FROM conversations")
def f12_strip_reasoning(read):
    wrapped = F.concat(F.lit("<reasoning>a\nb</reasoning>\n```json\n"), F.trim("text"), F.lit("\n```"))
    return read("conversations").select("conv_id", "turn", text.strip_reasoning(wrapped).alias("answer"))


@query("SELECT p_partkey AS instrument_id, regexp_replace(upper(p_brand || ' ' || p_name), '[^A-Z0-9]', '', 'g') AS token FROM part")
def f13_norm_token(read):
    return read("part").select(F.col("p_partkey").alias("instrument_id"), text.norm_token(F.concat_ws(" ", "p_brand", "p_name")).alias("token"))


@query("SELECT DISTINCT source, regexp_extract(substr('2021' || source || '..12', 5), '^([A-Za-z&]+(?:\\.[A-Za-z&]+)*)', 1) AS journal FROM documents")
def f14_journal(read):
    return read("documents").select("source").distinct().withColumn("journal", text.journal_of(F.concat(F.lit("2021"), "source", F.lit("..12"))))


@query("SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'doi:10.1/' ELSE '10.1/' END || lower(url) AS doi FROM pages")
def f15_doi(read):
    prefix = F.when(F.col("page_id") % 3 == 0, "https://doi.org/10.1/").when(F.col("page_id") % 3 == 1, "http://doi.org/10.1/").otherwise("DOI:10.1/")
    return read("pages").select("page_id", text.normalize_doi(F.concat(prefix, "url")).alias("doi"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '2303.' || page_id WHEN 1 THEN url END AS arxiv FROM pages")
def f15_arxiv(read):
    rest, url = F.col("page_id") % 3, F.col("url")
    second = F.when(rest == 0, F.concat(F.lit("arXiv:2303."), "page_id")).when(rest == 1, F.concat(F.lit("arXiv:"), url)).otherwise("ARXIV:1")
    return read("pages").select("page_id", text.arxiv_id(F.array(url, second, F.lit("doi:10.1/2"), F.when(rest < 2, "arXiv:last"))).alias("arxiv"))


@query("SELECT page_id, replace(replace(url, '&', '_'), '/', '_') AS name FROM pages")
def f18_safe_name(read):
    return read("pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(
    """SELECT doc_id, length(coalesce(text, '')) AS n_chars, CAST(floor(length(coalesce(text, '')) / 3.5) AS BIGINT) AS tokens,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(list_distinct(string_split(text, ''))) END AS distinct_chars, coalesce(text, '') = '' AS is_empty,
    trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS is_blank FROM documents""",
)
def f10_text_stats(read):
    return read("documents").select("doc_id", *(c.alias(n) for n, c in text.text_stats(F.col("text")).items()))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def f19_percent_encode(read):
    return read("pages").select("page_id", text.percent_encode(F.col("url")).alias("encoded"))


@query("SELECT doc_id, md5(text) AS cache_key, sha256(text) AS request, substr(sha1(source || '|' || lang), 1, 12) AS short FROM documents")
def f20_hash_keys(read):
    return read("documents").select("doc_id", F.md5("text").alias("cache_key"), F.sha2("text", 256).alias("request"), text.short_id(F.col("source"), F.col("lang")).alias("short"))


@query(
    """, n AS (SELECT paper_id, list_sort(list(DISTINCT instrument_id::VARCHAR)) AS x FROM usages GROUP BY 1)
    SELECT paper_id, array_to_string(list_transform(x, lambda y: CAST(y AS INT)), ',') AS parsed FROM n""",
    "usages",
)
def r8_index_list(read):
    """Numbers parsed back from an answer that names them in brackets."""
    said = usages(read).groupBy("paper_id").agg(F.sort_array(F.collect_set(F.col("instrument_id").cast("string"))).alias("x"))
    answer = F.concat(F.lit("I choose 2 of these: "), F.array_join(F.transform("x", lambda y: F.concat(F.lit("("), y, F.lit(")"))), ", "))
    return said.select("paper_id", F.array_join(F.transform(parsers.index_list(answer), lambda y: y.cast("string")), ",").alias("parsed"))


@query("SELECT call_id, CASE WHEN call_type = 'error' THEN 'reject' WHEN call_type = 'view' THEN NULL ELSE 'accept' END AS verdict FROM calls", "calls")
def r9_verdicts(read):
    """Verdicts parsed back from three forms of answers."""
    kind = F.col("call_type")
    answer = F.when(kind == "error", "**FINAL DECISION:** Reject, as the window is unsupported").when(kind == "click", 'text {"decision": "ACCEPT"}').when(kind == "view", "no word on it").otherwise("Conclusion: accept")
    return calls(read).select("call_id", parsers.verdict(answer).alias("verdict"))


@query(
    """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' WHEN 3 THEN 'neither' ELSE 'error' END AS verdict FROM conversations""",
)
def r10_judge_verdicts(read):
    """Answers end in a verdict line; one that says more than the bare choice is an error, whatever stood before it."""
    rest = (F.col("conv_id") + F.col("turn")) % 6
    line = F.when(rest == 0, "VERDICT: A").when(rest == 1, "  verdict:b ").when(rest == 2, "Verdict: Tie").when(rest == 3, "VERDICT: NEITHER").when(rest == 4, "Verdict: A is better").otherwise("**Verdict**: B")
    before = F.when(rest == 5, "").otherwise("VERDICT: B\n")
    return read("conversations").select("conv_id", "turn", parsers.judge_verdict(F.concat(before, F.coalesce(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("")), F.lit("\n"), line)).alias("verdict"))


@query(
    """, q AS (SELECT call_id, CASE call_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' General ' WHEN 2 THEN props || ':wavelength' WHEN 3 THEN 'Wavelength: first period' WHEN 4 THEN call_type || ':PHYSOBS' WHEN 5 THEN call_type || ':general' WHEN 6 THEN 'a:b:wavelength' WHEN 7 THEN call_type || ':wavelength' ELSE props END AS p FROM calls),
    k AS (SELECT call_id, p, trim(lower(p)) AS low, CASE WHEN contains(p, ':') THEN substr(trim(lower(p)), strpos(trim(lower(p)), ':') + 1) END AS kind FROM q)
    SELECT call_id, CASE WHEN p = '' THEN 'general' WHEN low = 'general' THEN 'instrument' WHEN kind = 'wavelength' THEN 'wavelength' WHEN kind = 'physobs' THEN 'observable' ELSE 'time_range' END AS category FROM k""",
    "calls",
)
def r14_categories(read):
    """Parameter names of all forms: capitals, blanks, several colons, and old ones that only begin like a kind."""
    rest, kind, props = F.col("call_id") % 9, F.col("call_type"), F.col("props")
    forms = [F.lit(""), F.lit(" General "), F.concat(props, F.lit(":wavelength")), F.lit("Wavelength: first period"), F.concat(kind, F.lit(":PHYSOBS")), F.concat(kind, F.lit(":general")), F.lit("a:b:wavelength"), F.concat(kind, F.lit(":wavelength")), props]
    parameter = F.coalesce(*(F.when(rest == k, f) for k, f in enumerate(forms)))
    return calls(read).select("call_id", parsers.category_of(parameter).alias("category"))


@query(
    """SELECT page_id, list_bool_or(list_transform(MARKS, lambda m: contains(lower(coalesce(html, '')), m))) AS transient FROM pages""".replace(
        "MARKS", "[" + ", ".join(f"'{m}'" for m in parsers.TRANSIENT) + "]"
    )
)
def r16_transient(read):
    """Whole pages as error texts, so that marks stand anywhere."""
    return read("pages").select("page_id", parsers.is_transient(F.col("html")).alias("transient"))


@query(
    """SELECT call_id, CASE WHEN call_type = 'click' THEN 'invalid' WHEN call_id % 2 = 0 THEN 'valid' ELSE 'invalid' END AS decision, CASE WHEN call_id % 3 = 0 THEN 'pass' ELSE 'fail' END AS name_type,
    CASE WHEN tokens % 2 = 0 AND call_type <> 'view' THEN 'pass' ELSE 'fail' END AS temporal, CASE WHEN tokens % 5 = 0 THEN 'pass' ELSE 'fail' END AS domain FROM calls""",
    "calls",
)
def r9_validation_criteria(read):
    """Decision and criteria parsed back from answers with marks of emphasis, of which some lack a line."""
    says = lambda ok: F.when(ok, "PASS").otherwise("fail")
    parts = [
        F.lit("**VALIDATION ANALYSIS:**\n- **Name/Type alignment**: close\nenough → "), says(F.col("call_id") % 3 == 0),
        F.when(F.col("call_type") == "view", "\n").otherwise(F.concat(F.lit("\n- Temporal compatibility: within → "), says(F.col("tokens") % 2 == 0))),
        F.lit("\n- Domain consistency: same field →"), says(F.col("tokens") % 5 == 0),
        F.when(F.col("call_type") == "click", "\n").otherwise(F.concat(F.lit("\n\n**FINAL  DECISION:** "), F.when(F.col("call_id") % 2 == 0, "Valid").otherwise("invalid"))),
    ]
    told = calls(read).select("call_id", parsers.validation_verdict(F.concat(*parts)).alias("v"))
    return told.select("call_id", "v.decision", "v.name_type", "v.temporal", "v.domain")


@query(
    """, t AS (SELECT call_id, CASE call_id % 5 WHEN 0 THEN strftime(created_at, '%Y') WHEN 1 THEN strftime(created_at, '%Y-%m') WHEN 2 THEN strftime(created_at, '%Y-%m-%d') WHEN 3 THEN strftime(created_at, '%Y-%m-%dT%H:%M:00Z') ELSE strftime(created_at, '%Y-%m-%dT%H:%M:07Z') END AS iso FROM calls)
    SELECT call_id, iso, CASE call_id % 5 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'minute' ELSE 'second' END AS precision, substr(iso, 1, CASE call_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 WHEN 3 THEN 16 ELSE 19 END) AS cut, lower(regexp_replace(iso, 'Z$', '')) AS canonical FROM t""",
    "calls",
)
def d1_precision(read):
    form = lambda f: F.date_format("created_at", f)
    rest = F.col("call_id") % 5
    iso = F.when(rest == 0, form("yyyy")).when(rest == 1, form("yyyy-MM")).when(rest == 2, form("yyyy-MM-dd")).when(rest == 3, form("yyyy-MM-dd'T'HH:mm:'00Z'")).otherwise(form("yyyy-MM-dd'T'HH:mm:'07Z'"))
    told = calls(read).select("call_id", iso.alias("iso")).withColumn("precision", times.precision_of(F.col("iso")))
    return told.select("call_id", "iso", "precision", times.truncate_to(F.col("iso"), F.col("precision")).alias("cut"), times.canonical_iso(F.col("iso")).alias("canonical"))


@query(
    """SELECT paper_id, instrument_id, win_start, CASE WHEN win_end - win_start <= INTERVAL 2 DAY THEN win_start + INTERVAL 1 DAY ELSE win_end END AS win_end, win_end - win_start <= INTERVAL 2 DAY AS single FROM usages""",
    "usages",
)
def d3_single_days(read):
    """Windows of up to two days are stated here as one day, and expanded."""
    short = F.unix_seconds("win_end") - F.unix_seconds("win_start") <= 2 * 86400
    end, single = times.expand_single_day(F.col("win_start"), F.when(short, F.col("win_start")).otherwise(F.col("win_end")))
    return usages(read).select("paper_id", "instrument_id", "win_start", end.alias("win_end"), single.alias("single"))


@query(
    """SELECT CASE WHEN h <= 0 THEN 'invalid' WHEN h > 87600 THEN 'long' WHEN h < 1 THEN 'short' ELSE 'ok' END AS class, count(*) AS n FROM (SELECT CASE instrument_id % 4 WHEN 0 THEN -5 WHEN 1 THEN 90000 WHEN 2 THEN 0.5 ELSE 30 END AS h FROM usages) GROUP BY 1""",
    "usages",
)
def d6_duration_classes(read):
    rest = F.col("instrument_id") % 4
    seconds = F.when(rest == 0, -18000).when(rest == 1, 324000000).when(rest == 2, 1800).otherwise(108000)
    end = F.timestamp_seconds(F.unix_seconds("win_start") + seconds)
    return usages(read).groupBy(times.duration_class(F.col("win_start"), end).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '\\b(?:19|20)[0-9]{2}\\b') AS names_year FROM documents")
def d7_year_presence(read):
    return read("documents").select("doc_id", times.names_year(F.col("text")).alias("names_year"))


@query(
    """SELECT call_id, CASE WHEN call_type <> 'error' THEN date_trunc('second', created_at) END AS parsed FROM calls""",
    "calls",
)
def d10_parse_utc(read):
    iso = F.when(F.col("call_type") == "error", "sometime in spring").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return calls(read).select("call_id", times.parse_utc(iso).alias("parsed"))

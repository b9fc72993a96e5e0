"""Scans, exports, filters and joins over papers, usages, instruments and observatories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.functions import predicates as p
from litquarry.functions.text import percent_encode
from litquarry.operators import joins as j
from litquarry.plans.registry import query
from litquarry.sources.files import parts_for
from litquarry.sources.roles import Reader, calls, instruments, observatories, papers, usages, votes

day = lambda s: F.lit(s).cast("timestamp")

TAGGED = "tagged AS (SELECT *, string_split(instrument, ' ') AS tags FROM instruments)"


def tagged(read: Reader) -> DataFrame:
    """Instruments with the words of their names as tags."""
    return instruments(read).withColumn("tags", F.split("instrument", " "))


# --- exports -----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT tag, 'https://papers.example/abs/' || url_encode(tag) AS url FROM papers", "papers")
def s13_csv_export(read):
    return papers(read).select("tag").distinct().withColumn("url", F.concat(F.lit("https://papers.example/abs/"), percent_encode(F.col("tag"))))


@query(
    """SELECT call_id, call_type, model, created_at, cost FROM calls WHERE call_type IN ('click', 'error')
    AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-10'""",
    "calls",
)
def s14_filtered_export(read):
    chosen = F.col("call_type").isin("click", "error") & (F.col("created_at") >= day("2024-01-03")) & (F.col("created_at") < day("2024-01-10"))
    return calls(read).where(chosen).select("call_id", "call_type", "model", "created_at", "cost")


@query("SELECT paper_id FROM papers", "papers")
def s15_id_export(read):
    return papers(read).select("paper_id").orderBy("paper_id")


@query(
    """SELECT c_custkey AS author_id, c_mktsegment AS segment FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
)
def s16_missing_keys(read):
    done = read("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("author_id")).distinct()
    return read("customer").select(F.col("c_custkey").alias("author_id"), F.col("c_mktsegment").alias("segment")).join(done, "author_id", "left_anti")


@query(
    f""", {TAGGED} SELECT instrument_id, list_aggregate(list_sort(list_distinct(list_concat(['helio'], tags))), 'string_agg', ',') AS tags
    FROM tagged WHERE channels > 25 AND instrument_id NOT IN (SELECT instrument_id FROM usages WHERE paper_id % 5 = 0)""",
    "instruments",
    "usages",
)
def s18_manifest_import(read):
    known = usages(read).where("paper_id % 5 = 0").select("instrument_id").distinct()
    new = tagged(read).where("channels > 25").join(known, "instrument_id", "left_anti")
    return new.select("instrument_id", F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(F.array(F.lit("helio")), "tags")))).alias("tags"))


# --- filters -----------------------------------------------------------------------------------------------------


@query("SELECT instrument_id, instrument FROM instruments WHERE contains(lower(instrument), 'wid') OR contains(lower(mission), '#1')", "instruments")
def p1_substring(read):
    return instruments(read).where(p.icontains(F.col("instrument"), "Wid") | p.icontains(F.col("mission"), "#1")).select("instrument_id", "instrument")


@query("SELECT * FROM papers WHERE tag IN ('1-URGENT', '5-LOW') AND state IN ('F')", "papers")
def p2_in_list(read):
    return papers(read).where(F.col("tag").isin("1-URGENT", "5-LOW") & F.col("state").isin("F"))


@query("SELECT * FROM observatories WHERE (datasource = 'ASIA' AND country = 'NATION_3') OR country = 'NATION_5' OR (datasource = 'EUROPE' AND country = 'NATION_8')", "observatories")
def p3_composite_keys(read):
    return observatories(read).where(p.composite_keys(F.col("datasource"), F.col("country"), ["ASIA:NATION_3", "NATION_5", "EUROPE:NATION_8"]))


@query(
    """SELECT u.paper_id, u.instrument_id, u.status, u.win_start FROM usages u JOIN instruments i USING (instrument_id)
    WHERE i.mission IN ('Brand#3', 'Brand#7') AND contains(lower(i.instrument), 'ring') AND u.status = 'approved'
      AND u.win_start < TIMESTAMP '1998-01-01' AND u.win_end >= TIMESTAMP '1996-01-01'""",
    "usages",
    "instruments",
)
def p4_dynamic_filter(read):
    clauses = [F.col("mission").isin("Brand#3", "Brand#7"), p.icontains(F.col("instrument"), "RING"), F.col("status") == "approved", p.overlaps(F.col("win_start"), F.col("win_end"), day("1996-01-01"), day("1998-01-01"))]
    return usages(read).join(instruments(read), "instrument_id").where(p.all_of(clauses)).select("paper_id", "instrument_id", "status", "win_start")


@query(
    """SELECT count(*) FILTER (win_end >= TIMESTAMP '1999-06-01') AS only_first, count(*) FILTER (win_start <= TIMESTAMP '1994-06-01') AS only_last,
    count(*) FILTER (win_start < TIMESTAMP '1997-02-01' AND win_end >= TIMESTAMP '1997-01-01') AS both_dates FROM usages""",
    "usages",
)
def p5_date_filters(read):
    a, b = F.col("win_start"), F.col("win_end")
    return usages(read).agg(
        F.count_if(p.from_date(a, b, first=day("1999-06-01"))).alias("only_first"),
        F.count_if(p.from_date(a, b, last=day("1994-06-01"))).alias("only_last"),
        F.count_if(p.from_date(a, b, day("1997-01-01"), day("1997-02-01"))).alias("both_dates"),
    )


@query(
    """SELECT call_id, date_trunc('day', created_at) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end FROM calls""",
    "calls",
)
def p6_end_of_day(read):
    return calls(read).select("call_id", p.end_of_day(F.col("created_at")).alias("day_end"))


@query(
    """SELECT paper_id, tag FROM papers WHERE paper_id IN (SELECT paper_id FROM usages WHERE status = 'rejected')
    AND paper_id NOT IN (SELECT paper_id FROM usages WHERE status = 'approved')""",
    "papers",
    "usages",
)
def p7_has_child(read):
    use = usages(read)
    having = lambda s: use.where(F.col("status") == s).select("paper_id")
    return papers(read).join(having("rejected"), "paper_id", "left_semi").join(having("approved"), "paper_id", "left_anti").select("paper_id", "tag")


@query(f", {TAGGED} SELECT instrument_id FROM tagged WHERE list_has_all(tags, ['red', 'ring'])", "instruments")
def p8_tags_all(read):
    return tagged(read).where(p.has_all(F.col("tags"), ["red", "ring"])).select("instrument_id")


@query(f", {TAGGED} SELECT instrument_id FROM tagged WHERE list_has_any(tags, ['red', 'ring'])", "instruments")
def p9_tags_any(read):
    return tagged(read).where(p.has_any(F.col("tags"), ["red", "ring"])).select("instrument_id")


@query(f", {TAGGED} SELECT instrument_id FROM tagged WHERE NOT list_has_all(tags, ['red'])", "instruments")
def p10_tags_exclude(read):
    return tagged(read).where(~p.has_all(F.col("tags"), ["red"])).select("instrument_id")


@query(
    """SELECT paper_id, instrument_id, win_start, win_end - INTERVAL 20 DAY AS cut_end FROM usages WHERE win_start <= win_end - INTERVAL 20 DAY""",
    "usages",
)
def p11_nonempty_windows(read):
    cut = usages(read).withColumn("cut_end", F.col("win_end") - F.expr("interval 20 days"))
    return cut.where(p.nonempty_window(F.col("win_start"), F.col("cut_end"))).select("paper_id", "instrument_id", "win_start", "cut_end")


@query(
    """SELECT paper_id, instrument_id, observatory_id, CASE WHEN paper_id % 3 = 0 THEN win_end ELSE win_start END AS f, CASE WHEN paper_id % 3 = 0 THEN win_start ELSE win_end END AS t FROM usages WHERE NOT (paper_id % 3 = 0 AND win_start < win_end)""",
    "usages",
)
def d8_reversed_ranges(read):
    """Windows of a third of the papers come the wrong way round and are rejected, but for those of one day."""
    swap = F.col("paper_id") % 3 == 0
    given = usages(read).select("paper_id", "instrument_id", "observatory_id", F.when(swap, F.col("win_end")).otherwise(F.col("win_start")).alias("f"), F.when(swap, F.col("win_start")).otherwise(F.col("win_end")).alias("t"))
    return given.where(p.nonempty_window(F.col("f"), F.col("t")))


@query(
    """SELECT paper_id, count(*) AS total, count(*) FILTER (status IN ('approved', 'rejected')) AS validated,
    CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (status IN ('approved', 'rejected')) / count(*), 4) ELSE 0 END AS progress
    FROM papers LEFT JOIN usages USING (paper_id) WHERE status IS NOT NULL GROUP BY paper_id""",
    "papers",
    "usages",
)
def p12_progress(read):
    done, total = F.col("validated"), F.col("total")
    per = usages(read).groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("approved", "rejected")).alias("validated"))
    return papers(read).select("paper_id").join(per, "paper_id").withColumn("progress", F.when(total > 0, F.round(100.0 * done / total, 4)).otherwise(F.lit(0.0)))


@query(
    """SELECT instrument_id, coalesce(nullif(CASE WHEN channels > 25 THEN '' ELSE instrument END, ''), mission) AS display FROM instruments""",
    "instruments",
)
def p13_fallback_name(read):
    named = instruments(read).withColumn("display_name", F.when(F.col("channels") > 25, "").otherwise(F.col("instrument")))
    return named.select("instrument_id", p.first_nonempty(F.col("display_name"), F.col("mission")).alias("display"))


@query("SELECT call_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM calls WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.batch') IS NULL", "calls")
def p14_json_path(read):
    return calls(read).where(F.get_json_object("props", "$.k").isNotNull() & F.get_json_object("props", "$.batch").isNull()).select("call_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT call_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS called_on FROM calls WHERE CAST(created_at AS DATE) >= DATE '2024-01-05' AND CAST(created_at AS DATE) <> DATE '2024-01-07'", "calls")
def p15_date_part(read):
    called = F.to_date("created_at")
    return calls(read).where((called >= F.lit("2024-01-05").cast("date")) & (called != F.lit("2024-01-07").cast("date"))).select("call_id", called.cast("string").alias("called_on"))


#: Patterns of the rule-bank query, made for the test tables.
BANK = (["lorem"], ["erblest"], ["thon", "onthsh", "eauxele"])


@query(
    """SELECT doc_id, coalesce(text <> '' AND NOT regexp_matches(text, '(?i)lorem') AND (regexp_matches(text, '(?i)erblest') OR
    (CAST(regexp_matches(text, '(?i)thon') AS INT) + CAST(regexp_matches(text, '(?i)onthsh') AS INT) + CAST(regexp_matches(text, '(?i)eauxele') AS INT)) >= 2), false) AS hit FROM documents""",
)
def p16_regex_bank(read):
    return read("documents").select("doc_id", p.regex_bank(F.col("text"), *BANK).alias("hit"))


@query("SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://')", )
def p17_prefix_cleanup(read):
    return read("pages").where(~F.col("url").startswith("http://")).select("page_id", "url")


@query(
    """SELECT instrument_id, upper(left(w, 1)) || lower(substr(w, 2)) AS word FROM (SELECT instrument_id, unnest(regexp_split_to_array(trim(instrument), '\\s+')) AS w FROM instruments)""",
    "instruments",
)
def p18_explode_words(read):
    word = F.explode(F.split(F.trim("instrument"), r"\s+"))
    return instruments(read).select("instrument_id", word.alias("word")).withColumn("word", F.initcap("word"))


@query("SELECT paper_id, instrument_id, win_start, round((epoch_us(win_end) - epoch_us(win_start)) / 3600000000.0::DOUBLE, 2) AS hours FROM usages", "usages")
def p19_duration_hours(read):
    return usages(read).select("paper_id", "instrument_id", "win_start", F.round((F.unix_micros("win_end") - F.unix_micros("win_start")) / 3.6e9, 2).alias("hours"))


@query(
    """SELECT call_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS half FROM calls WHERE json_type(props, '$.k') IS NOT NULL""",
    "calls",
)
def p20_nested_field(read):
    params = F.from_json("props", "struct<k: double>")
    return calls(read).where(params["k"].isNotNull()).select("call_id", (params["k"] / 2).alias("half"))


# --- joins -------------------------------------------------------------------------------------------------------


@query(
    """SELECT u.paper_id, u.win_start, i.instrument, i.mission, o.observatory, o.country, o.datasource
    FROM usages u JOIN instruments i USING (instrument_id) JOIN observatories o USING (observatory_id)""",
    "usages",
    "instruments",
    "observatories",
)
def j1_star(read):
    star = usages(read).join(instruments(read), "instrument_id").join(observatories(read), "observatory_id")
    return star.select("paper_id", "win_start", "instrument", "mission", "observatory", "country", "datasource")


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j2_left_child(read):
    return read("documents").select("doc_id", "source").join(read("labels"), "doc_id", "left")


@query(
    """SELECT paper_id, tag, string_agg(instrument_id || '@' || strftime(win_start, '%Y-%m-%d'), ';' ORDER BY instrument_id, win_start) AS children
    FROM papers JOIN usages USING (paper_id) GROUP BY paper_id, tag""",
    "papers",
    "usages",
)
def j3_nested_children(read):
    one = F.struct("instrument_id", "win_start")
    nested = usages(read).groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("of"))
    text = F.array_join(F.transform("of", lambda x: F.concat_ws("@", x["instrument_id"].cast("string"), F.date_format(x["win_start"], "yyyy-MM-dd"))), ";")
    return papers(read).join(nested, "paper_id").select("paper_id", "tag", text.alias("children"))


@query(
    """SELECT paper_id, EXISTS (SELECT 1 FROM usages u WHERE u.paper_id = p.paper_id AND u.status = 'approved') AS has_approved FROM papers p""",
    "papers",
    "usages",
)
def j4_exists_flag(read):
    found = usages(read).where("status = 'approved'").select("paper_id", F.lit(True).alias("has_approved")).distinct()
    return papers(read).select("paper_id").join(found, "paper_id", "left").fillna(False, ["has_approved"])


@query("SELECT instrument_id, instrument FROM instruments WHERE instrument_id NOT IN (SELECT instrument_id FROM usages WHERE paper_id % 7 = 0)", "instruments", "usages")
def j5_unused_instruments(read):
    """Instruments that no paper of one share of all papers uses."""
    return instruments(read).join(usages(read).where("paper_id % 7 = 0"), "instrument_id", "left_anti").select("instrument_id", "instrument")


@query(
    """SELECT paper_id FROM papers WHERE paper_id IN (SELECT paper_id FROM usages WHERE instrument_id % 50 = 3)
    OR paper_id IN (SELECT paper_id FROM usages WHERE observatory_id % 40 = 3)""",
    "papers",
    "usages",
)
def j6_either_membership(read):
    use = usages(read)
    either = use.where("instrument_id % 50 = 3").select("paper_id").union(use.where("observatory_id % 40 = 3").select("paper_id"))
    return papers(read).select("paper_id").join(either, "paper_id", "left_semi")


@query(
    """SELECT p.paper_id, coalesce(n, 0) AS n_usages, coalesce(ok, 0) AS n_approved, last_end FROM papers p LEFT JOIN
    (SELECT paper_id, count(*) AS n, count(*) FILTER (status = 'approved') AS ok, max(win_end) AS last_end FROM usages GROUP BY 1) USING (paper_id)""",
    "papers",
    "usages",
)
def j7_paper_counts(read):
    counted = j.attach_counts(papers(read).select("paper_id"), usages(read), "paper_id", n_usages=F.count("*"), n_approved=F.count_if(F.col("status") == "approved"), last_end=F.max("win_end"))
    return counted.fillna(0, ["n_usages", "n_approved"])


@query(
    """SELECT author_id, paper_id AS newest_paper, created_at FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY created_at DESC, paper_id DESC) AS r FROM papers) WHERE r = 1""",
    "papers",
)
def j8_latest_paper(read):
    newest = j.latest(papers(read).select("author_id", "paper_id", "created_at"), ["author_id"], "created_at", "paper_id")
    return newest.select("author_id", F.col("paper_id").alias("newest_paper"), "created_at")


def _campaigns(read):
    """Half-open thirty-day windows for each observatory, one for each year."""
    year = F.explode(F.sequence(F.lit(1994), F.lit(2000)))
    begun = observatories(read).select("observatory_id", year.alias("year"))
    start = F.make_timestamp("year", F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return begun.select("observatory_id", "year", start.alias("start"), (start + F.expr("interval 30 days")).alias("end"))


@query(
    """, campaigns AS (SELECT observatory_id, y AS year, make_timestamp(y, 3, 1, 0, 0, 0) AS s, make_timestamp(y, 3, 1, 0, 0, 0) + INTERVAL 30 DAY AS e
      FROM observatories, range(1994, 2001) t(y))
    SELECT observatory_id, CAST(year AS INT) AS year, count(*) AS n_usages, count(DISTINCT paper_id) AS n_papers
    FROM usages JOIN campaigns USING (observatory_id) WHERE win_start < e AND win_end >= s GROUP BY ALL""",
    "usages",
    "observatories",
)
def j9_window_overlap(read):
    met = j.window_overlap_join(usages(read), _campaigns(read), keys=["observatory_id"])
    return met.groupBy("observatory_id", "year").agg(F.count("*").alias("n_usages"), F.countDistinct("paper_id").alias("n_papers"))


@query(
    """, valid AS (SELECT observatory_id % 5 AS source, instrument_id, win_start AS f, CASE WHEN channels % 9 > 0 THEN win_end + INTERVAL 90 DAY END AS t FROM usages JOIN instruments USING (instrument_id) WHERE status = 'approved')
    SELECT status, count(*) AS n, count(*) FILTER (inside) AS n_inside FROM (
      SELECT u.status, EXISTS (SELECT 1 FROM valid v WHERE v.source = u.observatory_id % 5 AND v.instrument_id = u.instrument_id AND u.win_start >= f AND u.win_end <= coalesce(t, TIMESTAMP '2000-01-01')) AS inside FROM usages u) GROUP BY status""",
    "usages",
    "instruments",
)
def j10_inside_validity(read):
    """Every approved window of a source and instrument is a range of its own, some of them open."""
    use = usages(read).withColumn("source", F.col("observatory_id") % 5)
    approved = use.where("status = 'approved'").join(instruments(read).select("instrument_id", "channels"), "instrument_id")
    valid = approved.select("source", "instrument_id", F.col("win_start").alias("valid_from"), F.when(F.col("channels") % 9 > 0, F.col("win_end") + F.expr("interval 90 day")).alias("valid_to"))
    told = j.contained_join(use.select("source", "instrument_id", "status", "win_start", "win_end"), valid, keys=["source", "instrument_id"], window=("win_start", "win_end"), valid=("valid_from", "valid_to"), as_of=day("2000-01-01"))
    return told.groupBy("status").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside"))


@query(
    """, bands AS (SELECT mission, CAST(min(channels) AS DOUBLE) + 2 AS lo, CAST(max(channels) AS DOUBLE) - 2 AS hi FROM instruments GROUP BY mission)
    SELECT instrument_id, mission, coalesce(bool_or(channels - 1 >= lo AND channels + 1 <= hi), false) AS inside FROM instruments LEFT JOIN bands USING (mission) GROUP BY ALL""",
    "instruments",
)
def j11_spectral_inside(read):
    every = instruments(read)
    bands = every.groupBy("mission").agg((F.min("channels") + 2.0).alias("lo"), (F.max("channels") - 2.0).alias("hi"))
    inside = (F.col("channels") - 1 >= F.col("lo")) & (F.col("channels") + 1 <= F.col("hi"))
    return every.join(bands, "mission", "left").select("instrument_id", "mission", F.coalesce(inside, F.lit(False)).alias("inside"))


@query(
    """SELECT mission, datasource, count(*) AS n_links FROM instruments JOIN usages USING (instrument_id) JOIN observatories USING (observatory_id) GROUP BY ALL""",
    "usages",
    "instruments",
    "observatories",
)
def j12_bridge(read):
    return usages(read).join(instruments(read), "instrument_id").join(observatories(read), "observatory_id").groupBy("mission", "datasource").agg(F.count("*").alias("n_links"))


@query(
    """SELECT want, i.instrument_id FROM (VALUES ('RED RING'), ('Small Widget'), ('nothing')) t(want) LEFT JOIN instruments i ON upper(i.instrument) = upper(want)""",
    "instruments",
)
def j13_case_blind_lookup(read):
    every = instruments(read)
    want = every.sparkSession.createDataFrame([("RED RING",), ("Small Widget",), ("nothing",)], "want string")
    return want.join(every, F.upper("instrument") == F.upper("want"), "left").select("want", "instrument_id")


@query(
    """, wanted AS (SELECT DISTINCT instrument AS code, CASE WHEN channels % 3 = 0 THEN mission WHEN channels % 3 = 1 THEN 'Brand#none' END AS mission FROM instruments),
    exact AS (SELECT instrument AS code, mission, min(instrument_id) AS id FROM instruments GROUP BY 1, 2),
    single AS (SELECT instrument AS code, min(mission) AS m FROM instruments GROUP BY 1 HAVING count(DISTINCT mission) = 1),
    only_mission AS (SELECT DISTINCT mission FROM instruments)
    SELECT w.code, w.mission, e.id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN s.m IS NOT NULL THEN 'unique_code' WHEN o.mission IS NOT NULL THEN 'mission_only' ELSE 'none' END AS how
    FROM wanted w LEFT JOIN exact e ON w.code = e.code AND w.mission = e.mission LEFT JOIN single s ON s.code = w.code LEFT JOIN only_mission o ON o.mission = w.mission""",
    "instruments",
)
def j14_staged_resolution(read):
    every = instruments(read)
    wanted = every.select(F.col("instrument").alias("code"), F.when(F.col("channels") % 3 == 0, F.col("mission")).when(F.col("channels") % 3 == 1, "Brand#none").alias("mission")).distinct()
    exact = every.groupBy(F.col("instrument").alias("code"), "mission").agg(F.min("instrument_id").alias("id"))
    single = every.groupBy(F.col("instrument").alias("code")).agg(F.min("mission").alias("m"), F.countDistinct("mission").alias("k")).where("k = 1").drop("k")
    only = every.select("mission", F.lit(True).alias("known")).distinct()
    how = F.when(F.col("id").isNotNull(), "exact").when(F.col("m").isNotNull(), "unique_code").when(F.col("known"), "mission_only").otherwise("none")
    return wanted.join(exact, ["code", "mission"], "left").join(single, "code", "left").join(only, "mission", "left").select("code", "mission", "id", how.alias("how"))


@query(
    """, hits AS (SELECT upper(instrument) AS k, count(DISTINCT mission) AS n, min(mission) AS code FROM instruments GROUP BY 1)
    SELECT w.name, CASE WHEN source IS NOT NULL THEN 'explicit' WHEN n IS NULL THEN 'lookup-none' WHEN n = 1 THEN 'lookup-unique' ELSE 'ambiguous' END AS resolution, CASE WHEN source IS NOT NULL THEN upper(source) WHEN n = 1 THEN upper(code) END AS code
    FROM (SELECT DISTINCT CASE WHEN channels % 5 = 0 THEN instrument || '?' ELSE lower(instrument) END AS name, CASE WHEN channels % 7 = 0 THEN kind END AS source FROM instruments) w LEFT JOIN hits ON hits.k = upper(w.name)""",
    "instruments",
)
def j15_ambiguity(read):
    """Names of which some are unknown and some come with a source of their own, which then holds."""
    every = instruments(read)
    names = every.select(F.when(F.col("channels") % 5 == 0, F.concat("instrument", F.lit("?"))).otherwise(F.lower("instrument")).alias("name"), F.when(F.col("channels") % 7 == 0, F.col("kind")).alias("source")).distinct()
    return j.resolve_unique(names, every, name_col="name", catalog_col="instrument", code_col="mission", explicit="source").select("name", "resolution", "code")


@query(
    """, hits AS (SELECT upper(instrument) AS k, count(DISTINCT mission) AS n, min(mission) AS code FROM instruments GROUP BY 1)
    SELECT DISTINCT w.name, CASE WHEN n IS NULL THEN 'lookup-none' WHEN n = 1 THEN 'lookup-unique' ELSE 'ambiguous' END AS resolution, CASE WHEN n = 1 THEN upper(code) END AS code
    FROM (SELECT DISTINCT instrument AS name FROM instruments) w LEFT JOIN hits ON hits.k = upper(w.name)""",
    "instruments",
)
def j15_ambiguity_whole_catalog(read):
    every = instruments(read)
    return j.resolve_unique(every.select(F.col("instrument").alias("name")).distinct(), every, name_col="name", catalog_col="instrument", code_col="mission")


@query(
    """SELECT a.rater_id AS rater_a, b.rater_id AS rater_b, count(*) AS shared, count(*) FILTER (a.status = b.status) AS agreed FROM votes a JOIN votes b ON a.item_id = b.item_id AND a.rater_id < b.rater_id GROUP BY 1, 2""",
    "votes",
)
def j16_rater_pairs(read):
    one = votes(read)
    a, b = (one.select("item_id", F.col("rater_id").alias(f"rater_{s}"), F.col("status").alias(f"status_{s}")) for s in "ab")
    met = a.join(b, "item_id").where("rater_a < rater_b")
    return met.groupBy("rater_a", "rater_b").agg(F.count("*").alias("shared"), F.count_if(F.col("status_a") == F.col("status_b")).alias("agreed"))


@query(
    """SELECT a.configuration || b.configuration AS pair, count(*) AS n_pairs, count(*) FILTER (a.observatory_id = b.observatory_id) AS same
    FROM usages a JOIN usages b ON a.paper_id = b.paper_id AND a.configuration = 'F' AND b.configuration = 'O' GROUP BY 1""",
    "usages",
)
def j17_cross_runs(read):
    """Runs of one configuration against those of the other for each paper: their number is a product of counts, so no pair is made."""
    per = usages(read).groupBy("paper_id", "observatory_id").agg(F.count_if(F.col("configuration") == "F").alias("f"), F.count_if(F.col("configuration") == "O").alias("o"))
    totals = per.groupBy("paper_id").agg(F.sum("f").alias("f"), F.sum("o").alias("o"), F.sum(F.col("f") * F.col("o")).alias("same"))
    return totals.agg(F.lit("FO").alias("pair"), F.sum(F.col("f") * F.col("o")).alias("n_pairs"), F.sum("same").alias("same"))


@query(
    """SELECT u.paper_id, a.instrument_id AS first_run, b.instrument_id AS second_run, count(*) AS pairs, count(*) FILTER (a.status = b.status) AS agreed
    FROM (SELECT DISTINCT paper_id FROM usages) u JOIN usages a ON a.paper_id = u.paper_id AND a.observatory_id % 2 = 0 JOIN usages b ON b.paper_id = u.paper_id AND b.observatory_id % 2 = 1 GROUP BY 1, 2, 3""",
    "usages",
)
def j17_run_pairs(read):
    """The pairs themselves: each row of a paper's first run against each of its second. A paper has few rows, so its product is small.

    Both runs are dealt by the paper into parts that follow the size of the table, so a task sorts and counts as much of a large table as of a small one.
    """
    rows = usages(read)
    of = lambda k, n: rows.where(F.col("observatory_id") % 2 == k).select("paper_id", F.col("instrument_id").alias(n), F.col("status").alias(f"of_{n}")).repartition(parts, "paper_id")
    parts = parts_for(rows)
    met = of(0, "first_run").join(of(1, "second_run"), "paper_id")
    return met.groupBy("paper_id", "first_run", "second_run").agg(F.count("*").alias("pairs"), F.count_if(F.col("of_first_run") == F.col("of_second_run")).alias("agreed"))


@query(
    """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier
      UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE 'c' || (c_custkey + 1) // 2 END, c_mktsegment FROM customer WHERE c_custkey <> 1),
    t AS (SELECT node, node AS root, 0 AS depth, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.node, t.root, t.depth + 1, t.path || ' / ' || n.name FROM n JOIN t ON n.parent = t.node) SELECT * FROM t""",
)
def j18_tree_paths(read):
    """Every node of a tree of unequal depth with its root, depth and path; nodes that hang on none are left out."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    k = F.col("c_custkey")
    rows = [
        read("region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")),
        read("nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")),
        read("supplier").select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name")),
        read("customer").where("c_custkey <> 1").select(key("c", "c_custkey").alias("node"), F.when(k % 2 == 0, key("n", "c_nationkey")).otherwise(F.concat(F.lit("c"), F.floor((k + 1) / 2))).alias("parent"), F.col("c_mktsegment").alias("name")),
    ]
    nodes = reduce(DataFrame.unionByName, rows)
    return j.descend(nodes, node="node", parent="parent", name="name")


@query(
    """SELECT r_name AS root, n_name AS child, count(s_suppkey) AS leaves FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
def j18_tree(read):
    """Node table of (node, parent), walked down level by level from the roots."""
    node = lambda df, key, parent, name, kind: df.select(F.concat_ws(":", F.lit(kind), F.col(key).cast("string")).alias("node"), parent.alias("parent"), F.col(name).alias("name"))
    key = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col(c).cast("string"))
    nodes = node(read("region"), "r_regionkey", F.lit(None).cast("string"), "r_name", "r").unionByName(node(read("nation"), "n_nationkey", key("r", "n_regionkey"), "n_name", "n")).unionByName(node(read("supplier"), "s_suppkey", key("n", "s_nationkey"), "s_name", "s"))
    roots = nodes.where("parent is null").select(F.col("node").alias("top"), F.col("name").alias("root"))
    middle = nodes.select(F.col("node").alias("mid"), F.col("parent").alias("top"), F.col("name").alias("child")).join(roots, "top")
    leaves = nodes.select(F.col("parent").alias("mid"), F.col("node").alias("leaf"))
    return middle.join(leaves, "mid", "left").groupBy("root", "child").agg(F.count("leaf").alias("leaves"))


@query(
    """WITH a AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations WHERE turn = 0),
    b AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations WHERE turn = 1)
    SELECT conv_id, count(*) AS lines, count(*) FILTER (a.line = b.line) AS equal_lines FROM a JOIN b USING (conv_id, place) GROUP BY conv_id""",
)
def j19_positional_zip(read):
    lines = lambda turn, name: read("conversations").where(F.col("turn") == turn).select("conv_id", F.posexplode(F.split("text", "\n")).alias("place", name))
    return lines(0, "x").join(lines(1, "y"), ["conv_id", "place"]).groupBy("conv_id").agg(F.count("*").alias("lines"), F.count_if(F.col("x") == F.col("y")).alias("equal_lines"))


@query(
    """, a AS (SELECT * FROM instruments WHERE channels <= 10), b AS (SELECT * FROM instruments WHERE channels BETWEEN 8 AND 14)
    SELECT instrument_id, mission || '::' || upper(instrument) AS key, 'a' AS origin FROM a UNION ALL
    SELECT instrument_id, mission || '::' || upper(instrument), 'b' FROM b WHERE mission || '::' || upper(instrument) NOT IN (SELECT mission || '::' || upper(instrument) FROM a)""",
    "instruments",
)
def j20_catalog_merge(read):
    every = instruments(read).select("instrument_id", "channels", F.concat_ws("::", "mission", F.upper("instrument")).alias("key"))
    merged = j.merge_catalogs(every.where("channels <= 10").withColumn("origin", F.lit("a")), every.where("channels between 8 and 14").withColumn("origin", F.lit("b")), F.col("key"))
    return merged.select("instrument_id", "key", "origin")

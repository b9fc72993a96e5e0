"""The public listing, filter options, search, queues, scripts and campaigns in full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litquarry.functions import predicates as p
from litquarry.functions import statistics as s
from litquarry.functions.text import short_id
from litquarry.operators.validation import user_pages
from litquarry.plans.registry import query
from litquarry.plans.relational import day
from litquarry.sources.roles import calls, instruments, observatories, papers, usages, votes

STAR = ("usages", "instruments", "observatories")


@query(
    """, hit AS (SELECT DISTINCT paper_id FROM usages JOIN instruments USING (instrument_id) JOIN observatories USING (observatory_id) WHERE status <> 'rejected' AND status <> 'needs_review' AND datasource = 'ASIA' AND mission IN ('Brand#3', 'Brand#7')),
    mention AS (SELECT DISTINCT paper_id FROM usages JOIN observatories USING (observatory_id) WHERE status = 'needs_review' AND datasource = 'ASIA'), ids AS (SELECT * FROM hit UNION SELECT * FROM mention),
    u AS (SELECT paper_id, count(*) FILTER (status <> 'rejected') AS total_count, count(*) FILTER (status IN ('approved', 'rejected')) AS validated_count, max(win_end) FILTER (status <> 'rejected') AS open_end FROM usages GROUP BY 1)
    SELECT p.paper_id, tag, h.paper_id IS NOT NULL AS by_usage, total_count, validated_count, open_end FROM papers p JOIN ids USING (paper_id) JOIN u USING (paper_id) LEFT JOIN hit h ON h.paper_id = p.paper_id WHERE contains(lower(tag), 'h') ORDER BY open_end DESC NULLS FIRST, p.paper_id LIMIT 20""",
    "papers",
    *STAR,
)
def c1_listing_with_missions(read):
    """Papers with a usage that fits, or that only mention a mission of the source (here what needs review). Counts are made of the shown papers' usages alone."""
    use = usages(read)
    source = observatories(read).where("datasource = 'ASIA'").select("observatory_id")
    near = use.join(source, "observatory_id", "left_semi")
    chosen = instruments(read).where(F.col("mission").isin("Brand#3", "Brand#7")).select("instrument_id")
    hit = near.where(~F.col("status").isin("rejected", "needs_review")).join(chosen, "instrument_id", "left_semi").select("paper_id", F.lit(True).alias("by_usage"))
    only = near.where(F.col("status") == "needs_review").select("paper_id", F.lit(False).alias("by_usage"))
    ids = hit.unionByName(only).groupBy("paper_id").agg(F.bool_or("by_usage").alias("by_usage"))
    shown = papers(read).where(p.icontains(F.col("tag"), "H")).select("paper_id", "tag").join(ids, "paper_id")
    of = use.join(shown.select("paper_id"), "paper_id", "left_semi").groupBy("paper_id")
    counts = of.agg(F.count_if(F.col("status") != "rejected").alias("total_count"), F.count_if(F.col("status").isin("approved", "rejected")).alias("validated_count"), F.max(F.when(F.col("status") != "rejected", F.col("win_end"))).alias("open_end"))
    return shown.join(counts, "paper_id").select("paper_id", "tag", "by_usage", "total_count", "validated_count", "open_end").orderBy(F.desc_nulls_first("open_end"), "paper_id").limit(20)


@query(
    """, u AS (SELECT * FROM usages WHERE status <> 'rejected'), o AS (SELECT datasource, observatory_id, observatory, count(DISTINCT paper_id) AS papers, count(DISTINCT instrument_id) AS instruments, min(win_start) AS first_start, max(win_end) AS last_end FROM u JOIN observatories USING (observatory_id) GROUP BY 1, 2, 3)
    SELECT datasource, count(*) AS observatories, string_agg(observatory, '|' ORDER BY observatory) AS names, CAST(sum(instruments) AS BIGINT) AS links, min(first_start) AS first_start, max(last_end) AS last_end FROM o GROUP BY 1""",
    *STAR[::2],
)
def c3_option_lists(read):
    """Per data source: its observatories by name and the span of their windows. Usages are counted by key before any name is joined."""
    per = usages(read).where("status <> 'rejected'").groupBy("observatory_id", "instrument_id").agg(F.min("win_start").alias("a"), F.max("win_end").alias("b"))
    each = per.groupBy("observatory_id").agg(F.count("*").alias("instruments"), F.min("a").alias("a"), F.max("b").alias("b"))
    named = each.join(observatories(read), "observatory_id").groupBy("datasource")
    return named.agg(F.count("*").alias("observatories"), F.array_join(F.array_sort(F.collect_list("observatory")), "|").alias("names"), F.sum("instruments").alias("links"), F.min("a").alias("first_start"), F.max("b").alias("last_end"))


@query(
    """, m AS (SELECT DISTINCT observatory_id, paper_id FROM usages WHERE status = 'needs_review' UNION SELECT DISTINCT observatory_id, paper_id FROM usages WHERE status = 'approved') SELECT observatory_id, observatory, datasource, count(*) AS papers FROM m JOIN observatories USING (observatory_id) GROUP BY 1, 2, 3""",
    "usages",
    "observatories",
)
def c3_observatory_papers(read):
    """Papers of each observatory: those of its usages and those that only mention it, each once."""
    use = usages(read)
    both = use.where("status = 'needs_review'").select("observatory_id", "paper_id").union(use.where("status = 'approved'").select("observatory_id", "paper_id")).distinct()
    return both.groupBy("observatory_id").agg(F.count("*").alias("papers")).join(observatories(read), "observatory_id").select("observatory_id", "observatory", "datasource", "papers")


@query(
    """, m AS (SELECT place, avg(x) AS x FROM (SELECT generate_subscripts(embedding, 1) AS place, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE label = 3) GROUP BY 1), v AS (SELECT list(x ORDER BY place) AS v FROM m),
    near AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, v WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 200), best AS (SELECT label, max(score) AS score FROM near GROUP BY 1 ORDER BY score DESC, label LIMIT 10)
    SELECT b.label AS paper_id, round(b.score, 3) AS score, coalesce(string_agg(DISTINCT mission, ',' ORDER BY mission), '') AS missions FROM best b LEFT JOIN usages u ON u.paper_id = b.label LEFT JOIN instruments USING (instrument_id) GROUP BY 1, 2""",
    "usages",
    "instruments",
)
def c4_similar_with_missions(read):
    """The ten most similar papers, as c4_similar_papers, with the missions that each of them used."""
    from litquarry.plans.ranking import c4_similar_papers

    best = c4_similar_papers(read).select(F.col("label").cast("long").alias("paper_id"), "score")
    used = usages(read).join(best.select("paper_id"), "paper_id", "left_semi").join(instruments(read).select("instrument_id", "mission"), "instrument_id")
    missions = used.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("mission")), ",").alias("missions"))
    return best.join(missions, "paper_id", "left").fillna("", ["missions"])


@query(
    """, o AS (SELECT observatory, count(*) AS n, count(DISTINCT paper_id) AS papers, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status IN ('approved', 'rejected')) AS done FROM usages JOIN observatories USING (observatory_id) WHERE win_start < TIMESTAMP '1997-01-01' AND win_end >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT observatory, n, papers, approved, rejected, round(100.0::DOUBLE * done / n, 4) AS done_pct, round(100.0::DOUBLE * n / (SELECT sum(n) FROM o), 4) AS share_pct, round(n / papers::DOUBLE, 4) AS per_paper FROM o""",
    "usages",
    "observatories",
)
def c7_observatory_rates(read):
    """All observatories of a year, not only the first ten: counts, what is decided, and shares of all usages."""
    within = usages(read).where(p.overlaps(F.col("win_start"), F.col("win_end"), day("1996-01-01"), day("1997-01-01")))
    each = within.groupBy("observatory_id", "paper_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    per = each.groupBy("observatory_id").agg(F.count("*").alias("papers"), *(F.sum(c).alias(c) for c in ("n", "approved", "rejected")))
    named = per.join(observatories(read).select("observatory_id", "observatory"), "observatory_id")
    total = F.sum("n").over(Window.partitionBy())  # one row an observatory
    return named.select("observatory", "n", "papers", "approved", "rejected", F.round(100.0 * (F.col("approved") + F.col("rejected")) / F.col("n"), 4).alias("done_pct"), F.round(100.0 * F.col("n") / total, 4).alias("share_pct"), F.round(F.col("n") / F.col("papers"), 4).alias("per_paper"))


@query(
    """, n AS (SELECT paper_id, count(*) AS total, count(*) FILTER (status IN ('approved', 'rejected')) AS done, count(*) FILTER (status = 'needs_review') AS to_review FROM usages GROUP BY 1)
    SELECT paper_id, tag, total, done, to_review, CASE WHEN total > 0 THEN round(100.0::DOUBLE * done / total, 1) ELSE 0 END AS progress FROM n JOIN papers USING (paper_id) WHERE done < total ORDER BY to_review DESC, progress DESC, paper_id LIMIT 50""",
    "papers",
    "usages",
)
def c8_queue(read):
    """Papers that aren't finished: those with most to review first, then those that lack least."""
    per = usages(read).groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("approved", "rejected")).alias("done"), F.count_if(F.col("status") == "needs_review").alias("to_review")).where("done < total")
    met = per.join(papers(read).select("paper_id", "tag"), "paper_id").withColumn("progress", F.round(s.share(F.col("done"), F.col("total"), 100.0), 1))
    return met.select("paper_id", "tag", "total", "done", "to_review", "progress").orderBy(F.desc("to_review"), F.desc("progress"), "paper_id").limit(50)


@query(
    """, n AS (SELECT paper_id, count(*) AS total, count(*) FILTER (status IN ('approved', 'rejected')) AS done FROM usages GROUP BY 1) SELECT count(*) AS papers, count(*) FILTER (done = total) AS finished, count(*) FILTER (done > 0 AND done < total) AS begun, count(*) FILTER (done = 0) AS untouched, CAST(sum(total) AS BIGINT) AS usages, CAST(sum(done) AS BIGINT) AS done FROM n""",
    "usages",
)
def c8_queue_stats(read):
    per = usages(read).groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("approved", "rejected")).alias("d"))
    return per.agg(
        F.count("*").alias("papers"), F.count_if(F.col("d") == F.col("total")).alias("finished"), F.count_if((F.col("d") > 0) & (F.col("d") < F.col("total"))).alias("begun"), F.count_if(F.col("d") == 0).alias("untouched"), F.sum("total").alias("usages"), F.sum("d").alias("done"))


@query("SELECT paper_id, status, count(*) AS n, count(DISTINCT instrument_id) AS instruments, min(win_start) AS first_start FROM usages GROUP BY 1, 2", "usages")
def c8_paper_stats(read):
    return usages(read).groupBy("paper_id", "status").agg(F.count("*").alias("n"), F.count_distinct("instrument_id").alias("instruments"), F.min("win_start").alias("first_start"))


@query(
    """, v AS (SELECT event_id % 500 AS item_id, user_id % 5 AS rater_id, CAST(ts AS DATE) AS on_day FROM events), d AS (SELECT rater_id, on_day, count(*) AS n FROM v GROUP BY 1, 2), cal AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-20', INTERVAL 1 DAY))::DATE AS on_day), r AS (SELECT DISTINCT rater_id FROM v)
    SELECT r.rater_id, CAST(cal.on_day AS VARCHAR) AS on_day, coalesce(n, 0) AS n FROM r CROSS JOIN cal LEFT JOIN d ON d.rater_id = r.rater_id AND d.on_day = cal.on_day""".replace(", v AS", "WITH v AS", 1),
)
def c9_rater_days(read):
    """Votes of each rater on each day of a span, days without any too. The calendar is made within each rater's row."""
    each = read("events").select((F.col("user_id") % 5).alias("rater_id"), F.to_date("ts").alias("on_day"))
    counted = each.groupBy("rater_id", "on_day").agg(F.count("*").alias("n"))
    calendar = counted.select("rater_id").distinct().withColumn("on_day", F.explode(F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))))
    return calendar.join(counted, ["rater_id", "on_day"], "left").select("rater_id", F.col("on_day").cast("string").alias("on_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """, u AS (SELECT paper_id, configuration, instrument_id, status, observatory_id % 5 AS rater, CASE WHEN status <> 'pending' THEN win_end END AS made FROM usages),
    r AS (SELECT DISTINCT rater FROM u WHERE made IS NOT NULL), mine AS (SELECT rater, count(*) AS total, count(*) FILTER (CAST(made AS DATE) = DATE '1996-06-15') AS today, count(*) FILTER (made >= TIMESTAMP '1996-06-08 12:00:00') AS week FROM u WHERE made IS NOT NULL GROUP BY 1),
    a AS (SELECT paper_id, configuration, max(made) AS last FROM u GROUP BY 1, 2 HAVING count(*) = count(made)), p AS (SELECT DISTINCT rater, paper_id, configuration, last FROM a JOIN u USING (paper_id, configuration) WHERE made IS NOT NULL),
    done AS (SELECT rater, count(*) AS analyses, count(*) FILTER (CAST(last AS DATE) = DATE '1996-06-15') AS analyses_today, count(*) FILTER (last >= TIMESTAMP '1996-06-08 12:00:00') AS analyses_week FROM p GROUP BY 1),
    d AS (SELECT rater, CAST(made AS DATE) AS on_day, count(*) AS n, count(DISTINCT paper_id) AS papers FROM u WHERE made IS NOT NULL GROUP BY 1, 2), cal AS (SELECT rater, CAST(unnest(generate_series(DATE '1996-06-09', DATE '1996-06-15', INTERVAL 1 DAY)) AS DATE) AS on_day FROM r),
    s AS (SELECT rater, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY on_day) AS claims_per_day, string_agg(CAST(coalesce(papers, 0) AS VARCHAR), ',' ORDER BY on_day) AS papers_per_day, max(coalesce(n, 0)) AS most_claims, max(coalesce(papers, 0)) AS most_papers FROM cal LEFT JOIN d USING (rater, on_day) GROUP BY 1)
    SELECT rater, total, today, week, coalesce(analyses, 0) AS analyses, coalesce(analyses_today, 0) AS analyses_today, coalesce(analyses_week, 0) AS analyses_week, claims_per_day, papers_per_day, most_claims, most_papers FROM mine LEFT JOIN done USING (rater) JOIN s USING (rater)""",
    "usages",
)
def c9_user_pages(read):
    """The page of every rater as of a moment: claims and finished analyses in all, today and in the week, and seven days of both."""
    use = usages(read).select("paper_id", F.concat_ws("-", "paper_id", "configuration").alias("analysis"), (F.col("observatory_id") % 5).alias("rater"), F.when(F.col("status") != "pending", F.col("win_end")).alias("at"))
    found = user_pages(use, as_of=F.lit("1996-06-15 12:00:00").cast("timestamp"))
    return found.withColumns({c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",") for c in ("claims_per_day", "papers_per_day")})


@query(
    """, q AS (SELECT u.*, i.instrument, o.observatory, o.datasource FROM usages u JOIN instruments i ON i.instrument_id = u.instrument_id JOIN observatories o ON o.observatory_id = u.observatory_id WHERE u.status = 'pending' AND contains(lower(o.datasource), 'asi'))
    SELECT paper_id, datasource, observatory, instrument, q.win_start, q.win_end, v.status AS my_status FROM q LEFT JOIN votes v ON v.item_id = paper_id AND v.rater_id = 3 ORDER BY paper_id, datasource, observatory, instrument, q.win_start, q.win_end, cost LIMIT 50 OFFSET 50""",
    *STAR,
    "votes",
)
def c8_user_queue(read):
    """The second page of one rater's queue: what is pending at the observatories of one source, in claim order, with the rater's own vote if there is one."""
    mine = votes(read).where("rater_id = 3").select(F.col("item_id").alias("paper_id"), F.col("status").alias("my_status"))
    places = observatories(read).where(F.contains(F.lower("datasource"), F.lit("asi"))).select("observatory_id", "observatory", "datasource")
    open_ = usages(read).where("status = 'pending'").join(places, "observatory_id").join(instruments(read).select("instrument_id", "instrument"), "instrument_id")
    order = ["paper_id", "datasource", "observatory", "instrument", "win_start", "win_end", "cost"]
    return open_.join(mine, "paper_id", "left").orderBy(*order).offset(50).limit(50).select(*order[:-1], "my_status")


@query(
    """, full_items AS (SELECT item_id FROM votes GROUP BY 1 HAVING count(*) FILTER (status IN ('approved', 'rejected')) = count(*)) SELECT rater_id, count(*) AS votes, count(*) FILTER (item_id IN (SELECT item_id FROM full_items)) AS on_finished FROM votes GROUP BY 1""",
    "votes",
)
def c9_finished_items(read):
    """How many of a rater's votes are on items that every vote decides."""
    v = votes(read)
    done = v.groupBy("item_id").agg(F.bool_and(F.col("status").isin("approved", "rejected")).alias("finished"))
    return v.join(done, "item_id").groupBy("rater_id").agg(F.count("*").alias("votes"), F.count_if("finished").alias("on_finished"))


@query(
    """SELECT paper_id, u.instrument_id, CASE WHEN datasource IN ('ASIA', 'EUROPE') THEN 'search(time(' || strftime(win_start, '%Y-%m-%d %H:%M:%S') || ', ' || strftime(win_end, '%Y-%m-%d %H:%M:%S') || '), instrument(' || instrument || '), band(' || CASE channels % 3 WHEN 0 THEN channels || ' nm' WHEN 1 THEN channels || ' keV' ELSE channels || ' cm' END || '))'
    ELSE 'get_data(' || mission || '_' || instrument || ', ' || strftime(win_start, '%Y%m%dT%H%M%SZ') || ', ' || strftime(CASE WHEN CAST(win_start AS DATE) = CAST(win_end AS DATE) THEN win_end + INTERVAL 1 DAY ELSE win_end END, '%Y%m%dT%H%M%SZ') || ')' END AS script
    FROM usages u JOIN instruments i ON i.instrument_id = u.instrument_id JOIN observatories o ON o.observatory_id = u.observatory_id WHERE status <> 'rejected' AND kind <> 'PROMO'""",
    *STAR,
)
def c20_scripts_by_source(read):
    """Two kinds of archive calls with their forms of time and units; a window within a day ends a day later in the second. Groups have no script."""
    from litquarry.functions.times import bumped_end

    star = usages(read).where("status <> 'rejected'").join(instruments(read).where("kind <> 'PROMO'"), "instrument_id").join(observatories(read).select("observatory_id", "datasource"), "observatory_id")
    form = lambda c, f: F.date_format(c, f)
    unit = F.element_at(F.array(F.lit("nm"), F.lit("keV"), F.lit("cm")), (F.col("channels") % 3 + 1).cast("int"))
    plain, packed = "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'"
    search = F.format_string("search(time(%s, %s), instrument(%s), band(%s %s))", form("win_start", plain), form("win_end", plain), "instrument", F.col("channels").cast("string"), unit)
    fetch = F.format_string("get_data(%s_%s, %s, %s)", "mission", "instrument", form("win_start", packed), form(bumped_end(F.col("win_start"), F.col("win_end")), packed))
    return star.select("paper_id", "instrument_id", F.when(F.col("datasource").isin("ASIA", "EUROPE"), search).otherwise(fetch).alias("script"))


@query(
    """, fix AS (SELECT 'red ring' AS name, NULL AS of, 'crimson ring' AS correct UNION ALL SELECT 'small widget', 'Brand#3', 'tiny widget' UNION ALL SELECT 'small widget', NULL, 'little widget')
    SELECT i.instrument_id, coalesce(a.correct, b.correct, i.instrument) AS instrument FROM instruments i LEFT JOIN fix a ON a.of IS NOT NULL AND a.name = lower(i.instrument) AND a.of = i.mission LEFT JOIN fix b ON b.of IS NULL AND b.name = lower(i.instrument)""",
    "instruments",
)
def c25_corrections(read):
    """A map of corrections by name and mission, else by name alone."""
    every = instruments(read)
    fixes = every.sparkSession.createDataFrame([("red ring", None, "crimson ring"), ("small widget", "Brand#3", "tiny widget"), ("small widget", None, "little widget")], "name string, of string, correct string")
    exact = fixes.where("of IS NOT NULL").select("name", F.col("of").alias("mission"), F.col("correct").alias("a"))
    loose = fixes.where("of IS NULL").select("name", F.col("correct").alias("b"))
    met = every.withColumn("name", F.lower("instrument")).join(exact, ["name", "mission"], "left").join(loose, "name", "left")
    return met.select("instrument_id", F.coalesce("a", "b", "instrument").alias("instrument"))


@query(
    """, c AS (SELECT DISTINCT substr(sha1(paper_id || '|' || instrument_id), 1, 12) AS claim, configuration AS stratum FROM usages WHERE status = 'pending' OR status = 'approved'), s AS (SELECT claim, CASE WHEN count(*) = 2 THEN 'both' ELSE min(stratum) END AS stratum FROM c GROUP BY 1),
    r AS (SELECT claim, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || claim), claim) AS k FROM s), p AS (SELECT * FROM r WHERE k <= 60)
    SELECT claim, stratum, (k - 1) % 4 AS reviewer, k <= 9 AS reliability, CASE WHEN k > 50 THEN NULL WHEN (k - 1) % 5 < 3 THEN 'calibration' ELSE 'blind' END AS round FROM p""",
    "usages",
)
def c26_stratified_campaign(read):
    """Claims of three strata, sixty each in hash order, dealt in turn; the first 15 % are read by all, and of the first fifty
    three in five calibrate. Before anything is ranked, a stratum is cut to the claims below a hash that sixty surely reach.
    """
    claim = short_id(F.col("paper_id").cast("string"), F.col("instrument_id").cast("string"))
    each = usages(read).where(F.col("status").isin("pending", "approved")).select(claim.alias("claim"), F.col("configuration").alias("stratum")).distinct()
    strata = each.groupBy("claim").agg(F.when(F.count("*") == 2, "both").otherwise(F.min("stratum")).alias("stratum"))
    keyed = strata.withColumn("order", F.md5(F.concat(F.lit("7:"), "claim"))).withColumn("slot", F.substring("order", 1, 3))
    slots = keyed.groupBy("stratum", "slot").agg(F.count("*").alias("n"))
    sofar = slots.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before < 60").select("stratum", "slot", "before")
    place = F.row_number().over(Window.partitionBy("stratum", "slot").orderBy("order", "claim"))
    first = keyed.join(sofar, ["stratum", "slot"]).withColumn("k", (F.col("before") + place).cast("long")).where("k <= 60")
    turn = F.when(F.col("k") > 50, F.lit(None)).when((F.col("k") - 1) % 5 < 3, "calibration").otherwise("blind")
    return first.select("claim", "stratum", ((F.col("k") - 1) % 4).alias("reviewer"), (F.col("k") <= 9).alias("reliability"), turn.alias("round"))


@query(
    """, n AS (SELECT model, call_type, count(*) AS n FROM calls GROUP BY 1, 2), b AS (SELECT model, call_type, n, row_number() OVER (PARTITION BY call_type ORDER BY n DESC, model) AS r FROM n) SELECT model, call_type, n FROM b WHERE r = 1 ORDER BY n DESC, call_type LIMIT 3""",
    "calls",
)
def w3_best_of_each(read):
    """The best of each group, then the three best of those."""
    per = calls(read).groupBy("model", "call_type").agg(F.count("*").alias("n"))
    best = per.groupBy("call_type").agg(F.max_by(F.struct("model", "n"), F.struct("n", -F.col("model"))).alias("x"))
    return best.select("x.model", "call_type", "x.n").orderBy(F.desc("n"), "call_type").limit(3)


@query(
    """, cat AS (SELECT CASE WHEN channels % 2 = 0 THEN 'archive' ELSE 'mirror' END AS system, mission, instrument AS code, min(instrument_id) AS id FROM instruments GROUP BY 1, 2, 3), missions AS (SELECT DISTINCT system, mission FROM cat), single AS (SELECT code, min(id) AS id FROM cat GROUP BY 1 HAVING count(*) = 1),
    w AS (SELECT DISTINCT CASE channels % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'mirror' ELSE 'elsewhere' END AS system, CASE WHEN channels % 5 > 0 THEN mission END AS mission, instrument AS code FROM instruments)
    SELECT w.system, w.mission, w.code, CASE WHEN m.mission IS NOT NULL THEN c.id ELSE s.id END AS id FROM w LEFT JOIN missions m ON m.system = w.system AND m.mission = w.mission LEFT JOIN cat c ON c.system = w.system AND c.mission = w.mission AND c.code = w.code LEFT JOIN single s ON s.code = w.code""",
    "instruments",
)
def j14_system_resolution(read):
    """Names by system, mission and code: the catalog's row, or the only instrument of that code where the mission is unknown."""
    from litquarry.operators.materialize import resolved
    from litquarry.plans.composites import catalog

    k = F.col("channels")
    wanted = instruments(read).select(F.when(k % 3 == 0, "archive").when(k % 3 == 1, "mirror").otherwise("elsewhere").alias("system"), F.when(k % 5 > 0, F.col("mission")).alias("mission"), F.col("instrument").alias("code")).distinct()
    return resolved(wanted, catalog(read)).select("system", "mission", "code", F.col("instrument_id").alias("id"))

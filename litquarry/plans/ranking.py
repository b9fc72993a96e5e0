"""Ranking, top-k, sampling, set operations and vector search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litquarry.functions import statistics as s
from litquarry.functions.text import short_id
from litquarry.operators import joins as j
from litquarry.operators import sampling
from litquarry.plans.registry import query
from litquarry.sources.roles import calls, instruments, observatories, papers, usages, votes


@query("SELECT model, call_type AS last_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at DESC, call_id DESC) AS r FROM calls) WHERE r = 1", "calls")
def w1_latest_call(read):
    last = j.latest(calls(read).select("model", "call_type", "created_at", "call_id"), ["model"], "created_at", "call_id")
    return last.select("model", F.col("call_type").alias("last_type"), "created_at")


@query("SELECT instrument, arg_min(mission, instrument_id) AS mission, min(instrument_id) AS instrument_id FROM instruments GROUP BY 1", "instruments")
def w2_first_seen(read):
    return instruments(read).groupBy("instrument").agg(F.min_by("mission", "instrument_id").alias("mission"), F.min("instrument_id").alias("instrument_id"))


@query(
    """, ring AS (SELECT paper_id, lead(paper_id) OVER (PARTITION BY author_id ORDER BY paper_id) AS nx, lag(paper_id) OVER (PARTITION BY author_id ORDER BY paper_id) AS pv,
      min(paper_id) OVER (PARTITION BY author_id) AS lo, max(paper_id) OVER (PARTITION BY author_id) AS hi FROM papers)
    SELECT paper_id, coalesce(nx, lo) AS next_paper, coalesce(pv, hi) AS previous_paper FROM ring""",
    "papers",
)
def w4_next_with_wrap(read):
    own = Window.partitionBy("author_id")
    by = own.orderBy("paper_id")
    return papers(read).select("paper_id", F.coalesce(F.lead("paper_id").over(by), F.min("paper_id").over(own)).alias("next_paper"), F.coalesce(F.lag("paper_id").over(by), F.max("paper_id").over(own)).alias("previous_paper"))


@query(
    """, n AS (SELECT instrument, count(*) AS n FROM instruments GROUP BY 1), r AS (SELECT instrument, instrument_id, row_number() OVER (PARTITION BY instrument ORDER BY instrument_id) - 1 AS place FROM instruments)
    SELECT r.instrument, instrument_id FROM r JOIN n USING (instrument) WHERE place IN (n.n * 0 // 5, n.n // 5, n.n * 2 // 5, n.n * 3 // 5, n.n * 4 // 5) OR n.n <= 5""",
    "instruments",
)
def w5_even_pick(read):
    """Five evenly spaced instruments of each name: places ``floor(i n / 5)`` in order of id. A name with fewer gives all."""
    own = Window.partitionBy("instrument")
    placed = instruments(read).select("instrument", "instrument_id", (F.row_number().over(own.orderBy("instrument_id")) - 1).alias("at"), F.count("*").over(own).alias("n"))
    wanted = F.array(*(F.floor(F.lit(i) * F.col("n") / 5) for i in range(5)))
    return placed.where((F.col("n") <= 5) | F.array_contains(wanted, F.col("at").cast("long"))).select("instrument", "instrument_id")


@query(
    """, h AS (SELECT date_trunc('hour', created_at) AS hour, count(*) FILTER (call_type = 'purchase') AS n FROM calls GROUP BY 1)
    SELECT hour, n FROM (SELECT hour, n, lag(n) OVER (ORDER BY hour) AS before FROM h) WHERE n = before""",
    "calls",
)
def w6_stalls(read):
    """Hours whose count is that of the hour before. The window spans one row an hour, not the calls."""
    per = calls(read).groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count_if(F.col("call_type") == "purchase").alias("n"))
    return per.withColumn("before", F.lag("n").over(Window.orderBy("hour"))).where("n = before").select("hour", "n")


@query(
    """SELECT item_id, (row_number() OVER (ORDER BY md5('7:' || item_id)) - 1) % 3 AS reviewer FROM (SELECT DISTINCT item_id FROM votes)""",
    "votes",
)
def w7_round_robin(read):
    items = votes(read).select("item_id").distinct()
    return sampling.places(items, "item_id", seed=7).select("item_id", (F.col("place") % 3).alias("reviewer"))


@query(
    """SELECT datasource, observatory, instrument, win_start, win_end, paper_id FROM usages JOIN instruments USING (instrument_id) JOIN observatories USING (observatory_id)
    ORDER BY ALL""",
    "usages",
    "instruments",
    "observatories",
)
def o1_multi_key_sort(read):
    star = usages(read).join(instruments(read), "instrument_id").join(observatories(read), "observatory_id")
    keys = ["datasource", "observatory", "instrument", "win_start", "win_end", "paper_id"]
    return star.select(keys).orderBy(keys)


@query(
    """SELECT instrument_id, kind, CASE kind WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 99 END AS rank FROM instruments ORDER BY rank, instrument_id LIMIT 50""",
    "instruments",
)
def o2_custom_rank(read):
    rank = F.when(F.col("kind") == "ECONOMY", 0).when(F.col("kind") == "STANDARD", 1).otherwise(99)
    return instruments(read).select("instrument_id", "kind", rank.alias("rank")).orderBy("rank", "instrument_id").limit(50)


@query("SELECT paper_id, size FROM papers ORDER BY size DESC NULLS FIRST, paper_id LIMIT 25 OFFSET 50", "papers")
def o4_page(read):
    return papers(read).select("paper_id", "size").orderBy(F.desc_nulls_first("size"), "paper_id").offset(50).limit(25)


@query(
    """SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), 6) AS distance FROM embeddings WHERE vec_id <> 7 ORDER BY distance, vec_id LIMIT 10""",
)
def o5_vector_top_k(read):
    e = read("embeddings")
    wanted = e.where("vec_id = 7").select(F.col("embedding").alias("wanted")).limit(1)
    near = e.where("vec_id <> 7").join(F.broadcast(wanted)).select("vec_id", F.round(1 - s.cosine(F.col("embedding"), F.col("wanted")), 6).alias("distance"))
    return near.where("distance is not null").orderBy("distance", "vec_id").limit(10)


@query("SELECT paper_id, tag FROM papers ORDER BY md5('42:' || paper_id) LIMIT 100", "papers")
def o6_seeded_sample(read):
    return sampling.sample_n(papers(read), "paper_id", 100).select("paper_id", "tag")


@query(
    """SELECT doc_id FROM documents WHERE length(text) > 200 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY md5('42:' || doc_id), doc_id LIMIT 50""",
)
def o7_substantive_sample(read):
    left = read("documents").where(F.char_length("text") > 200).join(read("labels").where("toxic = 1"), "doc_id", "left_anti")
    return sampling.sample_n(left, "doc_id", 50).select("doc_id")


@query(
    """, urgent AS (SELECT paper_id FROM papers WHERE tag = '1-URGENT' ORDER BY md5('42:' || paper_id) LIMIT 40),
    finished AS (SELECT paper_id FROM papers WHERE state = 'F' AND paper_id NOT IN (SELECT * FROM urgent) ORDER BY md5('42:' || paper_id) LIMIT 40),
    rest AS (SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT * FROM urgent UNION ALL SELECT * FROM finished) ORDER BY md5('42:' || paper_id) LIMIT 20)
    SELECT paper_id, 'urgent' AS stratum FROM urgent UNION ALL SELECT paper_id, 'finished' FROM finished UNION ALL SELECT paper_id, 'rest' FROM rest""",
    "papers",
)
def o8_sequential_strata(read):
    strata = [("urgent", F.col("tag") == "1-URGENT", 40), ("finished", F.col("state") == "F", 40), ("rest", F.lit(True), 20)]
    return sampling.stratified(papers(read).select("paper_id", "tag", "state"), "paper_id", strata).select("paper_id", "stratum")


@query(
    """SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT * FROM (SELECT doc_id, toxic FROM labels WHERE toxic <> 1 ORDER BY md5('42:' || doc_id) LIMIT (SELECT 2 * count(*) FROM labels WHERE toxic = 1))""",
)
def o9_class_ratio(read):
    return sampling.downsample(read("labels").select("doc_id", "toxic"), "doc_id", F.col("toxic") == 1)


@query("SELECT paper_id, count(*) FILTER (status = 'approved') AS approved FROM usages GROUP BY 1 ORDER BY approved DESC, paper_id LIMIT 30", "usages")
def o10_validated_first(read):
    return usages(read).groupBy("paper_id").agg(F.count_if(F.col("status") == "approved").alias("approved")).orderBy(F.desc("approved"), "paper_id").limit(30)


@query("SELECT DISTINCT source, lang FROM documents")
def u1_distinct(read):
    return read("documents").select("source", "lang").distinct()


@query(
    """, f AS (SELECT DISTINCT instrument_id FROM usages WHERE configuration = 'F'), o AS (SELECT DISTINCT instrument_id FROM usages WHERE configuration = 'O')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL SELECT 'only_f', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM o)
    UNION ALL SELECT 'only_o', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM f) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM f UNION SELECT * FROM o)""",
    "usages",
)
def u3_set_parts(read):
    """All four parts from one pass: each instrument says in which configurations it occurs."""
    seen = usages(read).groupBy("instrument_id").agg(F.bool_or(F.col("configuration") == "F").alias("f"), F.bool_or(F.col("configuration") == "O").alias("o"))
    parts = {"both": F.col("f") & F.col("o"), "only_f": F.col("f") & ~F.col("o"), "only_o": F.col("o") & ~F.col("f"), "either": F.col("f") | F.col("o")}
    counted = seen.agg(*(F.count_if(c).alias(k) for k, c in parts.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(k).alias("n")) for k in parts))).alias("x")).select("x.*")


@query(
    """SELECT substr(sha1(paper_id || '|' || instrument_id || '|' || strftime(win_start, '%Y-%m-%d') || '|' || strftime(win_end, '%Y-%m-%d')), 1, 12) AS claim, string_agg(DISTINCT configuration, ',' ORDER BY configuration) AS configurations FROM usages GROUP BY 1""",
    "usages",
)
def u5_claim_union(read):
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    claim = short_id(F.col("paper_id").cast("string"), F.col("instrument_id").cast("string"), date("win_start"), date("win_end"))
    return usages(read).groupBy(claim.alias("claim")).agg(F.array_join(F.sort_array(F.collect_set("configuration")), ",").alias("configurations"))


@query("SELECT DISTINCT unnest(string_split(instrument, ' ')) AS tag FROM instruments ORDER BY tag", "instruments")
def u6_tags(read):
    return instruments(read).select("instrument").distinct().select(F.explode(F.split("instrument", " ")).alias("tag")).distinct().orderBy("tag")


@query(
    """WITH m AS (SELECT place, avg(x) AS x FROM (SELECT generate_subscripts(embedding, 1) AS place, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE label = 3) GROUP BY 1),
    v AS (SELECT list(x ORDER BY place) AS v FROM m), near AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, v WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 200),
    best AS (SELECT label, max(score) AS score FROM near GROUP BY 1) SELECT label, round(score, 3) AS score FROM best ORDER BY best.score DESC, label LIMIT 10""",
)
def c4_similar_papers(read):
    """Mean vector of a paper's quotes, the 200 nearest quotes of others, the best of each paper, ten papers.

    The mean is made element by element, so what is broadcast is one vector whatever the table's size.
    """
    e = read("embeddings")
    mean = e.where("label = 3").select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    wanted = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("wanted"))
    scored = e.where("label <> 3").join(F.broadcast(wanted)).select("vec_id", "label", F.round(s.cosine(F.col("embedding"), F.col("wanted")), 6).alias("score"))
    near = scored.where("score is not null").orderBy(F.desc("score"), "vec_id").limit(200)
    return near.groupBy("label").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "label").limit(10).select("label", F.round("best", 3).alias("score"))


@query(
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def x1_cosine(read):
    e = read("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(s.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query(
    """, sets AS (SELECT paper_id, list(DISTINCT instrument_id) FILTER (status = 'approved') AS a, list(DISTINCT instrument_id) FILTER (status = 'rejected') AS b FROM usages GROUP BY 1)
    SELECT paper_id, a IS NULL AND b IS NULL AS both_empty, round(CASE WHEN a IS NULL AND b IS NULL THEN 1.0 ELSE len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::DOUBLE END, 6) AS jaccard FROM sets""",
    "usages",
)
def x7_jaccard_both_empty(read):
    """Two empty sets are equal; papers of which both are empty are marked."""
    return _status_jaccard(usages(read), "both_empty")


@query(
    """, sets AS (SELECT paper_id, list(DISTINCT instrument_id) FILTER (status = 'approved') AS a, list(DISTINCT instrument_id) FILTER (status = 'rejected') AS b FROM usages GROUP BY 1)
    SELECT paper_id, round(CASE WHEN a IS NULL AND b IS NULL THEN 1.0 ELSE len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::DOUBLE END, 6) AS jaccard FROM sets""",
    "usages",
)
def x7_jaccard_every_paper(read):
    return _status_jaccard(usages(read))


def _status_jaccard(rows, *more):
    of = lambda k: F.collect_set(F.when(F.col("status") == k, F.col("instrument_id")))
    sets = rows.groupBy("paper_id").agg(of("approved").alias("a"), of("rejected").alias("b")).withColumn("both_empty", F.size(F.concat("a", "b")) == 0)
    return sets.select("paper_id", *more, F.round(s.set_metrics(F.col("a"), F.col("b"), both_empty=1.0)["jaccard"], 6).alias("jaccard"))


@query(
    """, v AS (SELECT paper_id, observatory_id % 2 AS run, CAST(l_linenumber AS DOUBLE) + (observatory_id % 3) * 0.0005 AS x FROM (SELECT l_orderkey AS paper_id, l_suppkey AS observatory_id, l_linenumber FROM lineitem)),
    x AS (SELECT paper_id, coalesce(list(x ORDER BY x) FILTER (run = 0), []) AS a, coalesce(list(x ORDER BY x) FILTER (run = 1), []) AS b FROM v GROUP BY 1)
    SELECT len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]) >= 0.001)) = 0 AS agree, count(*) AS papers FROM x GROUP BY 1""",
    "usages",
)
def x8_tolerant_equality(read):
    """Line numbers as values, some off by 0.0005 or 0.001; papers that one run has no value of agree only if the other has none."""
    of = lambda k: F.array_compact(F.array_agg(F.when(F.col("l_suppkey") % 2 == k, F.col("l_linenumber").cast("double") + (F.col("l_suppkey") % 3) * 0.0005)))
    x = read("lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(of(0).alias("a"), of(1).alias("b"))
    return x.groupBy(s.same_within(F.col("a"), F.col("b")).alias("agree")).agg(F.count("*").alias("papers"))

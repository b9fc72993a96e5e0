"""Aggregations: counts, rollups, series, intervals, set overlap between configurations, agreement, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.functions import predicates as p
from litquarry.functions import statistics as s
from litquarry.operators import agreement
from litquarry.plans.registry import query
from litquarry.sources.roles import Reader, calls, instruments, observatories, papers, usages, votes

#: The statuses of a usage.
STATUSES = ["approved", "rejected", "needs_review", "pending"]
day = lambda text: F.lit(text).cast("timestamp")


def money(c: str | Column) -> Column:
    """Sums of money are exact: two decimals, whatever the order of addition."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"))


@query("SELECT mission, count(*) AS n, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM usages JOIN instruments USING (instrument_id) GROUP BY 1", "usages", "instruments")
def a1_conditional_counts(read):
    st = F.col("status")
    return usages(read).join(instruments(read), "instrument_id").groupBy("mission").agg(F.count("*").alias("n"), F.count_if(st == "approved").alias("approved"), F.count_if(st == "rejected").alias("rejected"))


@query(
    """SELECT datasource, count(DISTINCT paper_id) AS papers, count(DISTINCT paper_id) FILTER (status = 'approved') AS approved_papers FROM usages JOIN observatories USING (observatory_id) GROUP BY 1""",
    "usages",
    "observatories",
)
def a2_distinct_conditional(read):
    """Two steps instead of two distinct counts: one row a paper first, so no row is expanded."""
    once = usages(read).join(observatories(read), "observatory_id").groupBy("datasource", "paper_id").agg(F.bool_or(F.col("status") == "approved").alias("ok"))
    return once.groupBy("datasource").agg(F.count("*").alias("papers"), F.count_if("ok").alias("approved_papers"))


ROLLUP = """rollup AS (SELECT p.paper_id, coalesce(validated, 0) AS validated_count, coalesce(total, 0) AS total_count, validated_end, open_end FROM papers p LEFT JOIN
  (SELECT paper_id, count(*) FILTER (status = 'approved') AS validated, count(*) FILTER (status IN ('approved', 'pending')) AS total,
   max(win_end) FILTER (status = 'approved') AS validated_end, max(win_end) FILTER (status IN ('approved', 'pending')) AS open_end FROM usages GROUP BY 1) USING (paper_id))"""


def rollup_columns() -> list[Column]:
    """Counts and latest window ends of approved usages, and of those still open too."""
    ok, still = F.col("status") == "approved", F.col("status").isin("approved", "pending")
    return [F.count_if(ok).alias("validated_count"), F.count_if(still).alias("total_count"), F.max(F.when(ok, F.col("win_end"))).alias("validated_end"), F.max(F.when(still, F.col("win_end"))).alias("open_end")]


def paper_rollup(read: Reader) -> DataFrame:
    """The rollup of each paper; papers without any usage have 0."""
    per = usages(read).groupBy("paper_id").agg(*rollup_columns())
    return papers(read).select("paper_id").join(per, "paper_id", "left").fillna(0, ["validated_count", "total_count"])


@query(f", {ROLLUP} SELECT * FROM rollup", "papers", "usages")
def a3_paper_rollup(read):
    return paper_rollup(read)


@query("SELECT instrument, count(*) AS n FROM usages JOIN instruments USING (instrument_id) GROUP BY 1 ORDER BY n DESC, instrument LIMIT 10", "usages", "instruments")
def a4_top_instruments(read):
    per = usages(read).groupBy("instrument_id").agg(F.count("*").alias("k")).join(instruments(read), "instrument_id")
    return per.groupBy("instrument").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "instrument").limit(10)


@query("SELECT mission, status, count(*) AS n, count(DISTINCT paper_id) AS papers FROM usages JOIN instruments USING (instrument_id) GROUP BY 1, 2", "usages", "instruments")
def a5_distinct_and_total(read):
    return usages(read).join(instruments(read), "instrument_id").groupBy("mission", "status").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"))


@query("SELECT paper_id, count(*) AS total FROM usages GROUP BY 1 HAVING count(*) > 2 AND count(*) FILTER (status IN ('approved', 'rejected')) = count(*)", "usages")
def a6_having(read):
    per = usages(read).groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("approved", "rejected")).alias("done"))
    return per.where("total > 2 and done = total").select("paper_id", "total")


@query("SELECT instrument_id, min(win_start) AS first_start, max(win_end) AS last_end FROM usages GROUP BY 1", "usages")
def a7_range_bounds(read):
    return usages(read).groupBy("instrument_id").agg(F.min("win_start").alias("first_start"), F.max("win_end").alias("last_end"))


@query(
    """SELECT observatory_id, count(DISTINCT paper_id) AS papers FROM (SELECT observatory_id, paper_id FROM usages WHERE status = 'approved'
    UNION SELECT observatory_id, paper_id FROM usages WHERE instrument_id % 7 = 0) GROUP BY 1""",
    "usages",
)
def a8_union_papers(read):
    use = usages(read)
    some = lambda c: use.where(c).select("observatory_id", "paper_id")
    return some("status = 'approved'").union(some("instrument_id % 7 = 0")).distinct().groupBy("observatory_id").agg(F.count("*").alias("papers"))


@query(
    """SELECT configuration, count(*) AS fully_validated FROM (SELECT paper_id, configuration FROM usages GROUP BY 1, 2
    HAVING bool_and(status IN ('approved', 'rejected')) AND bool_or(observatory_id % 5 = 1)) GROUP BY 1""",
    "usages",
)
def a9_fully_validated(read):
    per = usages(read).groupBy("paper_id", "configuration").agg(F.bool_and(F.col("status").isin("approved", "rejected")).alias("all_done"), F.bool_or(F.col("observatory_id") % 5 == 1).alias("by_user"))
    return per.where("all_done and by_user").groupBy("configuration").agg(F.count("*").alias("fully_validated"))


@query(
    """, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-14', INTERVAL 1 DAY)) AS DATE) AS called_on)
    SELECT CAST(called_on AS VARCHAR) AS called_on, coalesce(n, 0) AS n FROM d LEFT JOIN (SELECT CAST(created_at AS DATE) AS called_on, count(*) AS n FROM calls WHERE call_type = 'error' GROUP BY 1) USING (called_on)""",
    "calls",
)
def a10_daily_series(read):
    """Calls a day, with days of none, up to ``as_of`` (14 February 2024) and 44 days back."""
    per = calls(read).where("call_type = 'error'").groupBy(F.to_date("created_at").alias("called_on")).agg(F.count("*").alias("n"))
    days = per.sparkSession.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-14')")).alias("called_on"))
    return days.join(per, "called_on", "left").fillna(0, ["n"]).withColumn("called_on", F.col("called_on").cast("string"))


@query(
    """, d AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS covered_on)
    SELECT covered_on, count(*) FILTER (datasource = 'ASIA') AS asia, count(*) FILTER (datasource = 'EUROPE') AS europe
    FROM d JOIN usages ON date_trunc('day', win_start) <= covered_on AND date_trunc('day', win_end) >= covered_on JOIN observatories USING (observatory_id) GROUP BY 1""",
    "usages",
    "observatories",
)
def a11_day_matrix(read):
    """Usages that cover each day, by data source: +1 on the first day, -1 after the last, summed up over a calendar.

    Steps are summed per day before the running sum, so the one window holds as many rows as there are days.
    """
    use = usages(read).join(observatories(read), "observatory_id").where(F.col("datasource").isin("ASIA", "EUROPE"))
    first, last = F.date_trunc("day", "win_start"), F.date_trunc("day", "win_end") + F.expr("interval 1 day")
    step = use.select("datasource", F.explode(F.array(F.struct(first.alias("on"), F.lit(1).alias("by")), F.struct(last.alias("on"), F.lit(-1).alias("by")))).alias("x"))
    begin, end = day("1996-01-01"), day("1996-12-31")
    per_day = step.select("datasource", F.greatest(F.col("x.on"), begin).alias("covered_on"), "x.by").where(F.col("covered_on") <= end).groupBy("covered_on").pivot("datasource", ["ASIA", "EUROPE"]).agg(F.sum("by"))
    calendar = use.sparkSession.range(1).select(F.explode(F.sequence(begin, end, F.expr("interval 1 day"))).alias("covered_on"))
    so_far = Window.orderBy("covered_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = calendar.join(per_day, "covered_on", "left").fillna(0, ["ASIA", "EUROPE"])
    return filled.select("covered_on", F.sum("ASIA").over(so_far).alias("asia"), F.sum("EUROPE").over(so_far).alias("europe"))


@query(
    """, per AS (SELECT mission, count(*) FILTER (status = 'approved') AS k, count(*) FILTER (status IN ('approved', 'rejected')) AS n FROM usages JOIN instruments USING (instrument_id) GROUP BY 1),
    w AS (SELECT mission, k, n, k / n::DOUBLE AS pr, 1.96 * 1.96 AS zz FROM per)
    SELECT mission, n, round(pr, 4) AS precision, round(greatest(0, ((pr + zz / (2 * n)) - 1.96 * sqrt(pr * (1 - pr) / n + zz / (4 * n * n))) / (1 + zz / n)), 4) AS lower,
    round(least(1, ((pr + zz / (2 * n)) + 1.96 * sqrt(pr * (1 - pr) / n + zz / (4 * n * n))) / (1 + zz / n)), 4) AS upper FROM w""",
    "usages",
    "instruments",
)
def a12_precision_interval(read):
    st = F.col("status")
    per = usages(read).join(instruments(read), "instrument_id").groupBy("mission").agg(F.count_if(st == "approved").alias("k"), F.count_if(st.isin("approved", "rejected")).alias("n"))
    lower, upper = s.wilson(F.col("k"), F.col("n"))
    return per.select("mission", "n", F.round(s.share(F.col("k"), F.col("n")), 4).alias("precision"), F.round(lower, 4).alias("lower"), F.round(upper, 4).alias("upper"))


STAGE = """CASE call_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'extract' WHEN 'error' THEN 'validate' ELSE 'normalize' END"""


def stage(call_type: Column) -> Column:
    return F.when(call_type.isin("click", "view"), "extract").when(call_type == "error", "validate").otherwise("normalize")


@query(
    f""", c AS (SELECT *, CAST(cost AS DECIMAL(18,2)) AS m FROM calls)
    SELECT call_type, {STAGE} AS stage, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(m) AS DOUBLE) AS cost,
    round(100 * CAST(sum(m) AS DOUBLE) / (SELECT CAST(sum(m) AS DOUBLE) FROM c), 4) AS pct FROM c GROUP BY call_type""",
    "calls",
)
def a13_cost_by_type(read):
    per = calls(read).groupBy("call_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), money("cost").cast("double").alias("cost"))
    total = F.sum(F.col("cost").cast("decimal(18,2)")).over(Window.partitionBy()).cast("double")
    return per.select("call_type", stage(F.col("call_type")).alias("stage"), "n", "tokens", "cost", F.round(100 * F.col("cost") / total, 4).alias("pct"))


@query("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS called_on, model % 10 AS model, count(*) AS n, CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM calls GROUP BY ALL", "calls")
def a13_cost_by_day_and_model(read):
    return calls(read).groupBy(F.to_date("created_at").cast("string").alias("called_on"), (F.col("model") % 10).alias("model")).agg(F.count("*").alias("n"), money("cost").cast("double").alias("cost"))


@query("SELECT configuration, min(n) AS fewest, max(n) AS most, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean FROM (SELECT configuration, paper_id, count(*) AS n FROM usages GROUP BY 1, 2) GROUP BY 1", "usages")
def a14_two_levels(read):
    per = usages(read).groupBy("configuration", "paper_id").agg(F.count("*").alias("n"))
    return per.groupBy("configuration").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query(
    """, e AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS call_type) SELECT call_type, count(call_id) AS n FROM e LEFT JOIN calls USING (call_type) GROUP BY 1""",
    "calls",
)
def a15_enum_counts(read):
    per = calls(read).groupBy("call_type").agg(F.count("*").alias("n"))
    every = per.sparkSession.createDataFrame([(x,) for x in ("click", "error", "purchase", "refund", "signup", "view")], "call_type string")
    return every.join(per, "call_type", "left").fillna(0, ["n"])


OVERLAP = """per AS (SELECT paper_id, count(*) FILTER (f) AS a, count(*) FILTER (o) AS b, count(*) FILTER (f AND o) AS common, count(*) AS u FROM
  (SELECT paper_id, observatory_id, bool_or(configuration = 'F') AS f, bool_or(configuration = 'O') AS o FROM usages GROUP BY 1, 2) GROUP BY 1),
  metric AS (SELECT paper_id, common / a::DOUBLE AS precision, common / b::DOUBLE AS recall, CASE WHEN common > 0 THEN 2.0::DOUBLE * common / (a + b) ELSE 0 END AS f1, common / u::DOUBLE AS jaccard FROM per WHERE a > 0 AND b > 0)"""


def configuration_overlap(read: Reader) -> DataFrame:
    """Observatory sets of the two configurations of each paper that has both."""
    flags = usages(read).groupBy("paper_id", "observatory_id").agg(*(F.max(F.col("configuration") == k).alias(n) for n, k in (("f", "F"), ("o", "O"))))
    sizes = flags.groupBy("paper_id").agg(F.count_if("f").alias("a"), F.count_if("o").alias("b"), F.count_if(F.col("f") & F.col("o")).alias("common")).where("a > 0 and b > 0")
    return sizes.select("paper_id", *(c.alias(n) for n, c in s.count_metrics(F.col("a"), F.col("b"), F.col("common")).items()))


@query(f", {OVERLAP} SELECT paper_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard FROM metric", "usages")
def a16_set_overlap(read):
    metric = configuration_overlap(read)
    return metric.select("paper_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "jaccard")))


@query(
    f", {OVERLAP} SELECT count(*) AS papers, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1, round(coalesce(stddev_samp(f1), 0), 6) AS stdev_f1, round(min(jaccard), 6) AS least, round(max(jaccard), 6) AS most FROM metric",
    "usages",
)
def a17_metric_summary(read):
    return configuration_overlap(read).agg(
        F.count("*").alias("papers"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.median("f1"), 6).alias("median_f1"), F.round(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)), 6).alias("stdev_f1"), F.round(F.min("jaccard"), 6).alias("least"), F.round(F.max("jaccard"), 6).alias("most")
    )


@query(
    f""", {OVERLAP}, bins AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin) SELECT bin, count(paper_id) AS n, round(100.0::DOUBLE * count(paper_id) / (SELECT count(*) FROM metric), 4) AS pct
    FROM bins LEFT JOIN metric ON least(CAST(floor(round(jaccard * 5, 9)) AS INT), 4) = bin GROUP BY 1""",
    "usages",
)
def a18_histogram(read):
    per = configuration_overlap(read).groupBy(s.histogram_bin(F.col("jaccard")).alias("bin")).agg(F.count("*").alias("n"))
    bins = per.sparkSession.range(5).select(F.col("id").cast("int").alias("bin"))
    filled = bins.join(per, "bin", "left").fillna(0, ["n"])
    return filled.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query(
    f""", {OVERLAP}, e AS (SELECT unnest(['High', 'Moderate', 'Low']) AS bucket) SELECT bucket, count(paper_id) AS n FROM e LEFT JOIN metric ON bucket = CASE WHEN f1 >= 0.7 THEN 'High' WHEN f1 >= 0.4 THEN 'Moderate' ELSE 'Low' END GROUP BY 1""",
    "usages",
)
def a19_buckets(read):
    bucket = F.when(F.col("f1") >= 0.7, "High").when(F.col("f1") >= 0.4, "Moderate").otherwise("Low")
    per = configuration_overlap(read).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return per.sparkSession.createDataFrame([("High",), ("Moderate",), ("Low",)], "bucket string").join(per, "bucket", "left").fillna(0, ["n"])


@query(
    """, c AS (SELECT DISTINCT paper_id, datasource FROM usages JOIN observatories USING (observatory_id))
    SELECT a.datasource AS first, b.datasource AS second, count(*) AS papers FROM c a JOIN c b ON a.paper_id = b.paper_id AND a.datasource < b.datasource GROUP BY 1, 2 ORDER BY papers DESC, first, second LIMIT 5""",
    "usages",
    "observatories",
)
def a20_common_pairs(read):
    """Pairs are made of each paper's few data sources, as arrays, not by joining its rows."""
    per = usages(read).join(observatories(read), "observatory_id").groupBy("paper_id").agg(F.array_sort(F.collect_set("datasource")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "first", "second").limit(5)


CONSENSUS = """CASE WHEN count(*) FILTER (status = 'approved') >= count(*) // 2 + 1 THEN 'approved' WHEN count(*) FILTER (status = 'rejected') >= count(*) // 2 + 1 THEN 'rejected'
  WHEN count(*) > 0 THEN 'needs_review' ELSE 'pending' END"""


@query(f"SELECT item_id, count(*) AS n_votes, {CONSENSUS} AS consensus FROM votes GROUP BY 1", "votes")
def a21_consensus(read):
    return agreement.consensus(votes(read), "item_id", "status", settled=["approved", "rejected"])


FLEISS = """raters AS (SELECT count(*) AS r FROM votes WHERE item_id = (SELECT min(item_id) FROM votes)), counts AS (SELECT item_id, status, count(*) AS n FROM votes WHERE item_id IN (SELECT item_id FROM votes GROUP BY 1 HAVING count(*) = (SELECT r FROM raters)) GROUP BY 1, 2),
  items AS (SELECT (sum(n * n) - any_value(r)) / (any_value(r) * (any_value(r) - 1))::DOUBLE AS p_i FROM counts, raters GROUP BY item_id),
  shares AS (SELECT sum(n) / (SELECT sum(n) FROM counts)::DOUBLE AS q FROM counts GROUP BY status),
  f AS (SELECT (SELECT avg(p_i) FROM items) AS p_bar, (SELECT sum(q * q) FROM shares) AS p_e, (SELECT count(*) FROM items) AS items)"""


@query(f", {FLEISS} SELECT items, round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round(CASE WHEN p_e = 1 THEN 1 ELSE (p_bar - p_e) / (1 - p_e) END, 6) AS kappa FROM f", "votes")
def a22_fleiss_kappa(read):
    """The first item sets the number of raters; items with another number cannot enter the same kappa."""
    every = votes(read)
    found = agreement.fleiss_kappa(every, "item_id", "status", raters=agreement.first_item_raters(every, "item_id"))
    return found.select("items", *(F.round(c, 6).alias(c) for c in ("p_bar", "p_e", "kappa")))


@query(
    """, pairs AS (SELECT a.rater_id AS ra, b.rater_id AS rb, a.status AS sa, b.status AS sb FROM votes a JOIN votes b ON a.item_id = b.item_id AND a.rater_id < b.rater_id),
    n AS (SELECT ra, rb, count(*) AS shared, count(*) FILTER (sa = sb) / count(*)::DOUBLE AS p_o FROM pairs GROUP BY 1, 2),
    ma AS (SELECT ra, rb, sa AS s, count(*) AS k FROM pairs GROUP BY 1, 2, 3), mb AS (SELECT ra, rb, sb AS s, count(*) AS k FROM pairs GROUP BY 1, 2, 3),
    e AS (SELECT ra, rb, sum(ma.k * mb.k) AS x FROM ma JOIN mb USING (ra, rb, s) GROUP BY 1, 2)
    SELECT ra AS rater_a, rb AS rater_b, shared, round(p_o, 6) AS observed, round((p_o - x / (shared * shared)::DOUBLE) / (1 - x / (shared * shared)::DOUBLE), 6) AS kappa FROM n JOIN e USING (ra, rb)""",
    "votes",
)
def a23_cohen_kappa(read):
    found = agreement.cohen_kappa(votes(read), "item_id", "rater_id", "status")
    return found.select("rater_a", "rater_b", "shared", F.round("observed", 6).alias("observed"), F.round("kappa", 6).alias("kappa"))


@query(
    """, pairs AS (SELECT a.rater_id AS ra, b.rater_id AS rb, a.status AS sa, b.status AS sb FROM votes a JOIN votes b ON a.item_id = b.item_id AND a.rater_id < b.rater_id),
    e AS (SELECT sum(x.k * y.k) AS x FROM (SELECT sa AS s, count(*) AS k FROM pairs GROUP BY 1) x JOIN (SELECT sb AS s, count(*) AS k FROM pairs GROUP BY 1) y USING (s)),
    n AS (SELECT count(*) AS observations, count(*) FILTER (sa = sb) / count(*)::DOUBLE AS p_o FROM pairs)
    SELECT observations, round(p_o, 6) AS observed, round((p_o - x / (observations::DOUBLE * observations)) / (1 - x / (observations::DOUBLE * observations)), 6) AS kappa FROM n, e""",
    "votes",
)
def a25_cross_run_kappa(read):
    found = agreement.cohen_kappa(votes(read), "item_id", "rater_id", "status", pooled=True)
    return found.select(F.col("shared").alias("observations"), F.round("observed", 6).alias("observed"), F.round("kappa", 6).alias("kappa"))


@query(
    """SELECT k, CASE WHEN k < 0 THEN 'poor' WHEN k <= 0.2 THEN 'slight' WHEN k <= 0.4 THEN 'fair' WHEN k <= 0.6 THEN 'moderate' WHEN k <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band
    FROM (SELECT DISTINCT round(l_discount * 12 - 0.2, 2) AS k FROM lineitem)""",
)
def a26_kappa_bands(read):
    return read("lineitem").select(F.round(F.col("l_discount") * 12 - 0.2, 2).alias("k")).distinct().withColumn("band", s.kappa_band(F.col("k")))


MODE = """modes AS (SELECT item_id, sum(n) AS raters, max(n) AS modal, arg_max(status, (n, -seen)) AS answer FROM (SELECT item_id, status, count(*) AS n, min(rater_id) AS seen FROM votes GROUP BY 1, 2) GROUP BY 1)"""
TIER = "CASE WHEN modal = raters THEN 'perfect' WHEN modal = raters - 1 THEN 'all_but_one' WHEN modal = 3 THEN 'three' WHEN modal = 2 THEN 'two' ELSE 'none' END"


@query(f", {MODE} SELECT CAST(raters AS BIGINT) AS raters, {TIER} AS tier, count(*) AS items FROM modes WHERE raters >= 2 GROUP BY ALL", "votes")
def a27_consistency_tiers(read):
    modal, n = F.col("modal"), F.col("raters")
    tier = F.when(modal == n, "perfect").when(modal == n - 1, "all_but_one").when(modal == 3, "three").when(modal == 2, "two").otherwise("none")
    return agreement.modal_answers(votes(read), "item_id", "status", "rater_id").where(n >= 2).groupBy("raters", tier.alias("tier")).agg(F.count("*").alias("items"))


@query(
    """, sets AS (SELECT paper_id, observatory_id % 4 AS run, list(DISTINCT instrument_id % 50) AS v FROM usages GROUP BY 1, 2)
    SELECT a.run AS run_a, b.run AS run_b, count(*) AS pairs, round(avg(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v)))::DOUBLE), 6) AS mean_jaccard
    FROM sets a JOIN sets b ON a.paper_id = b.paper_id AND a.run < b.run GROUP BY 1, 2""",
    "usages",
)
def a28_pairwise_jaccard(read):
    """A paper has at most four runs, each one row by then, so that joining them by paper makes at most six pairs of it."""
    per = usages(read).groupBy("paper_id", (F.col("observatory_id") % 4).alias("run")).agg(F.collect_set(F.col("instrument_id") % 50).alias("v"))
    a, b = (per.select("paper_id", F.col("run").alias(f"run_{x}"), F.col("v").alias(x)) for x in "ab")
    met = a.join(b, "paper_id").where("run_a < run_b").withColumn("j", s.set_metrics(F.col("a"), F.col("b"), both_empty=1.0)["jaccard"])
    return met.groupBy("run_a", "run_b").agg(F.count("*").alias("pairs"), F.round(F.avg("j"), 6).alias("mean_jaccard"))


@query(f", {MODE} SELECT item_id, answer, modal FROM modes", "votes")
def a29_modal_answer(read):
    """The answer that most raters gave; of equally frequent ones that of the first rater."""
    return agreement.modal_answers(votes(read), "item_id", "status", "rater_id").select("item_id", "answer", "modal")


@query(
    """, b AS (SELECT call_type, cost, md5('42|' || call_id || '|' || unnest(range(20))) AS h, unnest(range(20)) AS b FROM calls WHERE cost IS NOT NULL),
    v AS (SELECT call_type, cost, b * 10 + k AS r, CAST('0x' || substr(h, CAST(3 * k + 1 AS INT), 3) AS INT) AS v FROM b, (SELECT unnest(range(10)) AS k)),
    w AS (SELECT call_type, cost, r, CASE WHEN v < 1507 THEN 0 WHEN v < 3014 THEN 1 WHEN v < 3767 THEN 2 WHEN v < 4018 THEN 3 WHEN v < 4081 THEN 4 WHEN v < 4094 THEN 5 ELSE 6 END AS w FROM v),
    m AS (SELECT call_type, r, sum(cost * w) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2), q AS (SELECT call_type, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY 1)
    SELECT call_type, n, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (SELECT call_type, count(cost) AS n, avg(cost) AS mean FROM calls GROUP BY 1) JOIN q USING (call_type)""",
    "calls",
)
def a30_bootstrap_interval(read):
    """Percentile interval of the mean call cost by Poisson resampling with draws from md5."""
    found = agreement.bootstrap_mean(calls(read), "call_id", "cost", group="call_type", replicates=200, seed=42)
    return found.select("call_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")))


@query(
    """, g AS (SELECT CASE WHEN tokens < 50 THEN 1000 + call_id % 300 ELSE tokens END AS grp, call_type, count(*) AS n, avg(cost) AS m, stddev_samp(cost) / sqrt(count(*)) AS se FROM calls GROUP BY 1, 2),
    q AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN n <= 10 THEN [12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163][n - 1]
      ELSE 1.959963984540054::DOUBLE + 2.372271230298562 / (n - 1)::DOUBLE + 2.8224986157396112 / (n - 1)::DOUBLE ** 2 + 2.555849679507722 / (n - 1)::DOUBLE ** 3 + 1.5895340533938225 / (n - 1)::DOUBLE ** 4 END AS t FROM g)
    SELECT grp, call_type, n, round(m, 6) AS mean, round(m - t * se, 6) AS lower, round(m + t * se, 6) AS upper FROM q""",
    "calls",
)
def a31_mean_interval(read):
    """Student's interval of the mean cost in groups of few and of many calls; a group of one call has none."""
    group = F.when(F.col("tokens") < 50, 1000 + F.col("call_id") % 300).otherwise(F.col("tokens"))
    half = s.t_quantile(F.count("*") - 1) * F.stddev_samp("cost") / F.sqrt(F.count("*"))
    return calls(read).groupBy(group.alias("grp"), "call_type").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 6).alias("mean"), F.round(F.avg("cost") - half, 6).alias("lower"), F.round(F.avg("cost") + half, 6).alias("upper"))


@query(
    """SELECT call_type, count(*) FILTER (tokens % 3 = 0) AS correct, count(*) FILTER (tokens % 3 = 1) AS incorrect, count(*) FILTER (tokens % 3 = 2) AS error, round(100.0::DOUBLE * count(*) FILTER (tokens % 3 = 0) / count(*), 4) AS accuracy FROM calls GROUP BY 1""",
    "calls",
)
def a32_accuracy(read):
    rest = F.col("tokens") % 3
    return calls(read).groupBy("call_type").agg(F.count_if(rest == 0).alias("correct"), F.count_if(rest == 1).alias("incorrect"), F.count_if(rest == 2).alias("error"), F.round(100.0 * F.count_if(rest == 0) / F.count("*"), 4).alias("accuracy"))


@query(
    """SELECT model % 10 AS judge, count(*) FILTER (call_type = 'click') AS a, count(*) FILTER (call_type = 'view') AS b, count(*) FILTER (call_type = 'signup') AS tie, count(*) FILTER (call_type NOT IN ('click', 'view', 'signup')) AS neither FROM calls GROUP BY 1""",
    "calls",
)
def a33_judge_tally(read):
    kind = F.when(F.col("call_type") == "click", "a").when(F.col("call_type") == "view", "b").when(F.col("call_type") == "signup", "tie").otherwise("neither")
    return calls(read).select((F.col("model") % 10).alias("judge"), kind.alias("kind")).groupBy("judge").pivot("kind", ["a", "b", "tie", "neither"]).count().fillna(0)


@query(
    """SELECT model % 10 AS model, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (call_type <> 'error') / count(*), 4) AS success_rate, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 4) AS mean_tokens FROM calls GROUP BY 1""",
    "calls",
)
def a34_model_summary(read):
    return calls(read).groupBy((F.col("model") % 10).alias("model")).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("call_type") != "error") / F.count("*"), 4).alias("success_rate"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("mean_tokens"))


@query("SELECT role, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum(length(text) // 4) * 0.15 / 1000000 * 0.5, 9) AS cost FROM conversations GROUP BY 1")
def a35_batch_cost(read):
    """A token for four characters, at half the price of 0.15 a million."""
    tokens = F.sum(F.floor(F.char_length("text") / 4))
    return read("conversations").groupBy("role").agg(tokens.alias("tokens"), F.round(tokens * 0.15 / 1000000 * 0.5, 9).alias("cost"))


@query("SELECT paper_id, string_agg(DISTINCT status, ',' ORDER BY status) AS sources FROM usages GROUP BY 1", "usages")
def a36_provenance(read):
    return usages(read).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("status")), ",").alias("sources"))


@query("SELECT instrument, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT channels) AS n_channels FROM instruments GROUP BY 1", "instruments")
def a37_candidate_map(read):
    return instruments(read).groupBy("instrument").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("channels").alias("n_channels"))


@query(
    """SELECT label, place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM
    (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS place, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2""",
)
def a38_vector_mean(read):
    return read("embeddings").select("label", F.posexplode("embedding").alias("place", "x")).groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(
    """SELECT paper_id, CASE WHEN status = 'pending' THEN 'general_comments' ELSE status END AS parameter, count(*) AS n, string_agg(observatory_id::VARCHAR, ',' ORDER BY observatory_id) AS observatories
    FROM usages GROUP BY 1, 2""",
    "usages",
)
def a39_grouped_quotes(read):
    """A paper's quotes of each parameter in one row: a paper has few. a39_quotes_by_paper has them by observatory, without arrays."""
    parameter = F.when(F.col("status") == "pending", "general_comments").otherwise(F.col("status"))
    per = usages(read).groupBy("paper_id", parameter.alias("parameter")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("observatory_id")).alias("of"))
    return per.select("paper_id", "parameter", "n", F.array_join(F.transform("of", lambda x: x.cast("string")), ",").alias("observatories"))


@query(
    """SELECT observatory_id, CASE WHEN status = 'pending' THEN 'general_comments' ELSE status END AS parameter, paper_id, count(*) AS n FROM usages GROUP BY 1, 2, 3""",
    "usages",
)
def a39_quotes_by_paper(read):
    """One row a paper in each group: a group's rows are spread, however many it has."""
    parameter = F.when(F.col("status") == "pending", "general_comments").otherwise(F.col("status"))
    return usages(read).groupBy("observatory_id", parameter.alias("parameter"), "paper_id").agg(F.count("*").alias("n"))


# --- compositions ------------------------------------------------------------------------------------------------


@query(
    f""", {ROLLUP}, ok AS (SELECT DISTINCT paper_id FROM usages JOIN instruments USING (instrument_id) JOIN observatories USING (observatory_id)
      WHERE datasource = 'ASIA' AND mission IN ('Brand#3', 'Brand#7') AND status <> 'rejected' AND win_start < TIMESTAMP '1999-01-01' AND win_end >= TIMESTAMP '1996-01-01')
    SELECT p.paper_id, p.tag, validated_count, coalesce(nullif(total_count, 0), validated_count) AS total_count, open_end FROM papers p JOIN rollup USING (paper_id) SEMI JOIN ok USING (paper_id)
    ORDER BY open_end DESC NULLS FIRST, p.paper_id LIMIT 20 OFFSET 20""",
    "papers",
    "usages",
    "instruments",
    "observatories",
)
def c1_paper_listing(read):
    """One pass over usages: each paper's rollup says also whether one of its usages is asked for."""
    clauses = [F.col("_mission"), F.col("_datasource"), F.col("status") != "rejected", p.overlaps(F.col("win_start"), F.col("win_end"), day("1996-01-01"), day("1999-01-01"))]
    missions = instruments(read).where(F.col("mission").isin("Brand#3", "Brand#7")).select("instrument_id", F.lit(True).alias("_mission"))
    asia = observatories(read).where("datasource = 'ASIA'").select("observatory_id", F.lit(True).alias("_datasource"))
    per = usages(read).join(missions, "instrument_id", "left").join(asia, "observatory_id", "left").groupBy("paper_id").agg(F.count_if(p.all_of(clauses)).alias("_asked"), *rollup_columns())
    shown = papers(read).select("paper_id", "tag").join(per.where("_asked > 0"), "paper_id")
    total = F.coalesce(F.nullif("total_count", F.lit(0)), "validated_count")
    return shown.select("paper_id", "tag", "validated_count", total.alias("total_count"), "open_end").orderBy(F.desc_nulls_first("open_end"), "paper_id").offset(20).limit(20)


@query(
    """SELECT datasource, mission, count(*) AS usages, count(DISTINCT paper_id) AS papers, count(DISTINCT instrument) AS instruments, min(win_start) AS first_start, max(win_end) AS last_end
    FROM usages JOIN instruments USING (instrument_id) JOIN observatories USING (observatory_id) WHERE status <> 'rejected' GROUP BY 1, 2""",
    "usages",
    "instruments",
    "observatories",
)
def c3_filter_options(read):
    """Papers are counted after one row a paper and option, instruments from the distinct pairs of keys: no row is taken twice."""
    open_ = usages(read).where("status <> 'rejected'")
    star = lambda rows: rows.join(instruments(read), "instrument_id").join(observatories(read), "observatory_id")
    option = ["datasource", "mission"]
    per = star(open_).groupBy(*option, "paper_id").agg(F.count("*").alias("k"), F.min("win_start").alias("s"), F.max("win_end").alias("e"))
    found = per.groupBy(*option).agg(F.sum("k").alias("usages"), F.count("paper_id").alias("papers"), F.min("s").alias("first_start"), F.max("e").alias("last_end"))
    named = star(open_.select("instrument_id", "observatory_id").distinct()).groupBy(*option).agg(F.countDistinct("instrument").alias("instruments"))
    return found.join(named, option).select(*option, "usages", "papers", "instruments", "first_start", "last_end")


@query(
    """SELECT p.paper_id, p.tag, p.created_at FROM papers p WHERE EXISTS (SELECT 1 FROM usages u JOIN instruments i USING (instrument_id) WHERE u.paper_id = p.paper_id AND i.kind = 'ECONOMY' AND i.channels BETWEEN 10 AND 12
      AND win_start < TIMESTAMP '1998-01-01' AND win_end >= TIMESTAMP '1997-01-01')""",
    "papers",
    "usages",
    "instruments",
)
def c6_parameter_search(read):
    met = usages(read).where(p.overlaps(F.col("win_start"), F.col("win_end"), day("1997-01-01"), day("1998-01-01"))).join(instruments(read).where("kind = 'ECONOMY' and channels between 10 and 12"), "instrument_id")
    return papers(read).join(met.select("paper_id"), "paper_id", "left_semi").select("paper_id", "tag", "created_at")


@query(
    """SELECT instrument, count(*) AS n, count(DISTINCT paper_id) AS papers, round(100.0::DOUBLE * count(*) FILTER (status = 'approved') / count(*), 4) AS approval_rate FROM usages JOIN instruments USING (instrument_id)
    WHERE win_start < TIMESTAMP '1996-12-31 23:59:59.999999' AND win_end >= TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY n DESC, instrument LIMIT 10""",
    "usages",
    "instruments",
)
def c7_usage_stats(read):
    within = p.overlaps(F.col("win_start"), F.col("win_end"), day("1996-01-01"), day("1996-12-31 23:59:59.999999"))
    per = usages(read).where(within).join(instruments(read), "instrument_id").groupBy("instrument")
    return per.agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"), F.round(100.0 * F.count_if(F.col("status") == "approved") / F.count("*"), 4).alias("approval_rate")).orderBy(F.desc("n"), "instrument").limit(10)


@query(
    """SELECT tag, count(DISTINCT paper_id) AS papers, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'needs_review') AS to_review, count(*) FILTER (status IN ('approved', 'rejected')) AS done FROM papers JOIN usages USING (paper_id) GROUP BY 1""",
    "papers",
    "usages",
)
def c8_validation_overview(read):
    st = F.col("status")
    per = usages(read).groupBy("paper_id").agg(F.count_if(st == "pending").alias("pending"), F.count_if(st == "needs_review").alias("to_review"), F.count_if(st.isin("approved", "rejected")).alias("done"))
    return papers(read).join(per, "paper_id").groupBy("tag").agg(F.count("*").alias("papers"), *(F.sum(c).alias(c) for c in ("pending", "to_review", "done")))


@query(
    """SELECT rater_id, count(*) AS votes, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (item_id >= 400) AS recent FROM votes GROUP BY 1""",
    "votes",
)
def c9_rater_stats(read):
    return votes(read).groupBy("rater_id").agg(F.count("*").alias("votes"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("item_id") >= 400).alias("recent"))


@query(
    f""", {OVERLAP}, d AS (SELECT paper_id, a, b, common FROM per) SELECT CASE WHEN a = 0 OR b = 0 THEN 'EMPTY' WHEN a = b AND common = a THEN 'PERFECT' WHEN greatest(a, b) > 2 * least(a, b) THEN 'MUCH_MORE' ELSE 'PARTIAL' END AS kind, count(*) AS papers FROM d GROUP BY 1""",
    "usages",
)
def u4_difference_kinds(read):
    seen = usages(read).groupBy("paper_id", "observatory_id").agg(F.bool_or(F.col("configuration") == "F").alias("f"), F.bool_or(F.col("configuration") == "O").alias("o"))
    per = seen.groupBy("paper_id").agg(F.count_if("f").alias("a"), F.count_if("o").alias("b"), F.count_if(F.col("f") & F.col("o")).alias("both"))
    kind = F.when((F.col("a") == 0) | (F.col("b") == 0), "EMPTY").when((F.col("a") == F.col("b")) & (F.col("both") == F.col("a")), "PERFECT").when(F.greatest("a", "b") > 2 * F.least("a", "b"), "MUCH_MORE").otherwise("PARTIAL")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("papers"))

"""State, materialization, archive validation and maintenance over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.plans.registry import query
from litquarry.sources import files
from litquarry.sources.files import scratch
from litquarry.sources.roles import calls, instruments, observatories, papers, usages, votes
from litquarry.streaming import flows, state


@query(
    """, old AS (SELECT DISTINCT ON (instrument_id) instrument_id, paper_id FROM usages WHERE configuration = 'F' AND paper_id % 3 = 0 ORDER BY instrument_id, paper_id),
    new AS (SELECT instrument_id, min(paper_id) AS paper_id FROM usages WHERE configuration = 'O' GROUP BY 1)
    SELECT * FROM old UNION ALL SELECT * FROM new WHERE instrument_id NOT IN (SELECT instrument_id FROM old)""",
    "usages",
)
def t1_idempotent_upsert(read):
    """What a third of the papers has in one configuration stays; instruments that only the other configuration has come new."""
    use = usages(read)
    old = use.where("configuration = 'F' and paper_id % 3 = 0").groupBy("instrument_id").agg(F.min("paper_id").alias("paper_id"))
    return state.upsert_new(old, use.where("configuration = 'O'").select("instrument_id", "paper_id"), ["instrument_id"], "paper_id")


@query(
    """SELECT model, arg_max(call_type, (created_at, call_id)) AS vote, max(created_at) AS voted_at FROM calls GROUP BY 1""",
    "calls",
)
def t2_vote_upsert(read):
    every = calls(read).select("model", F.col("call_type").alias("vote"), F.col("created_at").alias("voted_at"), "call_id")
    cut = F.lit("2024-01-15").cast("timestamp")
    return state.merge_latest(every.where(F.col("voted_at") < cut), every.where(F.col("voted_at") >= cut), ["model"], "voted_at", "call_id").select("model", "vote", "voted_at")


@query(
    """, t AS (SELECT call_id, call_type = 'purchase' AS done, tokens % 4 AS tried, call_id % 3 = 0 AS missing, call_type = 'click' AS ok, call_type = 'error' AS passing FROM calls)
    SELECT call_id, CASE WHEN done THEN 'resolved' WHEN missing OR passing THEN CASE WHEN tried + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN ok THEN 'resolved' ELSE 'failed' END AS status,
    CAST(tried + CASE WHEN NOT done AND (missing OR passing) THEN 1 ELSE 0 END AS INT) AS attempts FROM t""",
    "calls",
)
def t4_result_application(read):
    every = calls(read)
    tasks = every.select("call_id", F.when(F.col("call_type") == "purchase", "resolved").otherwise("pending").alias("status"), (F.col("tokens") % 4).alias("attempts"))
    results = every.where("call_id % 3 <> 0").select("call_id", (F.col("call_type") == "click").alias("ok"), F.col("call_type").alias("error"))
    return state.apply_results(tasks, results, "call_id", most_attempts=3, transient=F.col("error") == "error")


@query(
    """, t AS (SELECT call_id, CASE call_type WHEN 'click' THEN 'collecting' WHEN 'view' THEN 'committing' ELSE 'done' END AS status, date_trunc('second', created_at) < TIMESTAMP '2024-01-20 23:00:00' AS stale FROM calls)
    SELECT call_id, CASE WHEN stale AND status = 'collecting' THEN 'pending' WHEN stale AND status = 'committing' THEN 'llm_complete' ELSE status END AS status, CAST(stale AND status = 'committing' AS INT) AS attempts FROM t""",
    "calls",
)
def t6_stale_reclaim(read):
    tasks = calls(read).select("call_id", F.when(F.col("call_type") == "click", "collecting").when(F.col("call_type") == "view", "committing").otherwise("done").alias("status"), F.lit(0).alias("attempts"), F.date_trunc("second", "created_at").alias("claimed_at"))
    return state.reclaim_stale(tasks, as_of=F.lit("2024-01-21 00:00:00").cast("timestamp"), seconds=3600).select("call_id", "status", "attempts")


@query(
    """WITH RECURSIVE r AS (SELECT event_type AS call_type, CAST(json_extract_string(props, '$.k') AS INT) + 1 AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
    w AS (SELECT call_type, i, 0::BIGINT AS chunk, size::BIGINT AS bytes, 1 AS held FROM r WHERE i = 1 UNION ALL
      SELECT r.call_type, r.i, CASE WHEN w.bytes + r.size > 2000 OR w.held >= 45 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.bytes + r.size > 2000 OR w.held >= 45 THEN r.size ELSE w.bytes + r.size END, CASE WHEN w.bytes + r.size > 2000 OR w.held >= 45 THEN 1 ELSE w.held + 1 END
      FROM w JOIN r ON r.call_type = w.call_type AND r.i = w.i + 1) SELECT call_type, chunk, count(*) AS n, CAST(max(bytes) AS BIGINT) AS bytes FROM w GROUP BY 1, 2""",
)
def t7_size_chunks(read):
    """Chunks of at most 2000 bytes or 45 calls of a type; each line has a byte more than its tokens."""
    rows = calls(read).select("call_type", "call_id", (F.col("tokens") + 1).cast("long").alias("size"))
    folder = scratch(rows.sparkSession, "chunks")

    def write(table, name):
        table.write.parquet(f"{folder}/{name}")
        return rows.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")

    cut = state.size_chunks(rows, "call_type", "call_id", F.col("size"), most_bytes=2000, most_rows=45, write=write)
    return cut.groupBy("call_type", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    """, v AS (SELECT event_id % 500 AS item, user_id % 5 AS rater, CASE WHEN event_type IN ('purchase', 'signup') THEN 'approved' WHEN event_type = 'error' THEN 'rejected' ELSE 'needs_review' END AS status, ts, event_id FROM events),
    l AS (SELECT item, rater, arg_max(status, (ts, event_id)) AS status FROM v GROUP BY 1, 2), c AS (SELECT item, count(*) AS n_votes, count(*) FILTER (status = 'approved') AS a, count(*) FILTER (status = 'rejected') AS r FROM l GROUP BY 1)
    SELECT item, n_votes, CASE WHEN a >= n_votes // 2 + 1 THEN 'approved' WHEN r >= n_votes // 2 + 1 THEN 'rejected' ELSE 'needs_review' END AS consensus FROM c""".replace(", v AS", "WITH v AS", 1),
)
def t2_streamed_votes(read):
    """Votes as a stream: the newer half first, then the older one, then a third of all again; the last consensus of each item."""
    status = F.when(F.col("event_type").isin("purchase", "signup"), "approved").when(F.col("event_type") == "error", "rejected").otherwise("needs_review")
    every = read("events").select((F.col("event_id") % 500).alias("item"), (F.col("user_id") % 5).alias("rater"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("vote"))
    spark = every.sparkSession
    newer = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    folder = files.scratch(spark, "votes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKS)
    try:
        stream = flows.as_stream(every, f"{folder}/in", newer, ~newer, F.col("vote") % 3 == 0)
        told = flows.drained(flows.voted(stream, settled=["approved", "rejected"]), f"{folder}/out", f"{folder}/checkpoint", mode="update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return told.groupBy("item").agg(F.max_by(F.struct("n_votes", "consensus"), "version").alias("x")).select("item", "x.*")


@query("SELECT call_type, count(*) AS n, sum(tokens) AS tokens FROM calls GROUP BY 1", "calls")
def t12_deduplicated(read):
    """Calls that are delivered twice, as a stream in two files: each counts once."""
    rows = calls(read).select("call_id", "call_type", "tokens", "created_at")
    folder = files.scratch(rows.sparkSession, "deliveries")
    once = flows.deduplicated(flows.as_stream(rows.unionByName(rows.where("call_id % 2 = 0")), f"{folder}/in", F.col("call_id") % 3 == 0, F.col("call_id") % 3 != 0), ["call_id"], time="created_at", late="60 days")
    kept = flows.drained(once, f"{folder}/out", f"{folder}/checkpoint")
    return kept.groupBy("call_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SELECT call_id, CAST(epoch(created_at) AS BIGINT) AS claimed, CAST(epoch(created_at) AS BIGINT) + tokens * 60 AS done FROM (SELECT call_id, date_trunc('second', created_at) AS created_at, tokens FROM calls) WHERE tokens <= 30 AND call_id % 5 <> 0", "calls")
def t12_answered_claims(read):
    """Two streams: claims of calls, and results some minutes later of most of them; those within half an hour meet."""
    rows = calls(read).select("call_id", F.date_trunc("second", "created_at").alias("claimed"), "tokens")
    results = rows.where("call_id % 5 <> 0").select("call_id", (F.col("claimed") + F.make_dt_interval(mins=F.col("tokens"))).alias("done"))
    folder = files.scratch(rows.sparkSession, "claims")
    claims, answers = flows.as_stream(rows.drop("tokens"), f"{folder}/claims"), flows.as_stream(results, f"{folder}/results")
    met = flows.drained(flows.answered_claims(claims, answers, "call_id", claimed="claimed", done="done"), f"{folder}/out", f"{folder}/checkpoint")
    return met.select("call_id", F.unix_seconds("claimed").alias("claimed"), F.unix_seconds("done").alias("done"))


@query("SELECT date_trunc('hour', created_at) AS start, call_type, count(*) AS n FROM calls GROUP BY 1, 2", "calls")
def t12_tumbling(read):
    return state.tumbling_counts(calls(read), time="created_at", by="call_type")


@query(
    """SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, created_at), time_bucket(INTERVAL 3 HOUR, created_at) - INTERVAL 3 HOUR]) AS start FROM calls) GROUP BY 1""",
    "calls",
)
def t12_sliding(read):
    return state.sliding_counts(calls(read), time="created_at")


@query(
    """, g AS (SELECT model, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY model ORDER BY created_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM calls),
    s AS (SELECT model, created_at, sum(new) OVER (PARTITION BY model ORDER BY created_at) AS k FROM g) SELECT min(created_at) AS start, max(created_at) + INTERVAL 30 MINUTE AS end, model, count(*) AS n FROM s GROUP BY model, k""",
    "calls",
)
def t12_sessions(read):
    return state.sessions(calls(read), time="created_at", by="model")


@query(
    """, keep AS (SELECT instrument, mission, min(instrument_id) AS id FROM instruments GROUP BY 1, 2) SELECT DISTINCT paper_id, id AS instrument_id, win_start, win_end FROM usages JOIN instruments USING (instrument_id) JOIN keep USING (instrument, mission)""",
    "usages",
    "instruments",
)
def c25_catalog_dedupe(read):
    every = instruments(read).select("instrument_id", "instrument", "mission")
    keep = every.groupBy("instrument", "mission").agg(F.min("instrument_id").alias("id"))
    return usages(read).join(every.join(keep, ["instrument", "mission"]), "instrument_id").select("paper_id", F.col("id").alias("instrument_id"), "win_start", "win_end").distinct()


@query(
    """SELECT u.paper_id, u.instrument_id, u.observatory_id, u.status FROM usages u WHERE u.status IN ('approved', 'rejected') AND u.paper_id NOT IN (SELECT item_id FROM votes)""",
    "usages",
    "votes",
)
def n1_backfill_votes(read):
    voted = votes(read).select(F.col("item_id").alias("paper_id")).distinct()
    return usages(read).where(F.col("status").isin("approved", "rejected")).join(voted, "paper_id", "left_anti").select("paper_id", "instrument_id", "observatory_id", "status")


@query(
    """SELECT paper_id, coalesce(max(win_end) FILTER (status <> 'pending'), any_value(created_at)) AS completed_at FROM papers LEFT JOIN usages USING (paper_id) GROUP BY 1 HAVING count(*) FILTER (status = 'pending') = 0""",
    "papers",
    "usages",
)
def n3_completion_time(read):
    per = usages(read).groupBy("paper_id").agg(F.max(F.when(F.col("status") != "pending", F.col("win_end"))).alias("done"), F.count_if(F.col("status") == "pending").alias("open"))
    return papers(read).join(per, "paper_id", "left").where("coalesce(open, 0) = 0").select("paper_id", F.coalesce("done", "created_at").alias("completed_at"))


@query(
    """SELECT observatory_id, count(*) AS unsupported FROM usages u WHERE status = 'needs_review' AND NOT EXISTS (SELECT 1 FROM usages s WHERE s.status = 'approved' AND s.observatory_id = u.observatory_id AND s.instrument_id = u.instrument_id) GROUP BY 1""",
    "usages",
)
def n4_unsupported_mentions(read):
    use = usages(read)
    backed = use.where("status = 'approved'").select("observatory_id", "instrument_id")
    return use.where("status = 'needs_review'").join(backed, ["observatory_id", "instrument_id"], "left_anti").groupBy("observatory_id").agg(F.count("*").alias("unsupported"))


@query("""SELECT observatory_id, CASE WHEN contains(observatory, '#') THEN regexp_replace(observatory, '^Supplier#0*', 'Station ') END AS display, country FROM observatories""", "observatories")
def n9_display_names(read):
    return observatories(read).select("observatory_id", F.when(F.col("observatory").contains("#"), F.regexp_replace("observatory", "^Supplier#0*", "Station ")).alias("display"), "country")


@query(
    """, p AS (SELECT model % 5 AS m, call_id % 500 AS item, arg_max(call_type, (created_at, call_id)) AS answer FROM calls GROUP BY 1, 2)
    SELECT a.m AS model_a, b.m AS model_b, count(*) AS shared, round(count(*) FILTER (a.answer = b.answer) / count(*)::DOUBLE, 6) AS agreement FROM p a JOIN p b ON a.item = b.item AND a.m < b.m GROUP BY 1, 2""",
    "calls",
)
def n19_agreement_matrix(read):
    per = calls(read).groupBy((F.col("model") % 5).alias("m"), (F.col("call_id") % 500).alias("item")).agg(F.max_by("call_type", F.struct("created_at", "call_id")).alias("answer"))
    a, b = (per.select("item", F.col("m").alias(f"model_{x}"), F.col("answer").alias(x)) for x in "ab")
    return a.join(b, "item").where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("shared"), F.round(F.count_if(F.col("a") == F.col("b")) / F.count("*"), 6).alias("agreement"))

"""Functions and operators on hand-made rows: nulls, empty texts, ties, golden cases."""

import unicodedata

from pyspark.sql import functions as F

from litquarry.functions import normal, parsers, predicates, statistics, text, times
from litquarry.operators import agreement, joins, sampling
from litquarry.streaming import state


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalize_text(spark):
    said = [("“Café”— x­ \n y",), ("",), (None,), ("ﬁne",)]
    assert values(spark, normal.normalize_text(F.col("x")), said) == ['"' + unicodedata.normalize("NFKD", "Café") + '"- x y', "", None, "fine"]


def test_junk_and_quotes(spark):
    assert values(spark, text.looks_junk(F.col("x")), [("",), (None,), ("a\nb\nc",), ("one good long line of text",), ("  \n the same long line\nthe same long line\n",), ("a line of some length\nb line of some length\nc line of some length\nd line of some length\n",)]) == [True, True, True, True, True, False]
    assert values(spark, text.clean_quote(F.col("x")), [('**"10^{12} cm"**',), ("“x^2 ’",), ("",), (None,)]) == ["1012 cm", "x^2", "", ""]
    assert values(spark, text.percent_encode(F.col("x")), [("a b*~/é",)]) == ["a%20b%2A~%2F%C3%A9"]


def test_parsers(spark):
    assert values(spark, parsers.index_list(F.col("x")), [("(3), (5) of 9",), ("4 and 7",), ("none",), (None,)]) == [[3, 5], [4, 7], None, None]
    assert values(spark, parsers.cadence_list(F.col("x")), [("PT1M, PT5M",), ("none",), (None,)]) == [["PT1M", "PT5M"], None, None]
    assert values(spark, parsers.verdict(F.col("x")), [("FINAL DECISION:\n **Accept**",), ('{"decision": "reject"}',), ("so what",)]) == ["accept", "reject", None]
    assert values(spark, parsers.judge_verdict(F.col("x")), [("VERDICT: A\nverdict: tie",), ("VERDICT: A\nVerdict: B is better",), ("so VERDICT: A",), ("",)]) == ["tie", "error", "error", "error"]
    assert values(spark, parsers.candidate_lines(F.col("x")), [("1. AIA (imager)\n2. HMI (magnetograph)",)]) == [{1: "AIA", 2: "HMI"}]
    found = values(spark, parsers.wavelengths(F.col("x")), [("171, 193 nm",), ("10-20 nm",), ("blue",), (None,)])
    assert [[(round(a * 1e9, 6), round(b * 1e9, 6)) for a, b in w] if w else None for w in found] == [[(171, 171), (193, 193)], [(10, 20)], None, None]
    assert values(spark, parsers.supporting_quote(F.col("x")), [('- **Supporting Quote**: "this one"',), ("Supporting Quote: “curly” x",), ("  - **Supporting Quote**: bare ",), ("*“open",), ("",)]) == ["this one", "curly” x", "bare", "open", None]


def test_times(spark):
    assert values(spark, times.precision_of(F.col("x")), [("2020",), ("2020-01",), ("2020-01-02",), ("2020-01-02T03",), ("2020-01-02T03:04:00Z",), ("2020-01-02T03:04:05Z",)]) == ["year", "month", "day", "hour", "minute", "second"]
    pair = spark.createDataFrame([("day", "second"), ("odd", "day"), (None, "hour")], "a string, b string").select(times.coarser(F.col("a"), F.col("b")))
    assert [r[0] for r in pair.collect()] == ["day", "year", "year"]


def test_predicates_and_statistics(spark):
    tags = [(["a", "b"],), ([],), (None,)]
    assert values(spark, predicates.has_all(F.col("x"), ["a", "b"]), tags, "x array<string>") == [True, False, False]
    assert values(spark, predicates.has_any(F.col("x"), ["b", "c"]), tags, "x array<string>") == [True, False, False]
    found = spark.createDataFrame([(0, 0), (9, 10)], "k int, n int").select(*statistics.wilson(F.col("k"), F.col("n"))).collect()
    assert tuple(found[0]) == (0.0, 0.0) and [round(x, 4) for x in found[1]] == [0.5958, 0.9821]
    both = spark.createDataFrame([([1.0, 2.0], [2.0004, 1.0]), (None, None), ([1.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in both.select(statistics.same_within(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_agreement_known_case(spark):
    told = [(i, r, s) for i, ss in enumerate(["yyy", "yyn", "nnn", "nny"]) for r, s in enumerate(ss)]
    votes = spark.createDataFrame(told, "item int, rater int, status string")
    kappa = agreement.fleiss_kappa(votes, "item", "status", raters=3).first()
    assert (kappa["items"], round(kappa["kappa"], 6)) == (4, round((2 / 3 - 0.5) / 0.5, 6))


def test_overlap_join_meets_each_pair_once(spark):
    use = spark.sql("SELECT 1 AS k, timestamp'2020-01-01' AS win_start, timestamp'2020-12-31' AS win_end UNION ALL SELECT 2, timestamp'2020-01-01', timestamp'2020-01-02'")
    asked = spark.sql("SELECT 1 AS q, timestamp'2020-02-01' AS start, timestamp'2020-11-01' AS end UNION ALL SELECT 2, timestamp'2020-01-02', timestamp'2020-01-02'")
    assert [tuple(r) for r in joins.window_overlap_join(use, asked, keys=[]).select("k", "q").collect()] == [(1, 1)]


def test_strata_are_disjoint_and_stable(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2 == 0).alias("even"))
    take = lambda: [tuple(r) for r in sampling.stratified(rows.repartition(7), "id", [("even", F.col("even"), 10), ("any", F.lit(True), 20)]).select("id", "stratum").orderBy("id").collect()]
    first = take()
    assert first == take() and len({i for i, _ in first}) == len(first) == 30


def test_upsert_is_idempotent_and_replay_ends(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    once = state.upsert_new(old, new, ["k"], "v")
    assert sorted(map(tuple, state.upsert_new(once, new, ["k"], "v").collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")]

    def write(df, k):
        df.write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    answer = lambda asked: asked.select("request", (F.col("request") * 2).alias("answer"))
    then = lambda told: told.where("answer < 20").select(F.col("answer").alias("request"))
    cached = spark.createDataFrame([], "request long, answer long")
    done = state.replay(spark.createDataFrame([(3,)], "request long"), cached, answer, then, write=write)
    assert sorted(r["request"] for r in done.collect()) == [3, 6, 12]


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(id * 600) AS ts, id % 2 AS kind FROM range(40)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = state.tumbling_counts(stream, time="ts", by="kind").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    out.awaitTermination(120)
    batch = state.tumbling_counts(rows, time="ts", by="kind")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))

"""Streams that are stopped and started again give what a batch gives, once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from litquarry.streaming import flows


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def add(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_batch_that_died_before_its_commit_is_written_once(spark, tmp_path, monkeypatch):
    schema, source, sink, checkpoint = "id long, v string", f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/ck"
    add(spark, [(1, "a"), (2, "b"), (1, "a")], schema, source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    commit = flows._commit
    monkeypatch.setattr(flows, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed between write and commit")))
    with pytest.raises(Exception, match="killed between"):
        flows.append_stream(stream(), sink, checkpoint, keys=["id"]).awaitTermination()
    monkeypatch.setattr(flows, "_commit", commit)
    kind = spark.createDataFrame([], schema).schema
    assert flows.committed(spark, sink, kind).count() == 0
    flows.append_stream(stream(), sink, checkpoint, keys=["id"]).awaitTermination()
    add(spark, [(2, "late copy"), (3, "c")], schema, source)
    flows.append_stream(stream(), sink, checkpoint, keys=["id"]).awaitTermination()
    assert sorted(map(tuple, flows.committed(spark, sink, kind).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    # a batch that was committed is not written again, should the stream's own checkpoint have missed it
    assert not flows.append_batch(spark.createDataFrame([(9, "z")], schema), sink, 0)
    assert flows.committed(spark, sink, kind).count() == 3


def test_deduplication_goes_on_after_a_restart(spark, tmp_path):
    schema, source, sink, checkpoint = "id long, ts timestamp, n int", f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/ck"
    run = lambda: flows.drained(flows.deduplicated(spark.readStream.schema(schema).parquet(source), ["id"], time="ts", late="1 hour"), sink, checkpoint)
    one = [(1, at(0), 1), (2, at(5), 1), (1, at(9), 1)]
    two = [(2, at(20), 2), (3, at(30), 2), (1, at(40), 2), (4, at(500), 2)]
    add(spark, one, schema, source)
    run()
    add(spark, two, schema, source)
    found = sorted((r["id"], r["n"]) for r in run().collect())
    batch = flows.deduplicated(spark.createDataFrame(one + two, schema), ["id"], time="ts")
    assert found == sorted((r["id"], r["n"]) for r in batch.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_claims_meet_results_over_a_restart(spark, tmp_path):
    claims = [(k, at(10 * k)) for k in range(6)]
    results = [(0, at(29)), (1, at(41)), (2, at(20)), (3, at(31)), (3, at(59)), (9, at(1))]
    inputs = ("id long, claimed timestamp", "id long, done timestamp")

    def run():
        sides = [spark.readStream.schema(s).parquet(f"{tmp_path}/{k}") for k, s in enumerate(inputs)]
        return flows.drained(flows.answered_claims(*sides, "id", claimed="claimed", done="done"), f"file://{tmp_path}/out", f"{tmp_path}/ck")

    add(spark, claims, inputs[0], f"{tmp_path}/0")
    add(spark, results[:2], inputs[1], f"{tmp_path}/1")
    run()
    add(spark, results[2:], inputs[1], f"{tmp_path}/1")
    key = lambda rows: sorted((r["id"], r["claimed"], r["done"]) for r in rows.collect())
    batch = flows.answered_claims(spark.createDataFrame(claims, inputs[0]), spark.createDataFrame(results, inputs[1]), "id", claimed="claimed", done="done")
    assert key(run()) == key(batch) and len(key(batch)) == 4


def test_votes_that_come_again_or_late_change_nothing(rocks, tmp_path):
    spark, schema = rocks, "item long, rater long, status string, ts timestamp, vote long"
    waves = [
        [(1, 1, "approved", at(10), 1), (1, 2, "rejected", at(11), 2), (2, 1, "rejected", at(1), 3)],
        [(1, 1, "rejected", at(5), 4), (1, 1, "approved", at(10), 1), (2, 1, "rejected", at(1), 3)],  # older and again
        [(1, 2, "approved", at(12), 5), (1, 3, "needs_review", at(13), 6)],
        [(1, 1, "approved", at(10), 1), (1, 2, "approved", at(12), 5)],
    ]
    told = []
    for wave in waves:
        add(spark, wave, schema, f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        rows = flows.drained(flows.voted(stream, settled=["approved", "rejected"]), f"file://{tmp_path}/out", f"{tmp_path}/ck", mode="update").collect()
        told.append(sorted((r["item"], r["version"], r["n_votes"], r["consensus"]) for r in rows))
    assert told[0] == told[1] == [(1, 1, 2, "needs_review"), (2, 1, 1, "rejected")]
    assert told[2] == told[3] == [(1, 1, 2, "needs_review"), (1, 2, 3, "approved"), (2, 1, 1, "rejected")]


def test_claims_without_result_are_freed_once(rocks, tmp_path):
    spark, schema = rocks, "task long, kind string, at timestamp"
    run = lambda: flows.drained(flows.freed_claims(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), seconds=1800), f"file://{tmp_path}/out", f"{tmp_path}/ck")
    add(spark, [(1, "claim", at(0)), (2, "claim", at(0)), (3, "claim", at(5))], schema, f"{tmp_path}/in")
    run()
    add(spark, [(2, "result", at(20)), (3, "claim", at(25)), (4, "claim", at(110))], schema, f"{tmp_path}/in")
    run()
    add(spark, [(9, "claim", at(500))], schema, f"{tmp_path}/in")
    run()
    add(spark, [(9, "claim", at(501))], schema, f"{tmp_path}/in")
    seconds = lambda m: int(at(m).replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted((r["task"], r["freed_at"]) for r in run().collect()) == [(1, seconds(30)), (3, seconds(55)), (4, seconds(140))]


def test_streams_in_parts_keep_their_order(spark, tmp_path):
    rows = spark.range(10).withColumn("late", F.col("id") > 4)
    stream = flows.as_stream(rows, f"{tmp_path}/in", F.col("late"), ~F.col("late"))
    found = flows.drained(stream, f"file://{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r["id"] for r in found.collect()) == list(range(10))
    assert len(flows._commits(spark, f"file://{tmp_path}/out")) == 2


def test_the_state_is_asked_once_a_rater_and_batch():
    class Held(dict):
        asked = 0

        def containsKey(self, k):
            self.asked += 1
            return k in self

        getValue, updateValue = dict.__getitem__, dict.__setitem__
        iterator = dict.items

    class Told:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, v):
            self.now = v

    votes = flows.Votes(["approved", "rejected"])
    votes.newest, votes.counts, votes.told = Held(), Held(), Told()
    wave = [{"rater": k % 3, "status": "approved" if k >= 297 else "rejected", "ts": k // 2, "vote": k} for k in range(300)]
    assert [(r["n_votes"], r["consensus"]) for r in votes.handleInputRows((1,), iter(wave), None)] == [(3, "approved")]
    assert list(votes.handleInputRows((1,), iter(wave[:290]), None)) == []
    assert votes.newest.asked == 6 and votes.counts == {("approved",): (3,)}

"""Streams with state: deduplication within a watermark, claims joined with results, votes, stale claims, and an exactly-once sink."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructType

from litquarry.sources.files import exists, rename

#: The state store that stateful processors need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(events: DataFrame, keys: list[str], *, time: str, late: str = "2 hours") -> DataFrame:
    """Each key's first row. On a stream a key is remembered until the watermark is ``late`` behind its first row, so state stays bounded.

    In a batch the first row by ``time`` stays, and all repeats go, however late.
    """
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    others = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(time, F.xxhash64(*others))).alias("_row")
    return events.groupBy(*keys).agg(first).select(*keys, "_row.*").select(events.columns)


def answered_claims(claims: DataFrame, results: DataFrame, key: str, *, claimed: str, done: str, within: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Claims with the results that came at most ``within`` after them, as a stream or as a batch.

    On streams both sides have watermarks, and the interval lets Spark drop what no later row can meet.
    """
    left, right = (claims.withWatermark(claimed, late), results.withWatermark(done, late)) if claims.isStreaming else (claims, results)
    right = right.withColumnRenamed(key, "_key")
    met = (F.col(key) == F.col("_key")) & (F.col(done) >= F.col(claimed)) & (F.col(done) <= F.col(claimed) + F.expr(f"INTERVAL {within}"))
    return left.join(right, met).drop("_key")


class Votes(StatefulProcessor):
    """An item's newest vote of each rater; its consensus is told when it changes.

    Rows are (item, rater, status, ts, vote), with times as whole numbers. A vote that is older than the rater's, or the same one again, changes
    nothing. Counts by status are kept beside the votes, so that a vote costs the same however many an item has. Of a
    rater's votes in one batch only the newest meets the state.
    """

    def __init__(self, settled: list[str]):
        self.settled = settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", StructType().add("rater", LongType()), StructType().add("status", StringType()).add("ts", LongType()).add("vote", LongType()))
        self.counts = handle.getMapState("counts", StructType().add("status", StringType()), StructType().add("n", LongType()))
        self.told = handle.getValueState("told", StructType().add("n_votes", LongType()).add("consensus", StringType()).add("version", LongType()))

    def _add(self, status: str, n: int) -> None:
        had = self.counts.getValue((status,))[0] if self.counts.containsKey((status,)) else 0
        self.counts.updateValue((status,), (had + n,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest: dict = {}
        for r in rows:  # the store is asked once a rater and batch, however many votes there are
            had = latest.get(r["rater"])
            if had is None or (had[1], had[2]) < (r["ts"], r["vote"]):
                latest[r["rater"]] = (r["status"], r["ts"], r["vote"])
        for rater, new in latest.items():
            old = self.newest.getValue((rater,)) if self.newest.containsKey((rater,)) else None
            if old is not None and (old[1], old[2]) >= new[1:]:
                continue
            if old is not None:
                self._add(old[0], -1)
            self._add(new[0], 1)
            self.newest.updateValue((rater,), new)
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        n = sum(counts.values())
        consensus = next((s for s in self.settled if counts.get(s, 0) >= n // 2 + 1), "needs_review")
        before = self.told.get() if self.told.exists() else (0, None, 0)
        if (n, consensus) != (before[0], before[1]):
            self.told.update((n, consensus, before[2] + 1))
            yield Row(item=key[0], n_votes=n, consensus=consensus, version=before[2] + 1)

    def close(self) -> None:
        pass


def voted(votes: DataFrame, *, settled: list[str]) -> DataFrame:
    """(item, n_votes, consensus, version) whenever an item's consensus or number of votes changes; ``votes`` is a stream."""
    return votes.withColumn("ts", F.unix_micros("ts")).groupBy("item").transformWithState(Votes(settled), "item long, n_votes long, consensus string, version long", "Update", "None")


class Claims(StatefulProcessor):
    """A task's open claim; when the watermark passes its end without a result, the task is told to be free again.

    Rows are (task, kind, at, ms): a claim or a result, with its time in milliseconds. A claim that is taken again counts from then on.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType().add("at", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest, kind = max((r["ms"], r["kind"]) for r in rows)
        if self.open.exists():
            before = self.open.get()[0]
            if before > latest:
                return iter(())
            self.handle.deleteTimer(before + self.seconds * 1000)
            self.open.clear()
        if kind == "claim":
            self.open.update((latest,))
            self.handle.registerTimer(latest + self.seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        yield Row(task=key[0], freed_at=expiredTimerInfo.getExpiryTimeInMs() // 1000)

    def close(self) -> None:
        pass


def freed_claims(events: DataFrame, *, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(task, freed_at in seconds) of claims without a result for ``seconds`` of event time; ``events`` is a stream of (task, kind, at)."""
    marked = events.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return marked.groupBy("task").transformWithState(Claims(seconds), "task long, freed_at long", "Append", "EventTime")


def _commits(spark: SparkSession, path: str) -> list[str]:
    folder = f"{path}/commits"
    if not exists(spark, folder):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(f.getPath().getName() for f in found if not f.getPath().getName().startswith("."))


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches at ``path``."""
    batches = _commits(spark, path)
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{b}" for b in batches])


def append_batch(rows: DataFrame, path: str, batch: int, keys: list[str] | None = None) -> bool:
    """Write ``rows`` as batch ``batch`` and commit it by one rename; False if it was committed before, and then nothing is done.

    A run that stopped between writing and committing leaves a folder that no reader sees and the next run overwrites.
    With ``keys``, rows whose keys committed batches have are left out, and so are repeats within the batch.
    """
    spark, name = rows.sparkSession, f"batch-{batch:010d}"
    if name in _commits(spark, path):
        return False
    new = rows
    if keys:
        new = rows.dropDuplicates(keys).join(committed(spark, path, rows.schema).select(*keys), keys, "left_anti").select(rows.columns)
    new.write.mode("overwrite").parquet(f"{path}/data/{name}")
    _commit(spark, path, name)
    return True


def _commit(spark: SparkSession, path: str, name: str) -> None:
    draft = f"{path}/commits/.{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(draft)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()
    rename(spark, draft, f"{path}/commits/{name}")


def append_stream(rows: DataFrame, path: str, checkpoint: str, *, keys: list[str] | None = None, mode: str = "append") -> StreamingQuery:
    """Append all that is there of a stream to the batches at ``path``, each exactly once however often the query is started again."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: append_batch(batch, path, number, keys) and None).start()


def drained(rows: DataFrame, path: str, checkpoint: str, *, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """``append_stream`` until it ends, and what is committed then."""
    append_stream(rows, path, checkpoint, keys=keys, mode=mode).awaitTermination()
    return committed(rows.sparkSession, path, rows.schema)


def as_stream(rows: DataFrame, folder: str, *parts: Column, files: int = 1) -> DataFrame:
    """A stream over ``rows``, written to ``folder`` in one file for each of ``parts`` (conditions), a file a trigger, in their order."""
    spark = rows.sparkSession
    for part in parts or (F.lit(True),):
        rows.where(part).coalesce(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

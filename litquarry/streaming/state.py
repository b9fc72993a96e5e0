"""Durable state: idempotent upserts, votes, retries, stale claims, chunks, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of ``existing`` and, for keys it lacks, the first incoming one by ``order``. Running it twice changes nothing."""
    others = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, the last by ``order`` of both tables."""
    every = existing.unionByName(incoming)
    others = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def apply_results(tasks: DataFrame, results: DataFrame, key: str, *, most_attempts: int, transient: Column) -> DataFrame:
    """New status and attempts. Resolved rows stay. Success resolves. A transient error or a missing result counts as an
    attempt and leaves the row pending, or failed once ``most_attempts`` are reached. Any other error fails at once.
    """
    met = tasks.join(results, key, "left")
    done = F.col("status") == "resolved"
    again = ~done & (F.col("ok").isNull() | (~F.col("ok") & F.coalesce(transient, F.lit(False))))
    tried = F.col("attempts") + again.cast("int")
    status = F.when(done, "resolved").when(again, F.when(tried >= most_attempts, "failed").otherwise("pending")).when(F.col("ok"), "resolved").otherwise("failed")
    return met.select(key, status.alias("status"), tried.alias("attempts"))


def reclaim_stale(tasks: DataFrame, *, as_of: Column, seconds: int) -> DataFrame:
    """Rows of which the claim is older than ``seconds`` go back to the state before it: ``collecting`` to ``pending``,
    ``committing`` to ``llm_complete``. Only the latter counts as an attempt.
    """
    stale = F.coalesce(F.unix_seconds("claimed_at") < F.unix_seconds(as_of) - seconds, F.lit(False))
    collecting, committing = (stale & (F.col("status") == s) for s in ("collecting", "committing"))
    new = {
        "status": F.when(collecting, "pending").when(committing, "llm_complete").otherwise(F.col("status")),
        "attempts": F.col("attempts") + committing.cast("int"),
        "claimed_at": F.when(~(collecting | committing), F.col("claimed_at")),
    }
    return tasks.select(*(new.get(c, F.col(c)).alias(c) for c in tasks.columns))


def _ranked(rows: DataFrame, group: str, order: str, total: Column, bucket_rows: int) -> DataFrame:
    """``rows`` with ``_i``, the place (from 0) in the group by the unique numeric ``order``, and ``_before``, the sum of ``total`` before it.

    A group is cut in ranges of ``order``, of about ``bucket_rows`` rows if that is even. Windows run within a range and
    over the ranges' totals, so that no task sorts a whole group.
    """
    low, high = F.min(order).cast("double"), F.max(order).cast("double")
    spans = rows.groupBy(group).agg(low.alias("_low"), (high - low + 1).alias("_span"), F.ceil(F.count("*") / bucket_rows).alias("_n"))
    bucket = F.floor((F.col(order).cast("double") - F.col("_low")) / F.col("_span") * F.col("_n"))
    placed = rows.join(spans, group).withColumn("_bucket", bucket).withColumn("_size", total).drop("_low", "_span", "_n")
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = placed.groupBy(group, "_bucket").agg(F.sum("_size").alias("_s"), F.count("*").alias("_k"))
    starts = totals.select(group, "_bucket", sofar("_s", earlier(group, "_bucket")).alias("_s"), sofar("_k", earlier(group, "_bucket")).alias("_k"))
    within = earlier(group, "_bucket", order)
    met = placed.join(starts, [group, "_bucket"])
    return met.withColumn("_i", F.col("_k") + sofar(F.lit(1), within)).withColumn("_before", F.col("_s") + sofar("_size", within)).drop("_bucket", "_s", "_k")


def size_chunks(rows: DataFrame, group: str, order: str, size: Column, *, most_bytes: int, most_rows: int, write: Callable[[DataFrame, str], DataFrame], bucket_rows: int = 10_000) -> DataFrame:
    """``chunk``: rows of a group in order, cut before a row that would take the chunk over ``most_bytes`` or ``most_rows``.

    A chunk begins anew at each cut, which is one step after the other. Here every row is told first where a chunk that
    began at it would end; then these jumps are joined with themselves, twice as far each time, and all cuts are reached
    from the first row in as many joins as their number has binary digits. A row larger than the limit is a chunk alone.
    ``write`` stores a table under a name and reads it back. Groups and orders are not null; a null size is 0.
    """
    placed = write(_ranked(rows, group, order, F.coalesce(size.cast("long"), F.lit(0)), bucket_rows), "placed")
    ends = placed.select(group, (F.col("_before") + F.col("_size")).alias("_at"), F.lit(None).cast("long").alias("_i"))
    asks = placed.select(group, (F.col("_before") + most_bytes).alias("_at"), "_i")
    band = ends.unionByName(asks).withColumn("_band", F.floor(F.col("_at") / most_bytes))
    is_end = F.col("_i").isNull().cast("long")
    held = band.groupBy(group, "_band").agg(F.sum(is_end).alias("_k"))
    below = held.select(group, "_band", F.coalesce(F.sum("_k").over(Window.partitionBy(group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k"))
    upto = Window.partitionBy(group, "_band").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = band.withColumn("_in", F.sum(is_end).over(upto)).where("_i IS NOT NULL").join(below, [group, "_band"])
    after = F.greatest(F.col("_i") + 1, F.least(F.col("_i") + most_rows, F.col("_k") + F.col("_in")))
    jump = write(fits.select(group, "_i", after.alias("_next")), "jump-0")
    jumps = [jump]
    while True:
        further = jump.join(jump.select(group, F.col("_i").alias("_next"), F.col("_next").alias("_then")), [group, "_next"]).select(group, "_i", F.col("_then").alias("_next"))
        jump = write(further, f"jump-{len(jumps)}")
        if not jump.where("_i = 0").take(1):
            break
        jumps.append(jump)
    cuts = placed.where("_i = 0").select(group, "_i")
    for k, jump in enumerate(reversed(jumps)):
        landed = cuts.join(jump, [group, "_i"]).select(group, F.col("_next").alias("_i")).join(placed.select(group, "_i"), [group, "_i"], "left_semi")
        cuts = write(cuts.unionByName(landed).distinct(), f"cuts-{k}")
    marked = placed.join(cuts.withColumn("_cut", F.lit(1)), [group, "_i"], "left").withColumn("_part", F.floor(F.col("_i") / bucket_rows))
    parts = marked.groupBy(group, "_part").agg(F.count("_cut").alias("_k"))
    base = parts.select(group, "_part", F.coalesce(F.sum("_k").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k"))
    own = Window.partitionBy(group, "_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("_in", F.count("_cut").over(own)).join(base, [group, "_part"])
    return numbered.withColumn("chunk", F.col("_k") + F.col("_in") - 1).select(*rows.columns, "chunk")


def swept(rows: DataFrame, key: str, missing: Column, *, chunk: int, filled: str = "filled") -> DataFrame:
    """``filled``: rows that were missing something and have it after the sweeps, each of which takes at most ``chunk`` of them.

    Sweeps are numbered by the range of the key that a row is in, not one after the other: each range has about
    ``chunk`` missing rows, and all are swept, so that a sweep that was cut off can be run again by its number.
    """
    marked = rows.withColumn("_missing", F.coalesce(missing, F.lit(False)))
    spans = marked.where("_missing").agg(F.min(key).alias("_low"), F.max(key).alias("_high"), F.ceil(F.count("*") / chunk).alias("_n"))
    sweep = F.floor((F.col(key) - F.col("_low")) * F.col("_n") / (F.col("_high") - F.col("_low") + 1))
    return marked.join(spans).withColumn("sweep", F.when(F.col("_missing"), sweep)).withColumn(filled, F.col("sweep").isNotNull()).drop("_missing", "_low", "_high", "_n")


def replay(requests: DataFrame, cached: DataFrame, answer: Callable[[DataFrame], DataFrame], then: Callable[[DataFrame], DataFrame], *, key: str = "request", most_waves: int = 10, write: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Waves of requests until none is new: answers come from the cache, the rest are asked, their follow-ups join the next wave.

    ``write`` stores a wave's cache and reads it back, so that the lineage stays short and a lost executor costs one wave.
    Requests that are left after ``most_waves`` raise an error.
    """
    wave = requests
    for k in range(most_waves + 1):
        new = wave.select(key).distinct().join(cached, key, "left_anti")
        if new.isEmpty():
            return cached
        if k == most_waves:
            break
        asked = answer(new)
        cached = write(cached.unionByName(asked), k)
        wave = then(cached.join(new, key, "left_semi"))
    raise RuntimeError(f"requests are still unanswered after {most_waves} waves")


def tumbling_counts(events: DataFrame, *, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows; on a stream, rows later than ``late`` behind the newest are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sliding_counts(events: DataFrame, *, time: str, width: str = "6 hours", step: str = "3 hours", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, *, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")

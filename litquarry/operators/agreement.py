"""Agreement between raters: consensus, modal answers, Fleiss' and Cohen's kappa, resampled intervals.

All reduce votes to counts before anything is compared, so no pair of votes is made within a category.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(votes: DataFrame, item: str, status: str, *, settled: list[str]) -> DataFrame:
    """(item, n_votes, consensus): a settled status with a strict majority, else needs_review."""
    half = F.floor(F.col("n_votes") / 2) + 1
    counts = votes.groupBy(item).agg(F.count("*").alias("n_votes"), *(F.count_if(F.col(status) == s).alias(f"_{s}") for s in settled))
    chosen = F.coalesce(*(F.when(F.col(f"_{s}") >= half, s) for s in settled), F.when(F.col("n_votes") > 0, "needs_review"), F.lit("pending"))
    return counts.select(item, "n_votes", chosen.alias("consensus"))


def modal_answers(votes: DataFrame, item: str, status: str, order: str) -> DataFrame:
    """(item, raters, modal, answer): the most frequent answer and its count; of equally frequent ones the first by the number ``order``."""
    counts = votes.groupBy(item, status).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    return counts.groupBy(item).agg(F.sum("n").alias("raters"), F.max("n").alias("modal"), F.max_by(status, F.struct("n", -F.col("_seen"))).alias("answer"))


def first_item_raters(votes: DataFrame, item: str) -> int:
    """How many votes the smallest item has: the number of raters that all items of a kappa must have. One row reaches the driver."""
    first = votes.groupBy(item).agg(F.count("*").alias("n")).agg(F.min_by("n", item).alias("n")).first()
    return int(first["n"] or 0)


def fleiss_kappa(votes: DataFrame, item: str, status: str, *, raters: int) -> DataFrame:
    """(items, p_bar, p_e, kappa) over the items that have exactly ``raters`` votes; kappa is null for fewer than two raters or no item.

    All items of a kappa need the same number of raters; ``first_item_raters`` is the number that the first item sets.
    """
    counts = votes.groupBy(item, status).agg(F.count("*").alias("n"))
    full = counts.withColumn("_all", F.sum("n").over(Window.partitionBy(item))).where(F.col("_all") == raters)
    per_item = full.groupBy(item).agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * max(raters - 1, 1))).alias("p_i"))
    per_status = full.groupBy(status).agg(F.sum("n").alias("k"))
    shares = per_status.agg(F.sum(F.col("k") * F.col("k").cast("double")).alias("kk"), F.sum("k").alias("k")).select((F.col("kk") / (F.col("k") * F.col("k").cast("double"))).alias("p_e"))
    found = per_item.agg(F.count("*").alias("items"), F.avg("p_i").alias("p_bar")).join(shares)
    kappa = F.when(F.lit(raters) < 2, F.lit(None)).when(F.col("p_e") == 1, 1.0).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")))
    return found.withColumn("kappa", kappa)


def cohen_kappa(votes: DataFrame, item: str, rater: str, status: str, *, pooled: bool = False, least_shared: int = 2) -> DataFrame:
    """(rater_a, rater_b, shared, observed, kappa) for pairs of raters with at least ``least_shared`` items in common.

    ``pooled`` takes all pairs of raters as one table of observations. A pair that can only agree by chance has kappa 1.
    """
    a, b = (votes.select(item, F.col(rater).alias(f"rater_{x}"), F.col(status).alias(x)) for x in "ab")
    keys = [] if pooled else ["rater_a", "rater_b"]
    table = a.join(b, item).where("rater_a < rater_b").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    total = table.groupBy(*keys).agg(F.sum("n").alias("shared"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda x: table.groupBy(*keys, F.col(x).alias("s")).agg(F.sum("n").alias(f"k{x}"))
    chance = side("a").join(side("b"), [*keys, "s"]).groupBy(*keys).agg(F.sum(F.col("ka") * F.col("kb").cast("double")).alias("x"))
    met = total.join(chance, keys, "left") if keys else total.join(chance)
    observed, expected = F.col("same") / F.col("shared"), F.coalesce(F.col("x"), F.lit(0.0)) / (F.col("shared") * F.col("shared").cast("double"))
    kappa = F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected))
    return met.where(F.col("shared") >= least_shared).select(*keys, "shared", observed.alias("observed"), kappa.alias("kappa"))


#: Values of three hexadecimal digits from which on a Poisson draw of mean 1 is 1, 2, ... 6 or more.
POISSON = (1507, 3014, 3767, 4018, 4081, 4094)
#: Draws of one md5.
DRAWS = 10


def _resampled(group: str, key: str, value: str, replicates: int, seed: int):
    """For each Arrow batch and group in it: the weighted sum and the weight of every replicate, as two arrays."""
    blocks = -(-replicates // DRAWS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            digest = b"".join(hashlib.md5(f"{seed}|{k}|{b}".encode()).digest() for k in batch.column(key).to_pylist() for b in range(blocks))
            raw = np.frombuffer(digest, np.uint8).reshape(-1, 16)[:, :15]
            digits = np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, DRAWS, 3).astype(np.int32)
            drawn = np.searchsorted(POISSON, (digits @ np.array([256, 16, 1], np.int32)).reshape(batch.num_rows, -1)[:, :replicates], side="right")
            given = batch.column(value).to_numpy(zero_copy_only=False).astype(float)
            coded = batch.column(group).dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            sums = [((drawn[code == g] * given[code == g, None]).sum(axis=0), drawn[code == g].sum(axis=0)) for g in range(len(coded.dictionary))]
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array([s for s, _ in sums], pa.list_(pa.float64())), pa.array([w for _, w in sums], pa.list_(pa.int64()))], names=[group, "sums", "weights"])

    return run


def bootstrap_mean(rows: DataFrame, key: str, value: str, *, group: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(group, n, mean, lower, upper): a 95 % percentile interval of the mean.

    Each row weighs, in each replicate, as often as a Poisson draw of mean 1 says: the usual stand-in for drawing with
    replacement that needs one pass and no collected group. Draws are read from the md5 of seed, key and a counter, three
    hexadecimal digits each, so that they are the same anywhere. All sums of a batch's groups are updated together as
    arrays; a batch sends one row a group and replicate into the shuffle, not one a row.
    """
    known = rows.where(F.col(value).isNotNull()).select(group, key, F.col(value).cast("double").alias(value))
    kind = rows.schema[group].dataType.simpleString()
    partial = known.mapInArrow(_resampled(group, key, value, replicates, seed), f"`{group}` {kind}, sums array<double>, weights array<bigint>")
    each = partial.select(group, F.posexplode(F.arrays_zip("sums", "weights")).alias("_r", "x"))
    means = each.groupBy(group, "_r").agg((F.sum("x.sums") / F.nullif(F.sum("x.weights"), F.lit(0))).alias("m"))
    bounds = means.groupBy(group).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    per = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return per.join(bounds, group).select(group, "n", "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))

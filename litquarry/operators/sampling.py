"""Samples whose members depend on keys alone: hash order, strata in turn, even spacing, ratios between classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled_key(key: Column, seed: int) -> Column:
    """A text that orders rows at random, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def places(rows: DataFrame, key: str, *, seed: int) -> DataFrame:
    """Rows with their ``place`` from 0 in hash order, counted within 4,096 parts of the hashes: no task sorts all rows.

    A part begins where the ones before it end; their sizes are the only rows that one window spans.
    """
    keyed = rows.withColumn("_o", shuffled_key(F.col(key), seed)).withColumn("_part", F.substring("_o", 1, 3))
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n")).alias("_begin"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_o", key))
    return keyed.withColumn("_own", own).join(begins, "_part").withColumn("place", F.col("_begin") + F.col("_own") - 1).drop("_o", "_part", "_own", "_begin")


def sample_n(rows: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """``n`` rows by hash order: a top-n, so no full sort."""
    return rows.withColumn("_o", shuffled_key(F.col(key), seed)).orderBy("_o", key).limit(n).drop("_o")


def stratified(rows: DataFrame, key: str, strata: list[tuple[str, Column, int]], *, seed: int = 42) -> DataFrame:
    """Strata in order, each a name, a condition and a size; a row that one takes is out for the later ones."""
    taken: DataFrame | None = None
    for name, condition, n in strata:
        pool = rows.where(condition)
        if taken is not None:
            pool = pool.join(taken.select(key), key, "left_anti").select(rows.columns)
        picked = sample_n(pool, key, n, seed=seed).withColumn("stratum", F.lit(name))
        taken = picked if taken is None else taken.unionByName(picked)
    if taken is None:
        return rows.withColumn("stratum", F.lit(None).cast("string")).limit(0)
    return taken


def downsample(rows: DataFrame, key: str, positive: Column, *, ratio: int = 2, seed: int = 42) -> DataFrame:
    """All positive rows, and negative ones in hash order, at most ``ratio`` times as many."""
    kept = rows.where(positive).count() * ratio
    return rows.where(positive).unionByName(sample_n(rows.where(~positive), key, kept, seed=seed))

"""Joins: dimension look-ups, fan-out-safe counts, time-window overlap, resolution with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_counts(parents: DataFrame, children: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Left join of one row per key: each child table is aggregated first, so that two of them cannot multiply."""
    per_key = children.groupBy(key).agg(*(c.alias(n) for n, c in aggregates.items()))
    return parents.join(per_key, key, "left")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``: partial aggregation instead of a window."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def window_overlap_join(left: DataFrame, right: DataFrame, *, keys: list[str], days: int = 32, left_window: tuple[str, str] = ("win_start", "win_end"), right_window: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Rows whose closed window meets a half-open one, on equal keys.

    Windows are cut into buckets of ``days``; a pair is kept in the bucket where the later of them starts, so that it
    comes once. With no key the buckets alone keep this an equi-join.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / (86400 * days))
    cut = lambda df, w: df.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(w[0])), F.greatest(bucket(F.col(w[0])), bucket(F.col(w[1]))))))
    a, b = cut(left.where(F.col(left_window[0]) <= F.col(left_window[1])), left_window), cut(right.where(F.col(right_window[0]) < F.col(right_window[1])), right_window)
    met = a.join(b, [*keys, "_bucket"])
    ls, le, rs, re = (F.col(c) for c in (*left_window, *right_window))
    return met.where((ls < re) & (le >= rs) & (F.col("_bucket") == F.greatest(bucket(ls), bucket(rs)))).drop("_bucket")


def contained_join(rows: DataFrame, ranges: DataFrame, *, keys: list[str], window: tuple[str, str], valid: tuple[str, str], as_of: Column, days: int = 365) -> DataFrame:
    """``inside``: whether a row's window lies whole in one validity range of its key; an open range ends at ``as_of``.

    A window does if, of the ranges that begin at or before it, the one that ends last ends at or after it. So rows and
    ranges are put in order of their beginnings together, and the latest end so far is carried along: within parts of
    ``days`` for each key, and over the parts' latest ends. Nothing is listed more than once, however long ranges are, and
    a key that has most rows is dealt out by its parts. Rows with a null key or window are not inside.
    """
    ended = ranges.select(*keys, F.col(valid[0]).alias("_at"), F.coalesce(F.col(valid[1]), as_of).alias("_to")).where("_at <= _to")
    asked = rows.select(*keys, F.col(window[0]).alias("_at"), F.struct(*rows.columns).alias("_row"))
    both = ended.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked.withColumn("_to", F.lit(None).cast(ended.schema["_to"].dataType)))
    both = both.withColumn("_part", F.floor(F.unix_seconds("_at") / (86400 * days)))
    # parts that only rows are in have no latest end of their own
    parts = both.groupBy(*keys, "_part").agg(F.max("_to").alias("_last"))
    here = Window.partitionBy(*keys, "_part").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = parts.withColumn("_before", F.max("_last").over(before)).drop("_last")
    met = both.withColumn("_latest", F.max("_to").over(here)).where("_row IS NOT NULL").join(every, [*keys, "_part"], "left")
    inside = F.col(f"_row.{window[1]}") <= F.greatest("_latest", "_before")
    return met.select("_row.*", F.coalesce(inside, F.lit(False)).alias("inside"))


def descend(nodes: DataFrame, *, node: str, parent: str, name: str, deepest: int = 1_000) -> DataFrame:
    """(node, root, depth, path) of a tree, from the rows without a parent down, as one recursive query.

    Spark walks level by level while the query runs: nothing is run while it is planned. Nodes under no root, as in a
    cycle, are never reached. A tree of more than ``deepest`` levels is an error; the number of rows is not limited.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).cast("string").alias("name"))
    walked = f"""
        WITH RECURSIVE tree(node, root, depth, path) MAX RECURSION LEVEL {deepest} AS (
          SELECT node, node, 0, name FROM {{rows}} WHERE parent IS NULL
          UNION ALL
          SELECT r.node, tree.root, tree.depth + 1, concat_ws(' / ', tree.path, r.name) FROM {{rows}} r JOIN tree ON r.parent = tree.node
        ) SELECT * FROM tree"""
    return spark.sql(walked, rows=rows)


def resolve_unique(names: DataFrame, catalog: DataFrame, *, name_col: str, catalog_col: str, code_col: str, explicit: str | None = None) -> DataFrame:
    """Look names up without regard to case: one hit is lookup-unique, none lookup-none, more are ambiguous.

    Codes are upper case. A row whose ``explicit`` column names its source has that one, whatever the catalog says.
    """
    hits = catalog.groupBy(F.upper(catalog_col).alias("_key")).agg(F.countDistinct(code_col).alias("_n"), F.min(code_col).alias("_code"))
    met = names.join(hits, F.upper(names[name_col]) == F.col("_key"), "left")
    how = F.when(F.col("_n").isNull(), "lookup-none").when(F.col("_n") == 1, "lookup-unique").otherwise("ambiguous")
    code = F.when(F.col("_n") == 1, F.upper("_code"))
    if explicit:
        told = F.nullif(F.col(explicit), F.lit(""))
        how, code = F.when(told.isNotNull(), "explicit").otherwise(how), F.coalesce(F.upper(told), code)
    return met.withColumn("resolution", how).withColumn("code", code).drop("_key", "_n", "_code")


def merge_catalogs(first: DataFrame, second: DataFrame, key: Column) -> DataFrame:
    """Rows of both, of which the first table's win where keys are equal."""
    a, b = first.withColumn("_key", key), second.withColumn("_key", key)
    return a.unionByName(b.join(a.select("_key"), "_key", "left_anti")).drop("_key")

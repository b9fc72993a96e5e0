"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import BLANKS, ascii_lower, written

#: Common lines with more than one in so many of all rows of common lines are hot; there can be no more of them than this.
HOT_LINES = 100_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: bool = False) -> DataFrame:
    """Drop repeated lines of ``docs``, all but those of the smallest document that holds them.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least
    ``min_chars`` code points that are found in ``min_docs`` distinct ids or more lose all their lines
    except in the smallest id. Returns one row per input row: the id, ``n_lines`` (before), ``n_dropped``
    and ``kept_text`` (the other lines, joined by a line feed); with ``carry`` also ``row``, a struct of all input columns.

    Null or empty text is one empty line. A row with a null id counts for no key and keeps all its lines.
    Repeated rows of one id are one document for the count, and each is answered. Other columns are ignored.

    A hot line meets only partial aggregates (counts and minimum) on its way to its hash. The lines that make up most
    rows, at most ``HOT_LINES`` by their definition, are broadcast for the way back, so that their copies stay where
    they are; all others are joined by hash, none of them with more than its share of the rows. Documents are joined on
    their own unique key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), F.xxhash64(text).alias("body_hash"), *source)
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    lines = (
        rows.where(F.col("id").isNotNull())
        .drop("row")
        .select("id", "body_hash", F.posexplode(_lines(ascii_lower(F.col("body")))).alias("at", "line"))
        .withColumn("line", key)
        .where(F.char_length("line") >= min_chars)
        .select("id", "body_hash", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    if min_docs <= 2:
        common = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows")).where(F.col("first") < F.col("last"))
    else:
        once = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("rows"))
        common = once.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum("rows").alias("rows")).where(F.col("n") >= min_docs)
    common = written(common.select("h1", "h2", "first", "rows"), "common-lines")
    share = max((common.agg(F.sum("rows").alias("n")).first()["n"] or 0) / HOT_LINES, 1)
    hot = common.where(F.col("rows") > share).select("h1", "h2", F.col("first").alias("hot_first"))
    rest = common.where(F.col("rows") <= share).select("h1", "h2", "first")
    # a hot line has its answer already: any other hash takes it anywhere, where it meets nothing
    anywhere = F.when(F.col("hot_first").isNull(), F.col("h1")).otherwise(F.xxhash64("id", "body_hash", "at"))
    drops = (
        lines.join(F.broadcast(hot), ["h1", "h2"], "left")
        .withColumn("h1", anywhere)
        .join(rest, ["h1", "h2"], "left")
        .where(F.col("id") > F.coalesce("hot_first", "first"))
        .groupBy("id", "body_hash")
        .agg(F.collect_set("at").alias("drops"))
    )
    parts = _lines(F.col("body"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("drops")), lambda i: F.get(F.col("parts"), i)), "\n")
    return (
        rows.join(drops, ["id", "body_hash"], "left")
        .withColumn("parts", parts)
        .withColumn("n_lines", F.size("parts"))
        .select(
            F.col("id").alias(id_col),
            F.col("n_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("drops").isNull(), F.col("body")).otherwise(kept).alias("kept_text"),
            *(["row"] if carry else []),
        )
    )

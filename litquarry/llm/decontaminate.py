"""Benchmark decontamination by a positional inverted index of the training documents.

The index is a stored table of postings (term, document, place), written once by one pass over the texts: each task
leaves a segment sorted by term, so that nothing is shuffled to build it and no frequent term meets one task. A posting
of the empty term holds a document's number of words. Test items are cut into windows of words. The lists of a window's
two rarest terms are intersected at their offset; the few alignments that are left are intersected with the lists of
all other terms. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.llm.common import Workspace, ascii_lower, written

#: What stands between words: ASCII other than digits and letters a-z (after lowering A-Z).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One row of a document: its id, and a hash of its text that keeps rows apart which repeat an id.
DOC = ["id", "copy"]
#: Words of 64 bits in the set of documents that a search is narrowed to: 16 MB at most, whatever their number.
SET_WORDS = 1 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _hash(term: Column | str) -> Column:
    return F.xxhash64(term)


def build_index(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index (h, term, id, copy, at) of ``docs``, at ``path`` or in a new folder of the shared store.

    ``h`` is the term's hash, by which every segment is sorted, and ``at`` the word's place from 0. The posting of the
    empty term holds the number of words instead; a row with a null id has that one only. Null texts have no words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), words_of(text).alias("words")).withColumn("n", F.size("words"))
    listed = F.when(F.col("id").isNotNull(), F.concat(F.array(F.lit("")), "words")).otherwise(F.array(F.lit("")))
    placed = rows.select("id", "copy", "n", F.posexplode(listed).alias("place", "term"))
    at = F.when(F.col("place") == 0, F.col("n")).otherwise(F.col("place") - 1).cast("int")
    postings = placed.select(_hash("term").alias("h"), "term", "id", "copy", at.alias("at")).sortWithinPartitions("h")
    return written(postings, "postings", path)


def word_counts(index: DataFrame) -> DataFrame:
    """(id, copy, n_words), one row for each row of the documents."""
    return index.where((F.col("h") == _hash(F.lit(""))) & (F.col("term") == "")).select(*DOC, F.col("at").cast("long").alias("n_words"))


def _postings(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") != "")


def _of_documents(postings: DataFrame, found: DataFrame) -> DataFrame:
    """``postings`` of the documents of ``found`` and of a few others, whose hash falls on the same bit.

    The set that is broadcast has a fixed number of bits, so that the whole index is narrowed without a shuffle; an
    exact join has to follow.
    """
    hashed = F.xxhash64(*DOC)
    word = hashed.bitwiseAND(F.lit(SET_WORDS - 1)).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({', '.join(DOC)}), 40) & 63 as int))")
    bits = found.select(*DOC).groupBy(word).agg(F.bit_or(bit).alias("bits"))
    return postings.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(key, item, n, ids): distinct word sequences of the items, numbered, with the ids that have them."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("item"))
    grouped = rows.where(F.size("item") > 0).groupBy("item").agg(F.collect_set("item_id").alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("key"), "item", F.size("item").alias("n"), "ids")


def _places(items: DataFrame) -> DataFrame:
    return items.select("key", "n", F.posexplode("item").alias("q", "term")).withColumn("h", _hash("term"))


def _frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, cf) of those of ``terms`` that occur. A frequent term meets partial counts only."""
    return index.join(terms.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("cf"))


def _pairs(places: DataFrame, frequencies: DataFrame, width: int) -> DataFrame:
    """(key, q1, h1, q2, h2, cover): the places of the two rarest terms of each window, and all places of its windows.

    A window that has a term without postings is left out. One of a single word has that word twice.
    """
    ahead = Window.partitionBy("key").orderBy("q").rowsBetween(0, width - 1)
    size = F.least("n", F.lit(width))
    windows = (
        places.join(frequencies, "h", "left")
        .withColumn("by_cf", F.array_sort(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "q", "h")).over(ahead)))
        .where((F.col("q") + size <= F.col("n")) & (F.col("by_cf")[0]["cf"] > 0))
        .select("key", F.col("by_cf")[0].alias("one"), F.coalesce(F.get("by_cf", F.lit(1)), F.col("by_cf")[0]).alias("two"), F.sequence(F.col("q"), F.col("q") + size - 1).alias("cover"))
    )
    grouped = windows.groupBy("key", F.col("one.q").alias("q1"), F.col("one.h").alias("h1"), F.col("two.q").alias("q2"), F.col("two.h").alias("h2"))
    return grouped.agg(F.array_distinct(F.flatten(F.collect_list("cover"))).alias("cover"))


def search_phrases(index: DataFrame, benchmark: DataFrame, *, width: int = 10, item_col: str = "item_id", item_text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """(id, copy, ids, first, last): runs of document words that windows of the items with these ``ids`` occur in.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. All words
    of a run are covered by windows, and every occurrence of a window lies in a run. Joins only look for partners, so
    rows that repeat in the index do not multiply.
    """
    work = work or Workspace(index.sparkSession, "phrases")
    items = work.written(_items(benchmark, item_col, item_text_col), "items")
    places = _places(items)
    frequencies = work.written(_frequencies(_postings(index), places), "frequencies")
    pairs = work.written(_pairs(places, frequencies, width), "pairs")
    rare = pairs.select(F.col("h1").alias("h")).union(pairs.select("h2")).distinct()
    lists = work.written(_postings(index).join(rare, "h", "left_semi").select("h", *DOC, "at"), "lists")
    # alignments: the place in the document at which the item would begin
    one = lists.join(pairs.select("key", "q1", "h1", "q2", "h2"), F.col("h") == F.col("h1")).select(
        *DOC, "key", "q1", "q2", (F.col("at") - F.col("q1")).alias("begin"), (F.col("at") - F.col("q1") + F.col("q2")).alias("at"), F.col("h2").alias("h")
    )
    both = work.written(one.where("at >= 0").join(lists, [*DOC, "at", "h"], "left_semi").select(*DOC, "key", "q1", "q2", "begin"), "aligned")
    needed = (
        both.join(pairs, ["key", "q1", "q2"])
        .select(*DOC, "key", "begin", F.explode("cover").alias("q"))
        .distinct()
        .join(places.select("key", "n", "q", "term", "h"), ["key", "q"])
        .withColumn("at", F.col("begin") + F.col("q"))
    )
    mine = _of_documents(_postings(index), both).join(places.select("h").distinct(), "h", "left_semi")
    met = needed.join(mine, [*DOC, "at", "h", "term"], "left_semi")
    alignment = [*DOC, "key", "begin"]
    island = F.col("q") - F.row_number().over(Window.partitionBy(*alignment).orderBy("q"))
    runs = met.withColumn("island", island).groupBy(*alignment, "n", "island").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least("n", F.lit(width))).join(items.select("key", "ids"), "key").select(*DOC, "ids", "first", "last")


def search_proximity(index: DataFrame, queries: DataFrame, *, radius: int = 10, item_col: str = "item_id", item_text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """(id, copy, item id as a string, at): where all distinct words of a query stand within ``radius`` words of its rarest one, in any order."""
    work = work or Workspace(index.sparkSession, "proximity")
    items = work.written(_items(queries, item_col, item_text_col), "items")
    terms = _places(items).select("key", "h").distinct()
    frequencies = work.written(_frequencies(_postings(index), terms), "frequencies")
    known = terms.join(frequencies, "h", "left")
    rarest = work.written(known.groupBy("key").agg(F.min(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "h")).alias("x"), F.count("*").alias("n")).where("x.cf > 0").select("key", "n", F.col("x.h").alias("h")), "rarest")
    lists = work.written(_postings(index).join(terms.select("h").distinct(), "h", "left_semi").select("h", *DOC, "at").distinct(), "lists")
    block = lambda at: F.floor(at / (radius + 1)).cast("int")
    anchors = lists.join(rarest, "h").select(*DOC, "key", "n", F.col("at").alias("anchor"))
    wanted = anchors.join(terms, "key").withColumn("block", F.explode(F.array(*[block(F.col("anchor")) + k for k in (-1, 0, 1)])))
    near = wanted.join(lists.withColumn("block", block(F.col("at"))), [*DOC, "h", "block"]).where(F.abs(F.col("at") - F.col("anchor")) <= radius)
    met = near.groupBy(*DOC, "key", "n", "anchor").agg(F.count_distinct("h").alias("found")).where("found = n")
    return met.join(items.select("key", "ids"), "key").select(*DOC, F.explode("ids").alias(item_col), F.col("anchor").alias("at"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``search_phrases`` over an index made for this call."""
    return search_phrases(build_index(docs, id_col=id_col, text_col=text_col), benchmark, width=width, item_col=item_col, item_text_col=item_text_col)


def proximity_matches(docs: DataFrame, queries: DataFrame, *, radius: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``search_proximity`` over an index made for this call: the id, the item's id and the place of its rarest word."""
    index = build_index(docs, id_col=id_col, text_col=text_col)
    return search_proximity(index, queries, radius=radius, item_col=item_col, item_text_col=item_text_col).select(F.col("id").alias(id_col), item_col, "at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit (words inside any occurrence of a window), items (their ids as strings, sorted).

    Null and empty texts have no words; items without words or id are no windows. A row with a null id is answered with
    its words and isn't searched. Rows that repeat an id are answered each, for their own text. Very long texts are rows
    of the index like any others. An empty table gives no rows. Other columns are ignored. The index is removed at the
    end; use ``build_index`` and ``search_phrases`` to keep it for other items.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    index = build_index(docs, work.place("postings"), id_col=id_col, text_col=text_col)
    runs = written(search_phrases(index, benchmark, width=width, item_col=item_col, item_text_col=item_text_col, work=work), "runs")
    counted = written(word_counts(index), "word-counts")
    work.remove()
    order = Window.partitionBy(*DOC).orderBy("first", "last")
    sofar = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, sofar))
    hit = runs.select(*DOC, "first", "last").distinct().withColumn("fresh", fresh).groupBy(*DOC).agg(F.sum("fresh").alias("n_hit"))
    items = runs.select(*DOC, F.explode("ids").alias("item")).groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = counted.join(hit.join(items, DOC), DOC, "left")
    return found.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

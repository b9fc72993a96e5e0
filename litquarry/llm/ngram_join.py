"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Documents are sets of word shingles; equal sets are one class. Shingles are ordered by the number of classes that
have them, rarest first. A shingle of one class alone can't be shared: such shingles fill prefixes first and are
never joined on. What comes out is components, so that a pair within one component needn't be verified: all classes
of a prefix shingle first meet its most central one, and then only those that are still apart meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, new_folder, remove_folder, write_table, written
from litquarry.llm.components import connected_components
from litquarry.llm.fingerprints import bucket_bounds, bucket_count, dealt, pack_ints, pack_texts, packed_shards, runs, unpack_ints, unpack_texts, window_hashes, word_hashes

#: Parts of the hash space by which the suffixes of two sets are held against each other.
CELLS = 16
#: Cells are 16 bits wide, four in a long; larger sets have full cells, which rule nothing out.
MOST_CELL = (1 << 16) - 1
SHARDS = "shard long, packed binary"
FOUND = "kind int, id long, n long, alone long, hashes binary, token long, at long, cells array<long>"


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; words have A-Z in lower case."""
    found = [(t or "").encode().lower().split() for t in texts]
    flat = word_hashes([w for x in found for w in x])
    every = window_hashes(flat, words)
    sets, at = [], 0
    for x in found:
        n = len(x)
        if n >= words:
            sets.append(np.unique(every[at : at + n - words + 1]))
        else:
            sets.append(window_hashes(flat[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return sets


def set_digests(shards: DataFrame, *, words: int = 5) -> DataFrame:
    """(id, n, digest, shard, place) of packed texts: the number of shingles, and a digest that equal sets share."""

    def digests(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for shard, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = unpack_texts(packed)
                sets = shingle_sets(texts, words)
                columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([shard] * len(sets), pa.int64()), pa.array(range(len(sets)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "shard", "place"])

    return shards.select("shard", "packed").mapInArrow(giving_back(digests), "id long, n long, digest binary, shard long, place int")


def keep_places(shards: DataFrame, kept: DataFrame) -> DataFrame:
    """Packed texts of the kept (shard, place) alone."""

    def keep(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, packed, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = unpack_texts(packed)
                data = pack_texts([ids[k] for k in places], [texts[k] for k in places])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([data], pa.binary())], names=["shard", "packed"])

    places = kept.groupBy("shard").agg(F.collect_list("place").alias("places"))
    return shards.join(places.hint("merge"), "shard").select("shard", "packed", "places").mapInArrow(giving_back(keep), SHARDS)


def _document_frequencies(shards: DataFrame, words: int, buckets: int) -> DataFrame:
    """(shard, bucket, shared, counts): which of the shingles that a shard sent two sets or more have, and how many do."""

    def send(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(unpack_texts(packed)[1], words)]), return_counts=True)
                cut = bucket_bounds(hashes, buckets)
                rows = [(b, shard, hashes[i:j].tobytes(), pack_ints(counts[i:j])) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard", "hashes", "counts"])

    def count(batches) -> Iterator:
        import pyarrow as pa

        for bucket, parts in runs(batches, "bucket"):
            shards, hashes, counts = [], [], []
            for p in parts:
                shards += p.column(1).to_pylist()
                hashes += [np.frombuffer(x, np.uint64) for x in p.column(2).to_pylist()]
                counts += [unpack_ints(x) for x in p.column(3).to_pylist()]
            each, where = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
            rows, at = [], 0
            for shard, h in zip(shards, hashes, strict=True):
                own = total[where[at : at + len(h)]]
                at += len(h)
                told = own >= 2
                if told.any():
                    rows.append((shard, bucket, np.packbits(told).tobytes(), pack_ints(own[told])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "bucket", "shared", "counts"])

    sent = shards.select("shard", "packed").mapInArrow(giving_back(send), "bucket int, shard long, hashes binary, counts binary")
    return dealt(sent, "bucket").mapInArrow(giving_back(count), "shard long, bucket int, shared binary, counts binary")


def _prefixes(shards: DataFrame, told: DataFrame, words: int, buckets: int, percent: int) -> DataFrame:
    """Of each set that can have a partner: its shared shingles (kind 0), and a row for each joinable prefix shingle (kind 1).

    A prefix row has the shingle's place in the set's order, the number of shingles that the set alone has, and how
    many of the shared ones after it lie in each cell.
    """

    def cut(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = [k.split(" ")[0] for k in FOUND.split(", ")]
        for batch in batches:
            for packed, answers in zip(*batch.columns, strict=True):
                ids, texts = unpack_texts(packed.as_py())
                sets = shingle_sets(texts, words)
                entries, where = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
                bounds = bucket_bounds(entries, buckets)
                counts = np.ones(len(entries), np.int64)
                for answer in answers.as_py() or []:
                    i, j = int(bounds[answer["bucket"]]), int(bounds[answer["bucket"] + 1])
                    shared = np.unpackbits(np.frombuffer(answer["shared"], np.uint8), count=j - i).astype(bool)
                    counts[i:j][shared] = unpack_ints(answer["counts"])
                rows, dfs, end = [], counts[where], 0
                for i, own in zip(ids, sets, strict=True):
                    n, df = len(own), dfs[end : end + len(own)]
                    end += n
                    own, df = own[df >= 2], df[df >= 2]
                    need = -(-percent * n // 100)
                    alone = n - len(own)
                    joined = n - need + 1 - alone
                    if len(own) < need or joined <= 0:
                        continue
                    rows.append((0, i, n, alone, own.tobytes(), None, None, None))
                    order = np.lexsort((own, df))
                    cells = (own[order] >> np.uint64(60)).astype(np.int64)
                    left = np.bincount(cells, minlength=CELLS)
                    tokens = own[order].view(np.int64)
                    for k in range(min(joined, len(own))):
                        left[cells[k]] -= 1
                        rows.append((1, i, n, alone, None, int(tokens[k]), alone + k, left.astype("<u2").view("<i8").tolist() if n <= MOST_CELL else [-1] * (CELLS // 4)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    answers = told.groupBy("shard").agg(F.collect_list(F.struct("bucket", "shared", "counts")).alias("answers"))
    return shards.join(answers.hint("merge"), "shard").select("packed", "answers").mapInArrow(giving_back(cut), FOUND)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length filter, and at the first shared prefix shingle: the shared ones after it, cell by cell, must suffice."""
    c = lambda side, name: F.col(f"{side}.{name}")
    sizes = c(x, "n") + c(y, "n")
    cell = lambda side, k: F.shiftrightunsigned(c(side, f"c{k // 4}"), 16 * (k % 4)).bitwiseAND(MOST_CELL)
    after = reduce(lambda a, b: a + b, [F.least(cell(x, k), cell(y, k)) for k in range(CELLS)])
    large = F.least(c(x, "n"), c(y, "n")) > MOST_CELL
    place = F.least(c(x, "n") - c(x, "at"), c(y, "n") - c(y, "at"))
    enough = lambda overlap: overlap * (100 + percent) >= sizes * percent
    return (F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * percent) & enough(place) & (large | enough(after + 1))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of distinct ``pairs`` whose sets have the similarity."""

    def check(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, n, hashes: sets.select(F.col("id").alias(key), F.col("n").alias(n), F.col("hashes").alias(hashes))
    met = pairs.join(side("a", "n1", "h1"), "a").join(side("b", "n2", "h2"), "b")
    return met.select("a", "b", "n1", "n2", "h1", "h2").mapInArrow(giving_back(check), "a long, b long")


def similar_sets(shards: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """(node, root) of the components of packed texts (shard, packed; written, one text a class) that link with another."""
    spark, folder, buckets = shards.sparkSession, new_folder(shards.sparkSession, "ngram-join"), bucket_count(shards)
    told = written(_document_frequencies(shards, words, buckets), "frequencies")
    write_table(_prefixes(shards, told, words, buckets, percent), folder, "kind")
    found = spark.read.schema(FOUND).parquet(folder)
    shared = found.where("kind = 0").select("id", "n", "hashes")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    prefix = found.where("kind = 1").select("token", size_class.alias("class"), "id", "n", "alone", "at", *(F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(CELLS // 4)))

    # each class of a prefix shingle meets the most central one: the one with the fewest shingles of its own
    what = F.struct("alone", "id", "n", "at", *(f"c{k}" for k in range(CELLS // 4)))
    central = prefix.groupBy("token", "class").agg(F.min(what).alias("x"), F.count("*").alias("size")).where("size > 1")
    central = written(central.select("token", "class", "x.*"), "central")
    pair = lambda: (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    stars = prefix.alias("x").join(central.alias("y"), ["token", "class"]).where((F.col("x.id") != F.col("y.id")) & _may_link("x", "y", percent))
    tried = written(stars.select(*pair()).distinct(), "stars")
    links = written(_verified(tried, shared, percent), "star-links")
    root = written(connected_components(links), "star-components")

    # of a shingle's classes that are apart, those outside of its largest component meet all others
    placed = written(prefix.join(root.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "placed")
    sizes = placed.groupBy("token", "root").agg(F.count("*").alias("size"))
    apart = sizes.groupBy("token").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    apart = written(apart.select("token", "largest"), "apart")
    rest = written(placed.join(apart, "token"), "rest")
    # sizes that can link are in the same class or in one next to it
    few = rest.where(F.col("root") != F.col("largest")).withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))))
    once = (F.col("y.root") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    others = few.alias("x").join(rest.alias("y"), ["token", "class"]).where((F.col("x.root") != F.col("y.root")) & once & _may_link("x", "y", percent))
    left = others.select(*pair()).distinct().join(tried, ["a", "b"], "left_anti")
    more = written(_verified(written(left, "pairs"), shared, percent), "links")
    joined = root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return connected_components(joined)


def ngram_components(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 2 << 20) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the smallest id reachable over links of Jaccard similarity.

    Words are maximal runs of other characters than the six blanks, with A-Z in lower case; a set is the distinct
    shingles of ``words`` words, or of the whole sequence where there are fewer. Two documents link when
    ``100 * intersection >= percent * union``. All documents count, whole, and no link between two sets is lost.

    Null and empty texts, and those of blanks, have no shingles and link with nothing: the component is the id.
    A row with a null id has its number of shingles and a null component, and links with nothing. Ids are integral;
    rows that repeat an id are each answered, as parts of one node. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).alias("batch"))
    folder = new_folder(spark, "shingle-texts")
    write_table(packed_shards(rows, shard_bytes=shard_bytes).drop("batch"), folder)
    shards = spark.read.schema(SHARDS).parquet(folder)
    members = written(set_digests(shards, words=words), "set-members")
    first = members.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "shard", "place")).alias("x"))
    classes = written(first.select("digest", F.col("x.id").alias("rep"), "x.shard", "x.place"), "classes")
    distinct = written(keep_places(shards, classes), "class-texts")
    remove_folder(spark, folder)
    roots = similar_sets(distinct, words=words, percent=percent)
    place = written(classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root")), "class-roots")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    return members.join(place, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))

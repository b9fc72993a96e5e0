"""Substring dedup by a log-structured index of window hashes.

Sorted, immutable runs hold the fingerprints of all windows seen so far, a file for each bucket of hashes. A batch of
documents is dealt to the buckets and merge-joined with their runs there; what they hold is removed from the batch, its
new fingerprints become a run, and runs of a level are compacted into one of the next. A fingerprint is 64 bits to
merge on and 32 other bits to verify each match with, made of another hash of each word's bytes. A manifest names the
runs, so that a later session opens the index and goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, new_folder, remove_folder, write_table
from litquarry.llm.files import input_file, input_stream, list_folder, make_folder, output
from litquarry.llm.fingerprints import bucket_bounds, bucket_count, dealt, pack_ints, packed_shards, runs, unpack_ints, unpack_texts, window_hashes, word_hashes

SHARDS = "batch int, shard long, packed binary"
REPLY = "shard long, bucket int, held binary"


class ShardWindows:
    """The windows of a shard's documents, and its distinct fingerprints in order.

    ``owner`` is the smallest id of the shard that has a fingerprint. Texts of null ids have no windows.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None], width: int):
        self.words = [(t or "").encode().split() for t in texts]
        self.size = np.array([len(w) for w in self.words], np.int64)
        every = [x for w in self.words for x in w]
        flat, other = word_hashes(every), word_hashes(every, seed=1)
        known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        text = np.repeat(np.arange(len(ids)), self.size)
        left = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(flat))
        self.at = np.flatnonzero((left >= width) & known[text])
        hashes = window_hashes(flat, width)[self.at]
        checks = (window_hashes(other, width, seed=1) >> np.uint64(32)).astype(np.uint32)[self.at]
        self.id_of = self.ids[text[self.at]]
        order = np.lexsort((self.id_of, checks, hashes))
        hashes, checks = hashes[order], checks[order]
        first = np.ones(len(order), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
        self.hashes, self.checks, self.owner = hashes[first], checks[first], self.id_of[order][first]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1


def _sent(documents: DataFrame, width: int, buckets: int) -> DataFrame:
    """Each shard's distinct fingerprints with their smallest ids, a row for each bucket."""

    def send(batches) -> Iterator:
        import pyarrow as pa

        kinds = {"bucket": pa.int32(), "shard": pa.int64(), "hashes": pa.binary(), "checks": pa.binary(), "owners": pa.binary()}
        for batch in batches:
            for shard, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = ShardWindows(*unpack_texts(packed), width)
                cut = bucket_bounds(own.hashes, buckets)
                rows = [(b, shard, own.hashes[i:j].tobytes(), own.checks[i:j].tobytes(), pack_ints(own.owner[i:j])) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return documents.select("shard", "packed").mapInArrow(giving_back(send), "bucket int, shard long, hashes binary, checks binary, owners binary")


#: Bytes of a text for each word that begins a window.
WORD_BYTES = 6
#: Fingerprints of a run that are in memory at a time while a batch is merged with it.
BLOCK = 1 << 20


def _read_run(folder: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """A run's sorted hashes and their checks in a bucket; a bucket without any has no file."""
    try:
        with input_stream(f"{folder}/{bucket:06d}.run") as source:
            data = source.read()
    except FileNotFoundError:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n)


def _write_run(folder: str, bucket: int, hashes: np.ndarray, checks: np.ndarray) -> None:
    with output(f"{folder}/{bucket:06d}.run") as out:
        for part in (len(hashes).to_bytes(8, "little"), hashes.astype("<u8").tobytes(), checks.astype("<u4").tobytes()):
            out.write(part)


def _run_blocks(folder: str, bucket: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A run's fingerprints in a bucket in order, ``size`` at a time."""
    try:
        source = input_file(f"{folder}/{bucket:06d}.run")
    except FileNotFoundError:
        return
    with source:
        n = int.from_bytes(source.read(8), "little")
        for k in range(0, n, size):
            some = min(size, n - k)
            hashes = np.frombuffer(source.read_at(8 * some, 8 + 8 * k), "<u8")
            yield hashes, np.frombuffer(source.read_at(4 * some, 8 + 8 * n + 4 * k), "<u4")


def _held(hashes: np.ndarray, checks: np.ndarray, run: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of some fingerprints, sorted by hash, a run has: both are merged block by block, and checks verify equal hashes.

    A block of the run and those of ours that its hashes reach over are sorted runs; a stable sort of both in a row merges
    them, theirs before ours where hashes are equal. Each of ours then looks back over equal hashes for its check.
    """
    found = np.zeros(len(hashes), bool)
    for theirs, verify in run:
        first, end = np.searchsorted(hashes, theirs[0]), np.searchsorted(hashes, theirs[-1], side="right")
        if first == end:
            continue
        n = len(theirs)
        order = np.argsort(np.concatenate([theirs, hashes[first:end]]), kind="stable")
        merged, told = np.concatenate([theirs, hashes[first:end]])[order], np.concatenate([verify, checks[first:end]])[order]
        place = np.flatnonzero(order >= n)  # ours
        mine, back = order[place] - n + first, place - 1
        while len(mine):
            met = (back >= 0) & (merged[np.maximum(back, 0)] == hashes[mine])
            same = met & (order[np.maximum(back, 0)] < n) & (told[np.maximum(back, 0)] == checks[mine])
            found[mine[same]] = True
            mine, back = mine[met & ~same], back[met & ~same] - 1
    return found


class FingerprintIndex:
    """Runs of window fingerprints in the shared folder. ``levels`` holds the folders of the runs by level.

    After every change a new manifest names them; the one with the highest number counts, and the others go. ``open``
    reads it back, in this session or another.
    """

    def __init__(self, spark: SparkSession, folder: str, *, width: int = 13, buckets: int = 256, fanout: int = 4):
        self.spark, self.folder, self.width, self.buckets, self.fanout = spark, folder, width, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that was left in ``folder``."""
        names = [n for n in list_folder(folder) if n.startswith("manifest-")]
        if not names:
            raise FileNotFoundError(f"no index in {folder}")
        with input_stream(f"{folder}/{max(names)}") as source:
            state = json.loads(source.read())
        found = cls(spark, folder, width=state["width"], buckets=state["buckets"], fanout=state["fanout"])
        found.levels, found.made = [[f"{folder}/{n}" for n in level] for level in state["levels"]], state["made"]
        return found

    def save(self) -> None:
        """Write the manifest of the runs as they are now, and delete older ones."""
        make_folder(self.folder)
        name = self._next("manifest").rsplit("/", 1)[1]
        state = {"width": self.width, "buckets": self.buckets, "fanout": self.fanout, "made": self.made, "levels": [[p.rsplit("/", 1)[1] for p in level] for level in self.levels]}
        with output(f"{self.folder}/{name}") as out:
            out.write(json.dumps(state).encode())
        for old in list_folder(self.folder):
            if old.startswith("manifest-") and old < name:
                remove_folder(self.spark, f"{self.folder}/{old}")

    def _next(self, kind: str) -> str:
        self.made += 1
        return f"{self.folder}/{kind}-{self.made:06d}"

    def ingest(self, documents: DataFrame, *, keep: bool = True) -> DataFrame:
        """Merge a batch of packed shards with the runs; returns the answers to its shards.

        An answer has a bit for each fingerprint that a shard sent to a bucket: whether a run has it, or a smaller
        id of another shard of the batch. Unless ``keep`` is off, the batch's new fingerprints become a run.
        """
        history, path = [p for level in self.levels for p in level], self._next("run")
        if keep:
            make_folder(path)

        def merge(batches) -> Iterator:
            import pyarrow as pa

            for bucket, parts in runs(batches, "bucket"):
                shards, sizes, columns = [], [], ([], [], [])
                for part in parts:
                    for shard, h, c, o in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                        for to, values in zip(columns, (np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32), unpack_ints(o)), strict=True):
                            to.append(values)
                        shards.append(shard)
                        sizes.append(len(columns[0][-1]))
                hashes, checks, owners = (np.concatenate(x) for x in columns)
                order = np.lexsort((owners, checks, hashes))
                hashes, checks, owners = hashes[order], checks[order], owners[order]
                first = np.ones(len(order), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
                group = np.cumsum(first) - 1
                each, verify = hashes[first], checks[first]
                old = np.zeros(len(each), bool)
                for run in history:
                    old |= _held(each, verify, _run_blocks(run, bucket, BLOCK))
                held = np.empty(len(order), bool)
                held[order] = old[group] | (owners > owners[first][group])
                if keep and not old.all():
                    _write_run(path, bucket, each[~old], verify[~old])
                ends = np.cumsum(sizes)
                told = [(s, bucket, np.packbits(held[i:j]).tobytes()) for s, i, j in zip(shards, (ends - sizes).tolist(), ends.tolist(), strict=True) if held[i:j].any()]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "bucket", "held"])

        answers = self._next("answers")
        write_table(dealt(_sent(documents, self.width, self.buckets), "bucket", "shard").mapInArrow(giving_back(merge), REPLY), answers)
        if keep:
            self.levels[0].append(path)
            self.save()
            self.compact()
        return self.spark.read.schema(REPLY).parquet(answers)

    def compact(self) -> None:
        """Make one run of the next level from every ``fanout`` runs of a level, bucket by bucket."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                path = self._next("run")
                make_folder(path)

                def merge(batches, old=old, path=path) -> Iterator:
                    for batch in batches:
                        for bucket in batch.column(0).to_pylist():
                            hashes, checks = (np.concatenate(x) for x in zip(*(_read_run(p, bucket) for p in old), strict=True))
                            if len(hashes):
                                order = np.lexsort((checks, hashes))
                                _write_run(path, bucket, hashes[order], checks[order])
                        yield batch

                parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
                self.spark.range(0, self.buckets, 1, min(parts, self.buckets)).mapInArrow(giving_back(merge), "id long").agg(F.count("*")).collect()
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(path)
                self.save()
                for p in old:
                    remove_folder(self.spark, p)
            level += 1

    def drop(self) -> None:
        """Delete the runs; answers stay."""
        for path in (p for level in self.levels for p in level):
            remove_folder(self.spark, path)
        self.levels = [[]]
        self.save()


def remove_covered(documents: DataFrame, answers: DataFrame, *, width: int, buckets: int) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of packed shards by the answers to them."""

    def keep(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for packed, told in zip(*batch.columns, strict=True):
                ids, texts = unpack_texts(packed.as_py())
                told = told.as_py() or []
                own = ShardWindows(ids, texts, width)
                cut = bucket_bounds(own.hashes, buckets)
                held = np.zeros(len(own.hashes), bool)
                for answer in told:
                    i, j = int(cut[answer["bucket"]]), int(cut[answer["bucket"] + 1])
                    held[i:j] = np.unpackbits(np.frombuffer(answer["held"], np.uint8), count=j - i).astype(bool)
                hit = own.at[held[own.entry] | (own.id_of > own.owner[own.entry])]
                end = np.cumsum(own.size)
                gone = np.zeros((int(end[-1]) if len(end) else 0) + 1, np.int64)
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + width, -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept, removed = [], []
                for w, a, b in zip(own.words, (end - own.size).tolist(), end.tolist(), strict=True):
                    out = covered[a:b]
                    n = int(out.sum())
                    removed.append(n)
                    kept.append(b" ".join([x for x, y in zip(w, out.tolist(), strict=True) if not y] if n else w).decode())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.size), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    told = answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "held")).alias("told"))
    met = documents.join(told, "shard", "left").select("packed", "told")
    return met.mapInArrow(giving_back(keep), "id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, *, width: int = 13, batches: int = 6, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word that is covered by a window of ``width`` words that also starts in a document of a smaller id.

    Words are maximal runs of other characters than the six blanks, unchanged; windows are judged on the input.
    The ids (integral) are dealt into ``batches`` ranges, which go through a ``FingerprintIndex`` in ascending order,
    so that what is historical has a smaller id. Returns one row per input row: the id, ``n_words``, ``n_removed``
    and ``kept_text`` (kept words joined by a space).

    Null text has no words. A row with a null id is no source of windows and keeps its words. Repeated rows of one id
    are one document: they don't remove from each other, and each is answered. Other columns are ignored.

    A fingerprint leaves a shard (2 MB of text) once, however often the shard has it, and its answer is a bit.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shares = [k / batches for k in range(1, batches)]
    seen = rows.agg(F.percentile_approx("id", shares or [0.5], 1000), F.sum(F.octet_length("text"))).first()
    cuts = sorted(set(seen[0] or [])) if shares else []
    number = reduce(lambda a, b: a + b, [(F.col("id") > int(c)).cast("int") for c in cuts], F.lit(0))
    folder = new_folder(spark, "substring-dedup")
    write_table(packed_shards(rows.withColumn("batch", F.coalesce(number, F.lit(0)))), f"{folder}/documents", "batch")
    documents = spark.read.schema(SHARDS).parquet(f"{folder}/documents")
    buckets = bucket_count(docs, (seen[1] or 0) // WORD_BYTES)
    index = FingerprintIndex(spark, f"{folder}/index", width=width, buckets=buckets, fanout=fanout)
    answers = [index.ingest(documents.where(F.col("batch") == k), keep=k < len(cuts)) for k in range(len(cuts) + 1)]
    index.drop()
    found = remove_covered(documents, reduce(DataFrame.unionByName, answers), width=width, buckets=buckets)
    return found.withColumnRenamed("id", id_col)

"""Hashes of word windows, and their exchange between shards of documents and buckets of hashes.

Shards send each of their distinct hashes once, as arrays: one row for a shard and a bucket. A hash that a third of
all documents hold thus reaches its bucket once a shard. The buckets answer in the same form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back

#: Distinct words that a worker remembers hashes of; longer words than LONG bytes are hashed anew each time.
MOST_WORDS, LONG = 500_000, 48


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class WordHashes(dict):
    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= LONG:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


_KNOWN = {0: WordHashes()}


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A hash of each word; another seed is another hash of its bytes."""
    known = _KNOWN.setdefault(seed, WordHashes(seed))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash for every ``width`` consecutive word hashes (none if there are fewer); another seed, another hash."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    own = _mixed(words + np.uint64(seed)) if seed else words
    for j, factor in enumerate(_factors(width, seed)):
        total += own[j : j + n] * factor
    return _mixed(total)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as a base, a width and their distances from the base in as few bytes as hold them."""
    base = int(values.min()) if len(values) else 0
    away = (values.astype(np.int64) - np.int64(base)).view(np.uint64)
    most = int(away.max()) if len(away) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + away.astype(f"<u{width}").tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    base, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    return np.frombuffer(data, f"<u{width}", offset=9).astype(np.uint64).view(np.int64) + np.int64(base)


#: Fingerprints that a bucket is meant to hold, 12 bytes each.
IN_BUCKET = 2_000_000


def bucket_count(df: DataFrame, fingerprints: int = 0) -> int:
    """A power of two: as many buckets as ``fingerprints`` fill, and at least two for each shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(4, (max(2 * parts, -(-fingerprints // IN_BUCKET)) - 1).bit_length())


def bucket_bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, by the top bits, begins and ends in sorted hashes."""
    step = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.arange(1, buckets, dtype=np.uint64) << step
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def dealt(df: DataFrame, key: str, *then: str) -> DataFrame:
    """Rows of a key together and in order, on as many partitions as the session shuffles to."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, parts), key).sortWithinPartitions(key, *then)


def runs(batches, key: str) -> Iterator[tuple[object, Iterator]]:
    """(key, its record batches) of batches that are sorted by ``key``; a key's batches are read as they are asked for."""
    import pyarrow.compute as pc

    source = iter(batches)
    waiting = None

    def parts_of(value) -> Iterator:
        nonlocal waiting
        while True:
            if waiting is None or not waiting.num_rows:
                waiting = next(source, None)
                if waiting is None:
                    return
                continue
            keys = waiting.column(waiting.schema.get_field_index(key))
            if keys[0].as_py() != value:
                return
            if keys[-1].as_py() == value:
                n = waiting.num_rows
            else:
                n = pc.index(pc.not_equal(keys, value), True).as_py()
            part, waiting = waiting.slice(0, n), waiting.slice(n)
            yield part

    while True:
        while waiting is None or not waiting.num_rows:
            waiting = next(source, None)
            if waiting is None:
                return
        value = waiting.column(waiting.schema.get_field_index(key))[0].as_py()
        parts = parts_of(value)
        yield value, parts
        for _ in parts:
            pass


def pack_texts(ids: list[int | None], texts: list[str | None]) -> bytes:
    """Ids and texts as one compressed Arrow stream: what a shard of documents is kept and shuffled as."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_texts(data: bytes) -> tuple[list[int | None], list[str | None]]:
    import pyarrow as pa

    table = pa.ipc.open_stream(data).read_all()
    return table.column("id").to_pylist(), table.column("text").to_pylist()


def packed_shards(docs: DataFrame, *, shard_bytes: int = 2 << 20) -> DataFrame:
    """(batch, shard, packed): rows (id, text, batch) packed into one row for about ``shard_bytes`` of text of a batch.

    A longer text is the last of its shard. As a row, a shard is never split between tasks.
    """

    def pack(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 24, 0
        held: dict[int, tuple[list, list, int]] = {}

        def close(k: int):
            nonlocal n
            ids, texts, _ = held.pop(k)
            n += 1
            columns = [pa.array([k], pa.int32()), pa.array([part + n], pa.int64()), pa.array([pack_texts(ids, texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "shard", "packed"])

        for b in batches:
            for i, text, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, texts, size = held.get(k) or ([], [], 0)
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 16
                held[k] = (ids, texts, size)
                if size >= shard_bytes:
                    yield close(k)
        for k in list(held):
            yield close(k)

    return docs.select("id", "text", "batch").mapInArrow(giving_back(pack), "batch int, shard long, packed binary")

"""Pattern packing by non-negative least squares: few documents a pattern, fitted to the histogram of lengths.

The plan is made from the histogram alone, which has no more rows than a sequence has tokens; it says, for each
length, which ranks go where. Documents learn their rank within their length on the executors and look it up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, written
from litquarry.llm.tokens import encoder, slices, word_pieces

#: A packed sequence's contents as ((length, times), ...) in order of their offsets, and how many sequences have them.
Packed = tuple[tuple[tuple[int, int], ...], int]


def enumerate_patterns(lengths: set[int], size: int, *, grid: int = 64) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths, all present, that fill a sequence: every pair, and triples and fours on a grid.

    The grid keeps their number within a few thousand for any ``size``; the last length of a pattern is off the grid.
    """
    step3, step4 = max(1, size // grid), max(1, size // (grid // 4))
    found = {(a, size - a) for a in lengths if a >= size - a and size - a in lengths}
    on3 = sorted(x for x in lengths if x % step3 == 0)
    on4 = sorted(x for x in lengths if x % step4 == 0)
    found |= {tuple(sorted((a, b, size - a - b), reverse=True)) for a in on3 for b in on3 if b <= a and size - a - b in lengths}
    found |= {tuple(sorted((a, b, c, size - a - b - c), reverse=True)) for a in on4 for b in on4 if b <= a for c in on4 if c <= b and size - a - b - c in lengths}
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent: repeats of each pattern that come nearest to the histogram."""
    held = [list(Counter(p).items()) for p in patterns]
    norm = [sum(k * k for _, k in h) for h in held]
    left = defaultdict(float, histogram)
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, h in enumerate(held):
            step = max(-x[i], sum(k * left[n] for n, k in h) / norm[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, k in h:
                    left[n] -= k * step
        if moved < 0.01:
            break
    return np.array(x)


def pack_residual(histogram: dict[int, int], size: int) -> list[Packed]:
    """Best fit, longest first, by counts: all of a length that find the same room are placed at once."""
    rooms: list[int] = []
    open_at: dict[int, list[Packed]] = {}

    def put(room: int, held: Packed) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append(held)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                whole, rest = divmod(n, each)
                if whole:
                    put(size - each * length, (((length, each),), whole))
                if rest:
                    put(size - rest * length, (((length, rest),), 1))
                break
            room = rooms[at]
            held, times = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
            each = room // length
            whole = min(times, n // each)
            if whole:
                put(room - each * length, ((*held, (length, each)), whole))
                n -= whole * each
                times -= whole
            if times and n and n < each:
                put(room - n * length, ((*held, (length, n)), 1))
                n, times = 0, times - 1
            if times:
                put(room, (held, times))
    return [p for packs in open_at.values() for p in packs]


def plan_packing(histogram: dict[int, int], size: int) -> list[Packed]:
    """Sequences for a histogram of piece lengths (1 to ``size``): fitted patterns first, best fit for what they leave."""
    left = {n: c for n, c in histogram.items() if n < size and c > 0}
    plan: list[Packed] = [(((size, 1),), histogram[size])] if histogram.get(size) else []
    patterns = enumerate_patterns(set(left), size)
    x = fit_counts(patterns, left)
    for i in sorted(range(len(patterns)), key=lambda i: (-x[i], patterns[i])):
        held = Counter(patterns[i])
        times = min(int(x[i] + 0.5), *(left[n] // k for n, k in held.items()))
        if times > 0:
            plan.append((tuple(sorted(held.items(), reverse=True)), times))
            for n, k in held.items():
                left[n] -= k * times
    return plan + pack_residual({n: c for n, c in left.items() if c}, size)


def _lookup(plan: list[Packed]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that a plan entry takes: columns sorted by length and first rank."""
    ranges, taken, first = [], defaultdict(int), 0
    for held, times in plan:
        offset = 0
        for n, k in held:
            ranges.append((n, taken[n], k, first, offset))
            taken[n] += k * times
            offset += n * k
        first += times
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def cut_documents(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut every ``size`` ids.

    Columns: the id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit integers) and, on
    request, the ids themselves. Null text is empty, so that its piece holds ``end_id`` alone.
    """
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches) -> Iterator:
        import pyarrow as pa

        tool = encoder(tokenizer, word_pieces)
        for batch in batches:
            ids = batch.column(0)
            for at, part in slices(batch.column(1).to_pylist()):
                owner, piece, start, length, crc, own = [], [], [], [], [], []
                for i, data in enumerate(tool.encode(part), at):
                    data += tail
                    for k in range(ceil(len(data) / (4 * size))):
                        some = data[4 * size * k : 4 * size * (k + 1)]
                        owner.append(i)
                        piece.append(k)
                        start.append(k * size)
                        length.append(len(some) // 4)
                        crc.append(zlib.crc32(some))
                        own.append(np.frombuffer(some, "<u4").astype(np.int32) if with_ids else None)
                columns = [ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    out = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(giving_back(cut), out)


def assign_sequences(pieces: DataFrame, *, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces that has a ``length`` from 1 to ``size``.

    The histogram has at most ``size`` rows. A piece's rank within its length is its rank within its bucket
    after the buckets before: buckets are as many as shuffle partitions, so that a length that a third of all
    documents have is spread over all of them.
    """
    spark = pieces.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = _lookup(plan_packing(histogram, size))
    span = np.int64(1) << 44
    keys = table["length"] * span + table["rank"]

    def place(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            past = rank - table["rank"][at]
            sequence = table["sequence"][at] + past // table["each"][at]
            offset = table["offset"][at] + past % table["each"][at] * length
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("rank", "bucket")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    order = Window.partitionBy("length", "bucket").orderBy(id_col, "piece")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(order) - 1)
        .join(before.drop("n"), ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
        .select(*pieces.columns, "bucket", "rank")
    )
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(giving_back(place), out)


def pack_documents(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as the plan finds; only longer ones are cut.

    Each row of the input has its pieces in the result, repeated rows and null ids too (pieces of equal rows
    are dealt to equal places in any order). An empty table gives an empty result.
    """
    pieces = written(cut_documents(docs, tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    return assign_sequences(pieces, size=size, id_col=id_col)

"""Token ids as binary shards, each compressed by a Re-Pair grammar and decodable at any place.

A shard holds whole documents in ascending order of id. Frequent pairs of ids are replaced by nonterminals, again
and again; the file keeps the rules, the length that every rule expands to, and the token offset of every 256th
symbol, from which any document is decoded without the ones before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, new_folder, written
from litquarry.llm.files import input_stream, make_folder, output
from litquarry.llm.tokens import column_encoder, column_slices, spans

MAGIC = b"RPAIR\0\0\x01"
#: Symbols between two entries of the offset index.
STRIDE = 256


#: Slots in which pairs are counted before they are sorted, as a power of two.
SLOT_BITS = 20


def _slots(key: np.ndarray) -> np.ndarray:
    """The slot of each key: several keys may share one."""
    if key.dtype == np.uint32:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counted(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the keys that come ``least`` times, the most frequent first, then the smallest."""
    key = np.sort(key)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(key)))
    often = counts >= least
    keys, counts = key[begin[often]], counts[often]
    order = np.argsort(-counts, kind="stable")
    return keys[order], counts[order]


def _places(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) of all places i where ``key`` is keys[k]; ``keys`` are distinct."""
    table = np.zeros(1 << SLOT_BITS, np.int32)
    own, number = _slots(keys), np.arange(1, len(keys) + 1, dtype=np.int32)
    table[own] = number
    found = table.take(_slots(key))
    at = np.flatnonzero(found)
    found = found[at] - 1
    hit = keys[found] == key[at]
    hidden = np.flatnonzero(table[own] != number)  # another key has their slot
    if not len(hidden):
        return at[hit], found[hit]
    hidden = hidden[np.argsort(keys[hidden])]
    rest = at[~hit]
    k = np.minimum(np.searchsorted(keys[hidden], key[rest]), len(hidden) - 1)
    also = keys[hidden[k]] == key[rest]
    return np.concatenate([at[hit], rest[also]]), np.concatenate([found[hit], hidden[k[also]]])


def repair(ids: np.ndarray, vocab: int, *, most_rules: int | None = None, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a grammar for ``ids``; rule r stands for symbol ``vocab + r`` and has two symbols.

    Each round counts all pairs exactly, takes pairs from the most frequent one down such that no symbol is the left of
    one and the right of another (so that no two chosen occurrences overlap), and replaces every occurrence. Of a run
    of equal symbols, every other place counts. It ends when no pair comes ``least`` times, or after ``most_rules`` rules, if given.

    A pair of two older symbols only gets rarer. So a round looks again only at places whose pair was frequent in the
    last one or has a new symbol since; symbols are a linked list, of which replaced places drop out.
    """
    n = len(ids)
    s = np.append(ids, 0).astype(np.uint32)  # the last place is an end mark
    place = np.int32 if n < (1 << 31) - 2 else np.int64
    after, before = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
    before[0] = n
    live = np.ones(n + 1, bool)  # places whose pair may be frequent
    gone = np.zeros(n + 1, bool)
    live[max(0, n - 1) :] = False
    rules: list[tuple[int, int]] = []
    while most_rules is None or len(rules) < most_rules:
        n_symbols = vocab + len(rules)
        half, kind = (16, np.uint32) if n_symbols <= 1 << 16 else (32, np.uint64)
        at = np.flatnonzero(live)
        left, right = s[at], s[after[at]]
        key = left.astype(kind) << kind(half) | right
        odd = np.flatnonzero(left == right)
        del left, right
        if len(odd):
            order = np.arange(len(odd))
            runs = np.concatenate([[True], after[at[odd[:-1]]] != at[odd[1:]]])
            odd = odd[(order - np.maximum.accumulate(np.where(runs, order, 0))) % 2 == 1]
        slot = _slots(key)
        counts = np.bincount(slot, minlength=1 << SLOT_BITS)
        np.subtract.at(counts, slot[odd], 1)
        often = (counts >= least).take(slot)
        live[at] = often
        often[odd] = False
        del slot
        often = np.flatnonzero(often)
        at, key = at[often], key[often]
        del often
        keys, _ = _counted(key, least)
        if not len(keys):
            break
        role = bytearray(n_symbols)  # 1: left of a pair, 2: right of one, 3: both of one
        chosen: list[int] = []
        for k, (a, b) in enumerate(zip((keys >> kind(half)).tolist(), (keys & kind((1 << half) - 1)).tolist(), strict=True)):
            if a == b and role[a] == 0:
                role[a] = 3
            elif a != b and role[a] in (0, 1) and role[b] in (0, 2):
                role[a], role[b] = 1, 2
            else:
                continue
            chosen.append(k)
            rules.append((a, b))
            if len(rules) == most_rules:
                break
        hit, new = _places(keys[chosen], key)
        at = at[hit]
        s[at] = n_symbols + new
        dropped = after[at]
        gone[dropped] = True
        live[dropped] = False
        after[at] = after[dropped]
        before[after[at]] = at
        live[at] = True
        live[before[at]] = True
        live[n] = live[before[n]] = False
    return s[:n][~gone[:n]].astype(np.int32), np.array(rules, np.int64).reshape(-1, 2)


def rule_lengths(vocab: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for."""
    size: list[int] = []
    for left, right in rules.tolist():
        size.append((1 if left < vocab else size[left - vocab]) + (1 if right < vocab else size[right - vocab]))
    return np.array(size, np.int64)


class Grammar:
    """Expansions of a shard's symbols."""

    def __init__(self, vocab: int, rules: np.ndarray):
        self.vocab = vocab
        self.size = rule_lengths(vocab, rules)
        self.begin = np.concatenate([np.arange(vocab, dtype=np.int64), vocab + np.cumsum(self.size) - self.size])
        self.length = np.concatenate([np.ones(vocab, np.int64), self.size])
        self.flat = np.concatenate([np.arange(vocab, dtype=np.uint32), np.zeros(int(self.size.sum()), np.uint32)])
        depth: list[int] = []
        for left, right in rules.tolist():
            depth.append(1 + max(0 if left < vocab else depth[left - vocab], 0 if right < vocab else depth[right - vocab]))
        level = np.array(depth, np.int64)
        order = np.argsort(level, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(order) else []:  # those of a level need lower ones only
            self.flat[spans(self.begin[vocab + some], self.size[some])] = self.expand(rules[some].ravel())

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.begin[symbols], self.length[symbols])]


def shard_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, vocab: int) -> bytes:
    """A shard's file: header, documents, rules with expansion lengths, offset index, symbols."""
    symbols, rules = repair(ids, vocab)
    lengths = rule_lengths(vocab, rules)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    ends = np.cumsum(np.concatenate([np.ones(vocab, np.int64), lengths])[symbols])
    index = np.concatenate([[0], ends[STRIDE - 1 :: STRIDE]])[: -(-len(symbols) // STRIDE) or 1]
    head = np.array([len(doc_ids), len(ids), len(rules), len(symbols), vocab, width, len(index)], "<u8")
    starts = np.cumsum(sizes) - sizes
    parts = [head, np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), starts.astype("<u8"), rules.astype("<u4"), lengths.astype("<u8"), index.astype("<u8"), symbols.astype(f"<u{width}")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's file, read."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no token shard")
        self.at, self.data = 8, data
        self.n_docs, self.n_tokens, n_rules, n_symbols, vocab, width, n_index = (int(x) for x in self._take("<u8", 7))
        ids, none, self.starts = self._take("<i8", self.n_docs), self._take("u1", self.n_docs), self._take("<u8", self.n_docs).astype(np.int64)
        self.doc_ids = [None if n else int(x) for x, n in zip(ids, none, strict=True)]
        self.grammar = Grammar(vocab, self._take("<u4", 2 * n_rules).astype(np.int64).reshape(-1, 2))
        if not np.array_equal(self._take("<u8", n_rules).astype(np.int64), self.grammar.size):
            raise ValueError("the rules do not expand to their stated lengths")
        self.index = self._take("<u8", n_index).astype(np.int64)
        self.symbols = self._take(f"<u{width}", n_symbols)
        if self.at != len(data):
            raise ValueError("the shard has another length than it states")

    def _take(self, kind: str, n: int) -> np.ndarray:
        got = np.frombuffer(self.data, kind, n, self.at)
        self.at += got.nbytes
        return got

    def span(self, i: int) -> tuple[int, int]:
        return int(self.starts[i]), int(self.starts[i + 1]) if i + 1 < self.n_docs else self.n_tokens

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the shard, decoded from the nearest indexed symbols alone."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = (int(np.searchsorted(self.index, x, side="right")) - 1 for x in (start, end - 1))
        ids = self.grammar.expand(self.symbols[first * STRIDE : (last + 1) * STRIDE])
        base = int(self.index[first])
        return ids[start - base : end - base]


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 21) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending order of id; returns the manifest.

    ``tokenizer`` is the file of a byte-level BPE without a normalizer; others are refused where tokens do not spell the text.
    The manifest is a written table (part, shard, path, n_docs, n_tokens, before: tokens of the part's earlier
    shards). ``id_col`` must be integral; null ids come first, null texts are empty, and rows that repeat an id are
    written each, ordered by text. A shard has at most ``shard_tokens`` ids, or one longer document.
    """
    make_folder(folder)
    spark = docs.sparkSession

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tool, part = column_encoder(tokenizer), TaskContext.get().partitionId()
        vocab = max(tool.tokenizer.get_vocab_size(with_added_tokens=True), int(end_id) + 1)
        rows: list[tuple] = []
        owners: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        before = total = 0

        def close() -> None:
            nonlocal before, total, owners, held, sizes
            path = f"{folder}/part-{part:06d}-{len(rows):05d}.rpair"
            with output(path) as out:
                out.write(shard_bytes(owners, sizes, np.concatenate(held), vocab))
            rows.append((part, len(rows), path, len(owners), total, before))
            before += total
            owners, held, sizes, total = [], [], [], 0

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in column_slices(batch.column(1)):
                found, counts = tool.encode(texts, int(end_id))
                for i, (n, to) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True), at):
                    if sizes and total + n > shard_tokens:
                        close()
                    owners.append(ids[i])
                    held.append(found[to - n : to])
                    sizes.append(n)
                    total += n
        if sizes:
            close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=["part", "shard", "path", "n_docs", "n_tokens", "before"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(giving_back(write), "part int, shard int, path string, n_docs long, n_tokens long, before long"), "token-manifest")


def read_token_shards(spark: SparkSession, manifest: DataFrame, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of the shards: id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, the ids.

    What the driver gathers is one number for each partition that wrote shards.
    """
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, sofar = {}, 0
    for part in sorted(totals):
        base[part] = sofar
        sofar += totals[part]

    def read(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with input_stream(path) as source:
                    shard = Shard(source.read())
                at = 0
                while at < shard.n_docs:  # some documents at a time, decoded from where they start
                    end = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + (1 << 19))))
                    low, high = shard.span(at)[0], shard.span(end - 1)[1]
                    ids = np.ascontiguousarray(shard.tokens(low, high), "<u4")
                    spans = [shard.span(i) for i in range(at, end)]
                    own = [ids[a - low : b - low] for a, b in spans]
                    columns = [pa.array(shard.doc_ids[at:end], pa.int64()), pa.array([base[part] + before + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = [id_col, "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    at = end

    files = manifest.select("part", "path", "before")
    out = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.repartition(max(1, files.count())).mapInArrow(giving_back(read), out)


def token_output(docs: DataFrame, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Write ``docs`` as token shards to the shared folder and read them back. An empty table gives no rows."""
    spark = docs.sparkSession
    manifest = write_token_shards(docs, new_folder(spark, "tokens"), tokenizer, end_id=end_id, id_col=id_col, text_col=text_col)
    return read_token_shards(spark, manifest, id_col=id_col, with_ids=with_ids)

"""Token counts without ids: byte-pair merging by a heap over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back
from litquarry.llm.tokens import BYTE_SYMBOLS, CACHE_PIECES, LONG_PIECE, byte_pieces, slices

#: The pattern by which byte-level tokenizers cut text before merging; blanks are Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class MergeCounter:
    """Counts tokens of byte-level BPE from a tokenizers file; no ids come out."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"] or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is no byte-level BPE tokenizer without normalizer")
        number = {s: i for i, s in enumerate(BYTE_SYMBOLS)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = number.setdefault(left + right, len(number))
            self.ranks.setdefault((number[left], number[right]), (rank, made))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {"": 0}
        self.words: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Initial symbols minus merges: pop the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return n
        symbol: list[int] = list(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[pair], i, *pair) for i, pair in enumerate(zip(data, data[1:])) if pair in ranks]  # noqa: B905
        heapq.heapify(heap)
        count = n
        while heap:
            _, made, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbol[i] != left or symbol[j] != right:
                continue  # one of them has merged since
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (found := ranks.get((made, symbol[k]))) is not None:
                    heapq.heappush(heap, (*found, i, made, symbol[k]))
            if (k := before[i]) >= 0 and (found := ranks.get((symbol[k], made))) is not None:
                heapq.heappush(heap, (*found, k, symbol[k], made))
        return count

    def piece(self, piece: str) -> int:
        total, words = 0, self.words
        if self.special and (held := self.special.findall(piece)):
            return len(held) + sum(map(self.piece, self.special.split(piece)))
        for word in self.find(piece):
            if (n := words.get(word)) is None:
                n = self.merged(word.encode())
                if len(word) <= LONG_PIECE:
                    words[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        known, total = self.known, 0
        for p in byte_pieces(text):
            n = known.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) <= LONG_PIECE:
                    known[p] = n
            total += n
        if len(known) > CACHE_PIECES or len(self.words) > CACHE_PIECES:
            known.clear()
            self.words.clear()
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The worker's counter for a tokenizers file; what it has counted outlives the task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8) and ``n_tokens`` that the tokenizers file ``tokenizer`` gives the whole text.

    A special token's string inside a text is one token, as the library has it. Null text is empty: 0 bytes,
    0 tokens. Repeated rows are answered each, null ids stay null, other columns are ignored. Nothing is
    shuffled; a worker remembers a bounded number of distinct words, so that a text of any length takes memory
    for itself only.
    """

    def counted(batches) -> Iterator:
        import pyarrow as pa

        tool = counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_tokens: list[int] = []
            for _, part in slices(texts.to_pylist()):
                n_tokens += map(tool.count, part)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n_tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(giving_back(counted), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")

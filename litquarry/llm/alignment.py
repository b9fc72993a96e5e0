"""Alignment of two tokenizers' tokens over the same bytes.

A part of an Arrow batch is one run of bytes: texts stand one after the other, and tokens of both tokenizers are given by
their ends in it. Ends are counted once per byte for A and for B. Where both end, a group ends; where either ends, one
overlapping pair of tokens ends, so that pairs are as many as distinct ends. Prefix sums over bytes turn these marks into
the number of the token, group and pair at any place, and their differences at the documents' borders into results of
each document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from litquarry.llm.common import Workspace, giving_back
from litquarry.llm.tokens import byte_pieces_whole, slices

#: Distinct pieces, and their tokens, that a worker remembers before it starts again.
MOST_PIECES = 500_000
#: Characters of the texts that are aligned as one run of bytes, and of those that share one table of pairs.
PART = 2 << 20
TABLE = 24 << 20
#: Pairs of one table in one row.
ROW = 1 << 16


class PairedTokens:
    """Ids and byte lengths of both tokenizers' tokens for pieces of text, kept in growing arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a_ids = 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
        self.a_length = np.zeros(self.a_ids, np.int32)
        for token, i in spec["model"]["vocab"].items():
            self.a_length[i] = len(token)  # one character of the vocabulary stands for one byte
        self.b_ids = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.b_ids)]
        self.b_length = np.array([1 if self.b.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(names)], np.int32)
        a, b = range(self.a_ids), range(self.b_ids)
        widest = len(str(max(self.a_ids, self.b_ids))) + 1
        #: What stands for a token in a group's text, with the mark after it: A before A, A before B; B before B, B before A, B at the end.
        self.shown = np.array([f"{i}{mark}".encode() for ids, marks in ((a, ",|"), (b, (",", ";", ""))) for mark in marks for i in ids], f"S{widest}")
        self.forget()

    def forget(self) -> None:
        """Only the empty piece, without tokens, is known from the start."""
        self.number: dict[str, int] = {"": 0}
        self.a_flat = self.b_flat = np.zeros(0, np.int64)
        self.a_first = self.b_first = np.zeros(2, np.int64)
        self.whole = np.ones(1, bool)

    def _b(self, pieces: list[str]) -> list[list[int]]:
        """B puts a blank before a text: a piece's own first blank is left to it, and one without is led by a line feed, which is a token of its own."""
        found = self.b.encode([p[1:] if p[0] == " " and p[1:] else "\n" + p for p in pieces], num_threads=1)
        return [ids if p[0] == " " and p[1:] else ids[2:] for p, ids in zip(pieces, found, strict=True)]

    def learn(self, pieces: list[str]) -> None:
        at = len(self.whole)
        a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self._b(pieces)
        flat = lambda lists: np.fromiter((i for x in lists for i in x), np.int64)
        ends = lambda lists: np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        size = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        new_a, new_b, a_end, b_end = flat(a), flat(b), ends(a), ends(b)
        sums = lambda length, ids, end: np.diff(np.concatenate(([0], np.cumsum(length[ids])))[np.concatenate(([0], end))])
        whole = (sums(self.a_length, new_a, a_end) == size) & (sums(self.b_length, new_b, b_end) == size)
        self.a_first = np.concatenate((self.a_first, self.a_first[-1] + a_end))
        self.b_first = np.concatenate((self.b_first, self.b_first[-1] + b_end))
        self.a_flat, self.b_flat = np.concatenate((self.a_flat, new_a)), np.concatenate((self.b_flat, new_b))
        self.whole = np.concatenate((self.whole, whole))
        self.number.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pieces."""
        parts = [byte_pieces_whole(t) for t in texts]
        new = set().union(*parts).difference(self.number)
        if len(self.number) + len(new) > MOST_PIECES or len(self.a_flat) > 8 * MOST_PIECES:
            self.forget()
            new = set().union(*parts) - {""}
        if new:
            self.learn(sorted(new))
        get = self.number.__getitem__
        return [np.fromiter(map(get, p), np.int64, len(p)) for p in parts]


def _spread(first: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where the entries of ``numbers`` stand in a flat array whose runs begin at ``first``."""
    count = first[numbers + 1] - first[numbers]
    ends = np.cumsum(count)
    return np.repeat(first[numbers] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Part:
    """The alignment of some texts: per text the counts and the groups' hash, and of all pairs of tokens their codes, text by text."""

    def __init__(self, tool: PairedTokens, texts: list[str]):
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(len(texts), np.int64) for _ in range(4))
        self.sha = [""] * len(texts)
        numbers = tool.numbers([" " + t for t in texts])
        held = [k for k, t in enumerate(texts) if t and tool.whole[numbers[k]].all()]
        if not held:
            self.codes = np.zeros(0, np.int64)
            return
        pieces = np.concatenate([numbers[k] for k in held])
        a, b = tool.a_flat[_spread(tool.a_first, pieces)], tool.b_flat[_spread(tool.b_first, pieces)]
        a_end, b_end = np.cumsum(tool.a_length[a], dtype=np.int64), np.cumsum(tool.b_length[b], dtype=np.int64)
        size = int(a_end[-1]) + 1
        is_a, is_b = np.bincount(a_end, minlength=size).astype(np.int32), np.bincount(b_end, minlength=size).astype(np.int32)
        # prefix sums over bytes: how many tokens, groups and pairs have ended at each place
        a_done, b_done, groups, links = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(is_a & is_b), np.cumsum(is_a | is_b)
        border = np.concatenate(([0], np.cumsum([len(texts[k].encode()) + 1 for k in held])))
        per = lambda done: np.diff(done[border])
        self.n_a[held], self.n_b[held], self.n_groups[held], self.n_links[held] = per(a_done), per(b_done), per(groups), per(links)
        end = np.flatnonzero(is_a | is_b)
        self.codes = a[a_done[end] - is_a[end]] * tool.b_ids + b[b_done[end] - is_b[end]]
        self._show(tool, held, a, b, a_end, b_end, is_a & is_b, groups, border)

    def _show(self, tool: PairedTokens, held: list[int], a, b, a_end, b_end, both, groups, border) -> None:
        """Hash each document's groups: all tokens with the mark behind each, as rows of bytes of one width, put in order."""
        a_group, b_group = groups[a_end] - both[a_end], groups[b_end] - both[b_end]
        total = int(groups[-1])
        a_upto, b_upto = np.cumsum(np.bincount(a_group, minlength=total)), np.cumsum(np.bincount(b_group, minlength=total))
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + b_upto[a_group] - np.bincount(b_group, minlength=total)[a_group]] = a + both[a_end] * tool.a_ids
        behind = both.astype(np.int64)
        behind[border] = 2
        shown[np.arange(len(b)) + a_upto[b_group]] = b + 2 * tool.a_ids + behind[b_end] * tool.b_ids
        rows, at = tool.shown[shown], 0
        for k in held:
            n = int(self.n_a[k] + self.n_b[k])
            self.sha[k] = hashlib.sha256(rows[at : at + n].tobytes().translate(None, b"\0")).hexdigest()
            at += n


_TOOLS: dict[tuple[str, str], PairedTokens] = {}


def paired(path_a: str, path_b: str) -> PairedTokens:
    """The worker's pair of tokenizers; what it has learnt outlives the task."""
    if (path_a, path_b) not in _TOOLS:
        _TOOLS[path_a, path_b] = PairedTokens(path_a, path_b)
    return _TOOLS[path_a, path_b]


class PairTable:
    """The distinct pairs of some texts, numbered as they come, and how often each came."""

    def __init__(self, name: str):
        self.name, self.chars = name, 0
        self.codes = self.order = self.counts = np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> np.ndarray:
        """The number of each pair."""
        found, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.codes, found)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == found[known]
        number = np.empty(len(found), np.int64)
        number[known] = self.order[at[known]]
        number[~known] = len(self.codes) + np.arange(len(found) - known.sum())
        total = np.zeros(len(self.codes) + int((~known).sum()), np.int64)
        total[: len(self.counts)] = self.counts
        total[number] += counts
        self.codes, self.order = np.insert(self.codes, at[~known], found[~known]), np.insert(self.order, at[~known], number[~known])
        self.counts = total
        return number[inverse]

    def rows(self) -> Iterator[tuple]:
        codes = np.empty(len(self.codes), np.int64)
        codes[self.order] = self.codes
        for k in range(0, len(codes), ROW):
            yield k, codes[k : k + ROW], self.counts[k : k + ROW]


def _aligned(docs: DataFrame, path_a: str, path_b: str, id_type: DataType) -> DataFrame:
    """Rows of two kinds: of a text its counts, hash and pair numbers; of a table some of its pairs and their counts."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        tool, table = paired(path_a, path_b), PairTable(f"{task}-0")
        kinds = [None, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["id", "table", "n_a", "n_b", "n_groups", "n_links", "sha", "links", "first", "codes", "counts"]

        def batch(ids, size, given: dict) -> pa.RecordBatch:
            columns = [ids, *[pa.array(given[n], k) if n in given else pa.nulls(size, k) for n, k in zip(names[1:], kinds[1:], strict=True)]]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def pairs(kind) -> Iterator:
            for first, codes, counts in table.rows():
                yield batch(pa.nulls(1, kind), 1, {"table": [table.name], "first": [first], "codes": [codes], "counts": [counts]})

        kind = None
        for given in batches:
            ids, kind = given.column(0), given.column(0).type
            for at, texts in slices(given.column(1).to_pylist(), PART):
                part = Part(tool, texts)
                numbers = table.add(part.codes).astype("<u4")
                border = np.concatenate(([0], np.cumsum(part.n_links)))
                links = [numbers[x:y].tobytes() for x, y in zip(border, border[1:])]  # noqa: B905
                size = len(texts)
                columns = {"table": [table.name] * size, "n_a": part.n_a, "n_b": part.n_b, "n_groups": part.n_groups, "n_links": part.n_links, "sha": part.sha, "links": links}
                yield batch(ids.slice(at, size), size, columns)
                table.chars += sum(map(len, texts))
                if table.chars > TABLE:
                    yield from pairs(kind)
                    made += 1
                    table = PairTable(f"{task}-{made}")
        if kind is not None:
            yield from pairs(kind)

    rows = docs.select("id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = id_type.simpleString()
    return rows.mapInArrow(giving_back(run), f"id {kind}, table string, n_a long, n_b long, n_groups long, n_links long, sha string, links binary, first long, codes array<long>, counts array<long>")


def alignment(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", pairs_to: str | None = None) -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A is a byte-level BPE of the tokenizers library, applied to a blank and the text; B is a sentencepiece model, which
    puts the blank there itself. Special tokens' strings are plain text for both. A link is a pair of tokens whose bytes
    overlap. The count of a pair of ids is how many links of all rows hold it; ``n_best`` counts a row's links whose
    count is the highest of their B id, ties included, and ``count_sum`` adds up the counts of its links. With
    ``pairs_to`` the counts (a, b, count, best) are written there as a table.

    Each task numbers the pairs of about 24 million characters in a table of its own; only such tables' distinct pairs
    are shuffled, summed and joined with the sums, and a table's answers meet its rows again by its name.

    Null and empty texts, and texts whose tokens do not spell them (such with U+2581), have no tokens: zeros and an empty
    hash. Rows that repeat are answered and counted each; null ids stay null. A text of any length is aligned at once in
    one task. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "alignment")
    id_type = docs.schema[id_col].dataType
    aligned = work.written(_aligned(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), path_a, path_b, id_type), "aligned")
    b_ids = paired(path_a, path_b).b_ids
    pairs = aligned.where("codes is not null").select("table", "first", F.posexplode(F.arrays_zip("codes", "counts")).alias("at", "x"))
    pairs = pairs.select("table", (F.col("first") + F.col("at")).alias("number"), F.col("x.codes").alias("code"), F.col("x.counts").alias("n"))
    counts = work.written(pairs.groupBy("code").agg(F.sum("n").alias("count")).withColumn("b", F.col("code") % b_ids), "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "b").select("code", "count", "b", (F.col("count") == F.col("highest")).alias("best"))
    if pairs_to:
        known.select(F.floor(F.col("code") / b_ids).cast("int").alias("a"), F.col("b").cast("int"), "count", "best").write.parquet(pairs_to)
    # the sign of a count says whether it is the highest of its B id
    signed = F.when(F.col("best"), F.col("count")).otherwise(-F.col("count")).alias("signed")
    answers = pairs.select(F.col("table").alias("of"), "number", "code").join(known.select("code", "count", "best"), "code").select("of", "number", signed)
    texts = aligned.where("codes is null").drop("first", "codes", "counts")

    def answered(rows, found):
        import pyarrow as pa

        value = np.zeros(len(found), np.int64)
        value[found["number"].to_numpy()] = found["signed"].to_numpy()
        best, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, links in enumerate(rows["links"]):
            mine = value[np.frombuffer(links.as_buffer(), "<u4")]
            best[k], count[k] = (mine > 0).sum(), np.abs(mine).sum()
        return rows.drop_columns(["table", "links"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(count))

    answer = f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long"
    found = texts.groupBy("table").cogroup(answers.groupBy("of")).applyInArrow(answered, answer)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))

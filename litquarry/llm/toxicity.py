"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two strings sums over common subsequences of letters, each weighted by decay to the power of its spans,
which are bounded: letters may be left out or put in between. A text is judged by its words (and by letters that stand
apart, joined): its margin is the largest one of any of them. With landmarks fixed, the machine's margin is a sum over
a string's subsequences, so that one table of weights is all that a task needs to score whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, written
from litquarry.llm.tokens import slices

#: Letters of a subsequence, the longest span that it may have, and the weight of each place that it spans.
ORDER, SPAN, DECAY = 3, 6, 0.6
#: Longer strings are judged in overlapping parts of so many letters.
PART = 16
#: Distinct words that a worker remembers the margins of.
MOST_WORDS = 600_000

#: Lengths of the beginnings of words that are counted: words that are inflected share them.
BEGINNINGS = (4, 5, 6)

_CODES = 64
_PATTERNS = [(0, *rest) for span in range(ORDER, SPAN + 1) for rest in (x for x in combinations(range(1, span), ORDER - 1) if x[-1] == span - 1)]
_NOT_LETTERS = re.compile(r"[\W_]+")
_APART = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")


def parts_of(word: str) -> list[str]:
    """A word's letters and digits in lower case, cut into overlapping parts if they are many."""
    letters = _NOT_LETTERS.sub("", word.lower())
    if len(letters) <= PART:
        return [letters] if len(letters) >= ORDER else []
    return [letters[i : i + PART] for i in range(0, len(letters) - PART // 2, PART // 2)]


def words_of(text: str) -> set[str]:
    """The words of a text, and each run of single characters joined to one."""
    words = set(text.split())
    words.update("".join(x.split()) for x in _APART.findall(text))
    return words


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, value): the kernel's explicit features of some strings, each string's of length one."""
    n = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.int64)
    letters = (flat >= 97) & (flat <= 122)
    digits = (flat >= 48) & (flat <= 57)
    code = np.where(letters, flat - 96, np.where(digits, flat - 48 + 27, 37 + flat % 27))
    owner = np.repeat(np.arange(n), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    keys, values = [], []
    for pattern in _PATTERNS:
        at = np.flatnonzero(left > pattern[-1])
        key = owner[at]
        for step in pattern:
            key = key * _CODES + code[at + step]
        keys.append(key)
        values.append(np.full(len(at), DECAY ** (pattern[-1] + 1)))
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(where, np.concatenate(values), minlength=len(key))
    owner, gram = key // _CODES**ORDER, key % _CODES**ORDER
    norm = np.sqrt(np.bincount(owner, value**2, minlength=n))
    return owner, gram, value / norm[owner]


def _dense(strings: list[str], columns: np.ndarray) -> np.ndarray:
    """Kernel features of strings as rows over the subsequences ``columns`` (sorted)."""
    owner, gram, value = features(strings)
    at = np.minimum(np.searchsorted(columns, gram), len(columns) - 1)
    hit = columns[at] == gram
    out = np.zeros((len(strings), len(columns)))
    out[owner[hit], at[hit]] = value[hit]
    return out


class StringKernelMachine:
    """A table of weights by subsequence, an offset, and the scale that turns margins into scores."""

    def __init__(self, weights: np.ndarray, offset: float, scale: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.offset, self.scale = weights.astype(np.float32), offset, scale
        self.known: dict[str, float] = {}

    @classmethod
    def fit(cls, strings: list[str], labels: np.ndarray, landmarks: list[str], *, cost: float = 5.0, steps: int = 30) -> StringKernelMachine:
        """Squared-hinge SVM by Newton steps on the Nyström features of the landmarks; classes weigh the same."""
        columns = np.unique(features(landmarks)[1])
        marks = _dense(landmarks, columns)
        values, vectors = np.linalg.eigh(marks @ marks.T + 1e-6 * np.eye(len(marks)))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
        x = _dense(strings, columns) @ marks.T @ whiten
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        y = np.where(labels > 0, 1.0, -1.0)
        each = cost * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
        keep = np.eye(x.shape[1])
        keep[-1, -1] = 1e-6
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            out = 1 - y * (x @ w)
            on = out > 0
            if not on.any():
                break
            pull = each[on, None] * x[on]
            step = np.linalg.solve(keep + 2 * pull.T @ x[on], keep @ w - 2 * pull.T @ (y[on] * out[on]))
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        table = np.zeros(_CODES**ORDER)
        table[columns] = marks.T @ (whiten @ w[:-1])
        return cls(table, float(w[-1]))

    def margins(self, strings: list[str]) -> np.ndarray:
        """Margins of strings of letters."""
        if not strings:
            return np.zeros(0)
        owner, gram, value = features(strings)
        return np.bincount(owner, value * self.weights[gram], minlength=len(strings)) + self.offset

    def text_margins(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """The largest margin of any word of each text and that word; the offset and '' for texts without words."""
        words = [words_of(t) for t in texts]
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > MOST_WORDS:
            self.known.clear()
            new = list(set().union(*words))
        for some in (new[i : i + 4096] for i in range(0, len(new), 4096)):
            cut = [parts_of(w) for w in some]
            margins = self.margins([p for x in cut for p in x])
            at = 0
            for w, x in zip(some, cut, strict=True):
                self.known[w] = float(margins[at : at + len(x)].max()) if x else self.offset
                at += len(x)
        top = [max(x, key=self.known.__getitem__, default="") for x in words]
        found = np.array([self.known[w] if w else self.offset for w in top])
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return np.maximum(found, self.offset), top

    def scores(self, margins: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))


def logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift by which margins give probabilities: logistic regression with smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, label), written: at most ``most`` labelled documents, those with the least hashes of their ids."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return written(rows.join(F.broadcast(chosen), "id"), "toxicity-labelled")


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(part, whole, toxic, clean): in how many labelled documents of either kind a part of a word, or its beginning, stands."""

    def parts(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {p for w in words_of(text) for p in parts_of(w)}
                rows += [(p, True, label) for p in own]
                rows += [(p, False, label) for p in {p[:k] for p in own for k in BEGINNINGS if len(p) >= k}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int32()), strict=True)], names=["part", "whole", "label"])

    found = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(giving_back(parts), "part string, whole boolean, label int")
    return found.groupBy("part", "whole").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def _first_words(counts: DataFrame, n1: int, n: int, most: int) -> tuple[list[str], list[str], list[str]]:
    """Words that toxic documents differ by, those of them that stand out alone, and words of clean documents."""
    expected = (F.col("toxic") + F.col("clean")) * (n1 / n)
    z = (F.col("toxic") - expected) / F.sqrt(expected + 0.5)
    odds = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / (n - n1))
    scored = counts.withColumn("z", z).withColumn("odds", odds)
    tell = scored.where("z > 5 AND toxic >= 5 AND odds > 2").orderBy(F.desc("z"), "part", "whole").limit(5000)
    tell = tell.select("part", "whole", "z").collect()
    strong = [r["part"] for r in tell if r["whole"] and r["z"] >= 0.25 * tell[0]["z"]]
    marks = [r["part"] for r in tell]
    begun = F.col("part").isin(marks or [""])
    for k in BEGINNINGS:
        begun = begun | F.substring("part", 1, k).isin([m for m in marks if len(m) == k] or [""])
    words = scored.where(F.col("whole") & (F.col("toxic") >= 1) & (F.col("clean") <= 0.05 * F.col("toxic")) & begun)
    good = [r["part"] for r in words.orderBy(F.desc("toxic"), "part").limit(most).collect()]
    clean = scored.where(F.col("whole") & (F.col("odds") < 0.5))
    often = clean.orderBy(F.desc("clean"), "part").limit(most // 2).collect()
    random = clean.orderBy(F.xxhash64("part"), "part").limit(most).collect()
    return good, strong, sorted({r["part"] for r in often + random}.difference(good))


def _gapped(word: str) -> list[str]:
    """A word with a letter doubled, and with another one put in its middle."""
    half = len(word) // 2
    return [word[:2] + word[1] + word[2:], word[:half] + "x" + word[half:]]


def _witnesses(labelled: DataFrame, machine: StringKernelMachine) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Margin, label and most toxic word of every labelled document (of which there are a bounded number)."""
    got = score_texts(labelled, machine, id_col="id", text_col="text").join(labelled.select("id", "label").distinct(), "id").select("margin", "label", "word").collect()
    return np.array([r["margin"] for r in got]), np.array([r["label"] for r in got]), [r["word"] for r in got]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 12_000, most_words: int = 2_000, landmarks: int = 64, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> StringKernelMachine:
    """Learn from at most ``most_labelled`` documents that aren't held out.

    Only texts are told apart: the words by which toxic documents differ are positive at first, frequent and random
    words of clean ones negative, up to ``most_words`` each. Then, in each round, the most toxic word of every
    document stands for it, as in multi-instance learning: clean documents give the negatives that the machine still
    gets wrong. Without labels of both kinds every score is the share of toxic labels.
    """
    labelled = _labelled(docs, labels, most_labelled, id_col, text_col, label_col)
    shares = labelled.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    n1, n = shares["toxic"] or 0, shares["n"]
    if not n1 or n1 == n:
        share = n1 / n if n else 0.0
        return StringKernelMachine(np.zeros(_CODES**ORDER), 0.0, (0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9)))))
    counts = written(_word_counts(labelled), "toxicity-words")
    good, strong, bad = _first_words(counts, n1, n, most_words)
    if not good:
        return StringKernelMachine(np.zeros(_CODES**ORDER), 0.0, (0.0, float(np.log(n1 / (n - n1)))))
    spread = lambda strings, k: [strings[int(i * len(strings) / k)] for i in range(k)] if len(strings) > k else list(strings)
    marks = [*good[: landmarks // 4], *spread(good, landmarks // 4), *spread(bad, landmarks // 2)]
    hard: set[str] = set()
    for left in range(rounds, -1, -1):
        gapped = sorted({v for w in strong for v in _gapped(w) if len(w) > ORDER}.difference(bad, good))
        marks = [m for m in dict.fromkeys(marks) if m in {*good, *bad}]
        machine = StringKernelMachine.fit([*good, *gapped, *bad], np.array([1] * (len(good) + len(gapped)) + [0] * len(bad)), marks)
        if left:
            margins, toxic, words = _witnesses(labelled, machine)
            hard = {p for m, y, w in zip(margins, toxic, words, strict=True) if y <= 0 and m > -0.7 for p in parts_of(w)}
            seen = {p for m, y, w in zip(margins, toxic, words, strict=True) if y > 0 and m > 0 for p in parts_of(w)}
            good = sorted(seen.union(strong).difference(hard)) or good
            bad = sorted({*bad, *hard}.difference(good))
            marks += [*strong, *spread(good, landmarks // 4), *spread(sorted(hard), landmarks // 4)]
    margins, toxic, _ = _witnesses(labelled, machine)
    alone = machine.margins(sorted({*good, *strong}))  # a document may hold just one such word
    machine.scale = logistic(np.concatenate([margins, alone]), np.concatenate([toxic, np.ones(len(alone))]))
    return machine


_TOOLS: dict[int, StringKernelMachine] = {}


def score_texts(docs: DataFrame, machine: StringKernelMachine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, margin, score, word): of whole texts, with the word that decides. Null text is empty; ids may be null."""
    weights, offset, scale = machine.weights, machine.offset, machine.scale
    on = np.flatnonzero(weights)
    weights = weights[on]
    key = hash((weights.tobytes(), offset, scale))

    def score(batches) -> Iterator:
        import pyarrow as pa

        if key not in _TOOLS:
            _TOOLS.clear()
            table = np.zeros(_CODES**ORDER)
            table[on] = weights
            _TOOLS[key] = StringKernelMachine(table, offset, scale)
        tool = _TOOLS[key]
        for batch in batches:
            ids = batch.column(0)
            for at, texts in slices(batch.column(1).to_pylist()):
                margins, top = tool.text_margins(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(margins), pa.array(tool.scores(margins)), pa.array(top, pa.string())], names=[id_col, "margin", "score", "word"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(score), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, margin double, score double, word string")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **fitting) -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 at ``threshold`` or more) and the deciding ``word``.

    Empty and null texts have the score of a text without words. Rows with a null id are scored and not held out;
    repeated rows are answered each; labels, languages and sources are no inputs of a score.
    """
    machine = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **fitting)
    found = score_texts(docs, machine, id_col=id_col, text_col=text_col)
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "word")

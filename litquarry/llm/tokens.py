"""Token ids of public tokenizers inside tasks.

Texts are cut where no tokenizer's piece can reach across, and each distinct piece is encoded once per worker:
the ids of the whole text are the ids of its pieces, one after the other.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from contextlib import suppress
from itertools import chain, repeat

import numpy as np

#: Pieces that a worker remembers; when there are more, it starts again. About 250 bytes each.
CACHE_PIECES = 1_000_000
#: Longer pieces are encoded but not remembered.
LONG_PIECE = 64

_TWO_BLANKS = re.compile(r"\s\s")
_CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


#: A full stop or comma before a blank that follows no letter or digit, and so may be part of a longer token.
_JOINED_STOP = re.compile(r"[\W_][.,][ \n]")
#: Latin-1 letters before a run of ASCII marks without apostrophes: two tokens or more.
_MARKED = re.compile(r"(.*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)


def _stops_cut(text: str) -> str:
    """Cut, by NUL, around full stops and commas that end words, so that a word is the same piece before one or not."""
    if text[:1] in (".", ",") or _JOINED_STOP.search(text):
        return text
    return text.replace(". ", "\0. ").replace(", ", "\0, ").replace(".\n", "\0.\n").replace(",\n", "\0,\n")


def byte_pieces(text: str) -> list[str]:
    """Cuts for byte-level BPE: before a single space or line feed between two other characters, and after such a line feed.

    There the pretokenizer always starts a new token: a run of blanks of length one can only be a token of its
    own or lead the next one, and nothing looks back across it.
    """
    if "\0" in text or _TWO_BLANKS.search(text):
        return _CUTS.split(text)
    return _stops_cut(text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def byte_pieces_whole(text: str) -> list[str]:
    """The cuts of ``byte_pieces`` but for those around stops, so that tokenizers which join stops to words can have the pieces too."""
    if "\0" in text or _TWO_BLANKS.search(text):
        return _CUTS.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def word_pieces(text: str) -> list[str]:
    """Cuts for tokenizers that lower case and drop white space: at every space and line feed.

    Latin-1 text has nothing to compose, so that A-Z can be lowered first, unless that could spell a special token.
    """
    if "<|" not in text:
        with suppress(UnicodeEncodeError):
            text = text.encode("latin-1").lower().decode("latin-1")
            if "\0" not in text:
                return _stops_cut(text).replace("\n", "\0").replace(" ", "\0").split("\0")
    return text.replace("\n", " ").split(" ")


def _symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


BYTE_SYMBOLS = _symbols()


class PieceEncoder:
    """Little-endian 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, cut: Callable[[str], list[str]]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.known = Tokenizer.from_file(path), cut, {"": b""}
        self.words, self.lower = self.tokenizer.model, self.tokenizer.normalizer is not None

    def _word(self, piece: str) -> bytes | None:
        """The ids of one word of Latin-1 letters, led by a space or not: that is one merge unit, so the model alone sees it."""
        word = piece[1:] if piece[0] == " " else piece
        if not word.isalpha() or len(word) > LONG_PIECE or not (word.isascii() or max(word) < "\u0100"):
            return None
        if self.lower:
            piece = word.lower()
        if piece.isascii():
            piece = piece.replace(" ", BYTE_SYMBOLS[32])
        else:
            piece = "".join([BYTE_SYMBOLS[b] for b in piece.encode()])
        return array("I", [t.id for t in self.words.tokenize(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, known = self.cut, self.known
        parts = [cut(t) for t in texts]
        new = list(set().union(*parts).difference(known))
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            known[""] = b""
            new = list(set().union(*parts).difference(known))
        marked = {p: m.groups() for p in new if "<|" not in p and (m := _MARKED.fullmatch(p))}
        plain = list({*new, *chain.from_iterable(marked.values())}.difference(marked, known))
        other = []
        for p in plain:
            ids = self._word(p)
            if ids is None:
                other.append(p)
            else:
                known[p] = ids
        for at in range(0, len(other), 20_000):
            some = other[at : at + 20_000]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[piece] = array("I", found.ids).tobytes()
        for p, (word, marks) in marked.items():
            known[p] = known[word] + known[marks]
        get = known.__getitem__
        out = [b"".join(map(get, x)) for x in parts]
        for p in {*new, *plain}:
            if len(p) > LONG_PIECE:
                del known[p]
        return out


#: Classes of bytes: of characters that are not white space (but for those of _WHITE_LEADS), the first of white space beyond
#: ASCII, the last of ASCII letters and digits, the second of Latin-1 letters (after C3), ASCII marks without apostrophes.
_DARK, _MAY_BE_WHITE, _WORD_END, _LETTER_END, _MARK, _BLANK = (1 << k for k in range(6))
_WHITE_LEADS = {0xC2: (0x85, 0xA0), 0xE1: (0x9A, 0xA0), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def _byte_classes() -> bytes:
    kinds = {
        _DARK: [*range(0x21, 0x7F), *range(0x80, 0x100)],
        _MAY_BE_WHITE: [*_WHITE_LEADS],
        _WORD_END: b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        _LETTER_END: {*range(0x80, 0xC0)} - {0x97, 0xB7},
        _MARK: b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~",
        _BLANK: b" \n",
    }
    return bytes(sum(kind for kind, held in kinds.items() if b in held) for b in range(256))


_CLASSES = _byte_classes()


def byte_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, dark) of pieces for byte-level BPE: ``data`` is UTF-8 of texts that begin at ``offsets``.

    As in ``byte_pieces``, a piece begins before a single space or line feed between two other characters, and after such a
    line feed. One also begins at an ASCII mark that follows a letter of Latin-1 or an ASCII digit, where no token reaches
    across, unless the word holds what could be a special token. ``dark`` tells which bytes surely are of no white space.
    """
    kinds = np.frombuffer(data.tobytes().translate(_CLASSES), np.uint8)
    dark = (kinds & _DARK).view(bool)
    lead = np.flatnonzero(kinds & _MAY_BE_WHITE)
    if len(lead):
        follow = data[np.minimum(lead + 1, len(data) - 1)]
        white = np.zeros(len(lead), bool)
        for first, seconds in _WHITE_LEADS.items():
            white |= (data[lead] == first) & np.isin(follow, seconds)
        for k in range(3):
            dark[np.minimum(lead[white] + k, len(data) - 1)] = False
    begins = np.zeros(len(data), bool)
    if len(data) > 2:
        np.logical_and(dark[:-2], dark[2:], out=begins[1:-1])
        begins[1:-1] &= (kinds[1:-1] & _BLANK).astype(bool)
        feed = np.flatnonzero(begins & (data == 10))
        begins[feed + 1] = True
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    ends = kinds[:-1] & _WORD_END
    ends[1:] |= (data[:-2] == 0xC3) * (kinds[1:-1] & _LETTER_END)
    marks = np.flatnonzero(ends.astype(bool) & (kinds[1:] & _MARK).astype(bool)) + 1
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    if len(special):
        words = np.flatnonzero(begins)
        marks = marks[~np.isin(np.searchsorted(words, marks, side="right"), np.searchsorted(words, special, side="right"))]
    begins[marks] = True
    return np.flatnonzero(begins), dark


class ColumnEncoder:
    """Ids of the texts of an Arrow column by a byte-level BPE, as arrays; its tokens must spell the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # a character a byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = 0

    def _library(self, texts: list[bytes]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)

    def _encoded(self, pieces: list[bytes], spaced: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of distinct pieces, by the library.

        Pieces that begin with a single space (``spaced``) or with no blank (``plain``), and end with none, are encoded many
        at once: they stand one after the other as in a text, the latter led by a line feed.
        """
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(plain), np.flatnonzero(~(spaced | plain))])
        n_spaced, n_joined = int(spaced.sum()), int((spaced | plain).sum())
        joined, alone = [pieces[k] for k in order[:n_joined].tolist()], [pieces[k] for k in order[n_joined:].tolist()]
        texts = [b"".join(joined[k : min(k + 200, n_spaced)]) for k in range(0, n_spaced, 200)]
        texts += [b"\n" + b"\n".join(joined[k : k + 200]) for k in range(n_spaced, n_joined, 200)]
        ids = self._library(texts + alone)
        n_bytes = np.fromiter(map(len, joined + alone), np.int64)
        led = np.zeros(len(order), np.int64)
        led[n_spaced:n_joined] = 1
        end = np.cumsum(n_bytes + led)
        at = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        first, last = np.searchsorted(at, end - n_bytes), np.searchsorted(at, end)
        if at[-1] != (end[-1] if len(end) else 0) or not (np.array_equal(at[first], end - n_bytes) and np.array_equal(at[last], end)):
            raise ValueError("the tokens do not spell the pieces of the texts one by one")
        back = np.argsort(order)
        begin, size = first[back], (last - first)[back]
        return ids[spans(begin, size)], size

    def _codes(self, pieces: list[bytes], first: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, dark: np.ndarray) -> np.ndarray:
        """The places of distinct pieces in ``begin`` and ``size``; ``first`` is where each comes among all pieces of the data."""
        codes = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(codes < 0)
        if len(self.known) + len(new) > CACHE_PIECES:
            self._forget()
            codes, new = np.full(len(pieces), -1, np.int64), np.arange(len(pieces))
        if not len(new):
            return codes
        low, high = starts[first[new]], ends[first[new]]
        new = new[np.argsort(high - low > LONG_PIECE, kind="stable")]  # long ones last: they are not remembered
        low, high = starts[first[new]], ends[first[new]]
        closed = dark[high - 1]
        spaced = closed & (data[low] == 32) & (high - low > 1) & dark[np.minimum(low + 1, len(data) - 1)]
        own = [pieces[k] for k in new.tolist()]
        ids, size = self._encoded(own, spaced, closed & dark[low])
        at, n_short = len(self.known), int((high - low <= LONG_PIECE).sum())
        for name, have, more in (("ids", self.n_ids, ids), ("begin", at, self.n_ids + np.cumsum(size) - size), ("size", at, size)):
            held = getattr(self, name)
            if have + len(more) > len(held):
                held = np.concatenate([held[:have], np.zeros(have + 2 * len(more), held.dtype)])
                setattr(self, name, held)
            held[have : have + len(more)] = more
        codes[new] = np.arange(at, at + len(new))
        self.known.update(zip(own[:n_short], range(at, at + n_short)))
        self.n_ids += int(size[:n_short].sum())
        return codes

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of an Arrow column without nulls: of each text, and then ``end_id``."""
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts, dark = byte_cuts(data, offsets)
        bounds = np.append(starts, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        first = np.zeros(len(pieces.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        codes = self._codes(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), first, starts, bounds[1:], data, dark)[which]
        size = self.size[codes]
        before = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        counts = np.diff(before) + 1
        ids = np.full(int(before[-1]) + len(texts), end_id, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(counts) - 1] = False
        ids[inner] = self.ids[spans(self.begin[codes], size)]
        return ids, counts


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each ``begin`` on, ``size`` of them."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


_COLUMN_ENCODERS: dict[str, ColumnEncoder] = {}


def column_encoder(path: str) -> ColumnEncoder:
    """The worker's encoder of columns for a tokenizer file; it outlives the task."""
    if path not in _COLUMN_ENCODERS:
        _COLUMN_ENCODERS[path] = ColumnEncoder(path)
    return _COLUMN_ENCODERS[path]


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, cut: Callable[[str], list[str]]) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    key = (path, cut.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, cut)
    return _ENCODERS[key]


def slices(batch_texts: list[str | None], most: int = 4 << 20):
    """(from, texts) parts of a batch with a bounded number of characters, or a single longer text each; null is empty."""
    at = held = 0
    part: list[str] = []
    for i, t in enumerate(batch_texts):
        t = t or ""
        if part and held + len(t) > most:
            yield at, part
            at, part, held = i, [], 0
        part.append(t)
        held += len(t)
    if part:
        yield at, part


def column_slices(texts, most: int = 4 << 20):
    """(from, column) parts of an Arrow column with a bounded number of bytes, or a single longer text each."""
    import pyarrow.compute as pc

    end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to

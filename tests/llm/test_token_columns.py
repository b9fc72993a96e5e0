"""Ids of a column of texts against the library, and how often a shard's pairs are looked at."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\0", "a", "The", "naïve", "É", "×", "ß", "'s", "'", "it's", ".", ",", "!!", "$$$", "-", "_", "7", "24.66", "<|endoftext|>", "<|", "|>", "<", "|"]
ODD += [*map(chr, (0x1C, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0x1F600)), "日本", "キ", "я", "e\u0301", "x" * 90]


def library(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(PATH)
    return [[*tool.encode(t, add_special_tokens=False).ids, 9] for t in texts]


def test_column_of_odd_texts():
    from litquarry.llm.tokens import ColumnEncoder, column_slices

    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choices(ODD, k=rng.randint(1, 12))) for _ in range(4000)), *(" ".join(rng.choices(ODD, k=rng.randint(1, 12))) for _ in range(2000))]
    tool, found = ColumnEncoder(PATH), []
    for column in (pa.array(["left out", *texts]).slice(1), pa.array([], pa.string()), pa.array(["", ""]), pa.array(["Ü"], pa.large_string())):
        for at, part in column_slices(column, 3000):
            ids, counts = tool.encode(part, 9)
            assert len(counts) == len(part) and ids.dtype == np.uint32 and counts.sum() == len(ids)
            found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == library([*texts, "", "", "Ü"])


def test_a_full_memory_starts_again(monkeypatch):
    from litquarry.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    tool = tokens.ColumnEncoder(PATH)
    texts = [f"word{k} of {k % 7} and {k * k}." for k in range(300)]
    found = [tool.encode(pa.array([t]), 9)[0].tolist() for t in texts]
    assert found == library(texts) and len(tool.known) <= 40


def test_tokens_that_do_not_spell_the_text():
    from litquarry.llm.tokens import ColumnEncoder

    tool = ColumnEncoder(public_tokenizers.path("word_bpe_49k.json"))  # lower-cases and drops blanks
    with pytest.raises(ValueError, match="spell"):
        tool.encode(pa.array(["One two  three"]), 0)


def test_rare_pairs_are_not_counted_again(monkeypatch):
    """Before, every round counted the pairs of all symbols that were left: 15 rounds of at least 100,000 places."""
    from litquarry.llm.token_output import Grammar, repair

    rng = np.random.default_rng(4)
    copy = rng.integers(0, 9000, 2048)
    ids = np.concatenate([rng.integers(0, 30_000, 100_000), np.tile(copy, 40)]).astype(np.uint32)
    looked, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: looked.append(len(x)) or plain(x, *a, **k))
    symbols, rules = repair(ids, 30_000)
    assert len(looked) > 8 and sum(looked) < 3 * len(ids)
    assert np.array_equal(Grammar(30_000, rules).expand(symbols), ids)

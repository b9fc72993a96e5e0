"""Quality rules, alignment of tokenizers and Merkle manifest against brute force on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, copy long, bucket int, table string, number int, leaf string, place int, group string, words int, _words int, target int"
OTHER = (1, 2, 3, 4, "t", 5, "x", 6, "g", 7, 8, 9)


def corpus():
    rnd = random.Random(11)
    vocab = ["alpha", "Beta", "gamma,", "delta.", "été", "x", "straße", "日本", "it's", "end.", "0", "the", "of", "<0x41>", "<s>"]
    para = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    texts = [para(rnd.randint(0, 90)) for _ in range(40)] + [" ".join(f"w{k}{j}" for j in range(70)) for k in range(12)]
    texts += [" ".join(f"w{k}{j}###" for j in range(70)) for k in range(9)] + ["Er " * 60, "a b c " * 30, para(30) + "\n" + para(30)]
    texts += [None, "", "   ", "\n", "\n\n a\n", " lead", "tail ", "a  b   c", "word", para(4000), "same line\nother\nsame line\n\n \nsame line", "a▁b", "▁", "x\x00y \x00", "x\ty\r\nz\x0b", "a" * 3000]
    texts += ["<|endoftext|> a <|endoftext|>", "ümläut　x\x1cy é", "😀😀 ok", "<s> a </s> <unk>", "a|b $5 100% #1 *x* <y> &", "one two three one two three", "a b a b a b a", "﻿bom", "q  r"]
    rows = [(i, t, rnd.choice(["en", "de", None, "é", "z", ""]), rnd.choice(["s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[60], (7, "another text of a known id", "en", "s", 3), (None, para(60), "en", None, None), (None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *OTHER) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(values):
    return sorted(values, key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if often[x] > 1 for p in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark, docs, nothing, rows):
    import xxhash

    from litquarry.llm.quality_rules import UNIT, quality_rules

    buckets, prior = 512, 3.0
    labels = [(r[0], int("#" not in (r[1] or "")), "clash") for r in rows if r[0] is not None and r[0] % 3] + [(4, 0, "x"), (4, 1, "x"), (None, 1, "x")]
    got = quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"), buckets=buckets, prior=prior, least_words=20).collect()

    def grams(text):
        terms = re.findall(r"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~\x20\x09-\x0D]+", text or "")
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        one = [xxhash.xxh64(t.encode(), 42).intdigest() for t in terms]
        two = [xxhash.xxh64(b.encode(), h).intdigest() for h, b in zip(one, terms[1:])]  # noqa: B905
        return [signed(h) % buckets for h in one] + [buckets + signed(h) % buckets for h in two]

    marks = defaultdict(set)
    for i, q, _ in labels:
        marks[i].add(q)
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] is not None and marks.get(r[0]) == {1}:
            target.update(grams(r[1]))
    half = lambda c, h: sum(n for b, n in c.items() if b // buckets == h)
    weight = {b: round(math.log((target[b] + prior) / (n * half(target, b // buckets) / half(raw, b // buckets) + prior)) * UNIT) for b, n in raw.items()}
    want = []
    for r in rows:
        counts, found = base_counts(r[1]), grams(r[1])
        failed = counts[0] < 20 or 100 * counts[4] > 50 * counts[0]
        total = sum(weight[b] for b in found)
        want.append((r[0], *counts, failed, len(found), total / len(found) / UNIT if found else None, not failed and total >= -0.25 * UNIT * len(found)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "score", "kept"]
    rounded = lambda x: [round(v, 5) if isinstance(v, float) else v for v in x]
    assert key(rounded([r[n] for n in names]) for r in got) == key(map(rounded, want))
    kept = {r["doc_id"]: r["kept"] for r in got}
    junk = {r[0] for r in rows if r[1] and "0###" in r[1]}
    assert junk and not any(kept[i] for i in junk) and sum(kept.values()) > 20
    assert quality_rules(nothing, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    unlabelled = quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in unlabelled.collect()} <= {0.0, None}


def test_trusted_ids_are_bounded_and_agreed(spark):
    from litquarry.llm.quality_rules import trusted_ids

    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    found = [r[0] for r in trusted_ids(labels, most=20).collect()]
    assert len(found) == len(set(found)) == 20 and all(i % 2 and i != 1 for i in found)
    assert len(trusted_ids(labels, most=1000).collect()) == 49


def aligned_slowly(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from litquarry.llm.tokens import BYTE_SYMBOLS

    byte = {c: i for i, c in enumerate(BYTE_SYMBOLS)}
    of_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for t in texts:
        ta, tb = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        spelt = (" " + (t or "")).encode()
        if not t or b"".join(map(of_a, ta)) != spelt or b"".join(map(of_b, tb)) != spelt:
            out.append(([], [], [], ""))
            continue
        ends = lambda ids, of: [sum(len(of(i)) for i in ids[: k + 1]) for k in range(len(ids))]
        ea, eb = ends(ta, of_a), ends(tb, of_b)
        links = [(x, y) for x, e, s in zip(ta, ea, [0, *ea], strict=False) for y, f, u in zip(tb, eb, [0, *eb], strict=False) if s < f and u < e]
        cuts = sorted(set(ea) & set(eb))
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            part = lambda ids, at: ",".join(str(i) for i, e in zip(ids, at, strict=True) if low < e <= high)  # noqa: B023, E731
            groups.append(f"{part(ta, ea)}|{part(tb, eb)}")
        counts.update(links)
        out.append((ta, tb, links, ";".join(groups)))
    return out, counts


def test_alignment(spark, docs, nothing, rows, tmp_path):
    from litquarry.llm import alignment as module
    from litquarry.llm.alignment import alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    short = docs.where("coalesce(length(text), 0) < 10000")
    found, counts = aligned_slowly([r[1] for r in rows])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    want = [
        (r[0], len(ta), len(tb), groups.count(";") + bool(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for r, (ta, tb, links, groups) in zip(rows, found, strict=True)
    ]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment(short, *paths, pairs_to=str(tmp_path / "pairs")).select(names).collect()
    assert key(map(tuple, got)) == key(want)
    pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert pairs == {x: (n, n == highest[x[1]]) for x, n in counts.items()}
    long = alignment(docs, *paths).where("n_a > 4000").collect()
    assert len(long) == 1 and long[0]["n_links"] >= max(long[0]["n_a"], long[0]["n_b"])
    assert alignment(nothing, *paths).collect() == []
    assert module.ROW


def test_pair_table_numbers_pairs_as_they_come():
    import numpy as np

    from litquarry.llm.alignment import PairTable

    rng, table, given = np.random.default_rng(1), PairTable("t"), []
    numbers = []
    for _ in range(6):
        codes = rng.integers(0, 300_000, 50_000)
        given.append(codes)
        numbers.append(table.add(codes))
    codes, counts = np.concatenate([x[1] for x in table.rows()]), np.concatenate([x[2] for x in table.rows()])
    assert [x[0] for x in table.rows()] == [k * 65_536 for k in range(len(list(table.rows())))]
    assert np.array_equal(codes[np.concatenate(numbers)], np.concatenate(given))
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(given).tolist())


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folded_slowly(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof_slowly(levels, i):
    return [("", "") if i >> k ^ 1 >= len(n) else ("lr"[~(i >> k) & 1], n[i >> k ^ 1]) for k, n in enumerate(levels[:-1])]


def manifest_slowly(leaves):
    """{(group, id, leaf): [(subroot, root, steps)]} of (group, id, leaf)."""
    groups = defaultdict(list)
    for g, i, leaf in leaves:
        groups[g].append((i is not None, i or 0, leaf, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: folded_slowly([x[2] for x in sorted(groups[g])]) for g in order}
    top = folded_slowly([trees[g][-1][0] for g in order])
    out = defaultdict(list)
    for n, g in enumerate(order):
        for k, x in enumerate(sorted(groups[g])):
            steps = [*proof_slowly(trees[g], k), *proof_slowly(top, n)]
            out[g, x[3], x[2]].append((trees[g][-1][0], top[-1][0], ["".join(s) or "-" for s in steps]))
    return out


@pytest.mark.parametrize("partitions", [1, 12])
def test_merkle_manifest(spark, docs, nothing, rows, partitions):
    from litquarry.llm.merkle import folded, leaf_digest, merkle_manifest, siblings

    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fields = ["doc_id", "source", "lang", "n_chars", "text"]
        leaves = docs.select("doc_id", "lang", leaf_digest(*map(F.col, fields)).alias("leaf"), F.lit(7).alias("place_before"))
        made = merkle_manifest(leaves, group_col="lang", id_col="doc_id", leaf_col="leaf")
        proofs = made.proofs.withColumns({"end": folded(F.col("leaf"), F.col("proof")), "bad": folded(F.sha2("leaf", 256), F.col("proof")), "siblings": siblings(F.col("proof"))}).collect()
        field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        plain = [(r[2], r[0], h("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))) for r in rows]
        want = manifest_slowly(plain)
        got = defaultdict(list)
        for r in proofs:
            got[r["lang"], r["doc_id"], r["leaf"]].append((r["subroot"], made.root, r["proof"]))
            assert r["end"] == made.root != r["bad"] and r["place_before"] == 7
            assert r["siblings"] == "".join(s[1:] for s in r["proof"])
        assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in want.items()}
        assert {(r["lang"], r["subroot"]) for r in made.roots.collect()} == {(g, v[0][0]) for (g, _, _), v in want.items()}
        empty = merkle_manifest(nothing.select("doc_id", "lang", "leaf"), group_col="lang", id_col="doc_id", leaf_col="leaf")
        assert empty.root is None and empty.proofs.collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nodes_climb_in_several_rounds(spark, monkeypatch):
    from litquarry.llm import merkle

    monkeypatch.setattr(merkle, "TOGETHER", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in (3, 77):
            leaves = [("g", i, h(str(i))) for i in range(size)]
            made = merkle.merkle_manifest(spark.createDataFrame(leaves, "lang string, doc_id long, leaf string"), group_col="lang", id_col="doc_id", leaf_col="leaf")
            want = manifest_slowly(leaves)
            assert {(r["lang"], r["doc_id"], r["leaf"]): [(r["subroot"], made.root, r["proof"])] for r in made.proofs.collect()} == dict(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tampered_rows_are_those_of_the_contract():
    assert [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0]

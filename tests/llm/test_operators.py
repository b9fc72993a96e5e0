"""Each operator against brute force on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, line string, at int, id long, row int, shard long, batch int, n long, token long, bucket int, key string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = str.maketrans(UPPER, LOWER)


def corpus():
    rnd = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "delta,", "été", "x", "straße", "日本", "it's", "end.", "0", "***"]
    para = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared, passage = para(40), "one two three four five six seven eight nine ten eleven twelve"
    texts = [para(rnd.randint(0, 60)) for _ in range(25)]
    texts += [None, "", "   ", "\n", "\n\n", " \t\n", "word", shared, shared, shared + " tail", "lead " + shared, para(3000)]
    texts += [f"{para(5)}\nThe same long line here\n{para(4)}", f"the same LONG line here \n{para(7)}", "The same long line here"]
    texts += [para(9) + " " + passage + " " + para(3), passage.upper(), "<|endoftext|> a  b <|endoftext|>", "a" * 5000, "ümläut　x\x1cy"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, texts[7]), (8, "another text of a known id"), (None, shared), (None, None)]
    rnd.shuffle(rows)
    return rows, passage


@pytest.fixture(scope="module")
def rows():
    return corpus()[0]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 1, 2, 3, 4, 5, 6, 7, 8, "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def key(values):
    return sorted(values, key=repr)


def encoded(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def test_token_output(docs, nothing, rows):
    from litquarry.llm.token_output import token_output

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_output(docs, path).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*encoded("byte_bpe_50k.json", t), 0]
        want.append((i, start, ids))
        start += len(ids)
    assert key((r["doc_id"], r["start"], list(r["ids"])) for r in got) == key(want)
    assert all(r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes()) for r in got)
    assert token_output(nothing, path).collect() == []


def test_random_access():
    from litquarry.llm.token_output import Shard, shard_bytes

    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 6, 9000), np.full(777, 3), np.array([1, 2] * 400 + [2, 2, 2])):
        sizes = [len(ids) // 3, 0, len(ids) - len(ids) // 3]
        shard = Shard(shard_bytes([5, None, 7], sizes, ids.astype(np.uint32), 10))
        assert shard.doc_ids == [5, None, 7]
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert np.array_equal(shard.tokens(a, b), ids[a:b])


def test_packing(docs, nothing, rows):
    from litquarry.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    got = pack_documents(docs, path, size=64, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = [*encoded("word_bpe_49k.json", t), 0]
        want += [(i, k // 64, k, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    assert key((r["doc_id"], r["piece"], r["start"], list(r["ids"])) for r in got) == key(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(w[3]) for w in want)
    assert len(places) <= -(-total // 64) + 2
    assert pack_documents(nothing, path).collect() == []


def test_packing_plan_uses_every_length_once():
    from collections import Counter

    from litquarry.llm.packing import plan_packing

    rnd = random.Random(5)
    for size, most in ((64, 64), (2048, 2048), (2048, 300), (10, 3)):
        histogram = dict(Counter(rnd.randint(1, most) for _ in range(4000)))
        used = Counter()
        sequences = 0
        for held, times in plan_packing(histogram, size):
            assert sum(n * k for n, k in held) <= size
            for n, k in held:
                used[n] += k * times
            sequences += times
        assert used == histogram
        assert sequences <= 1.02 * sum(n * c for n, c in histogram.items()) / size + 3


def test_substring_dedup(docs, nothing, rows):
    from litquarry.llm.substring_dedup import substring_dedup

    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for batches in (1, 3):
        got = substring_dedup(docs, batches=batches, fanout=2).collect()
        assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == key(want)
    assert sum(x[2] for x in want) > 0
    assert substring_dedup(nothing).collect() == []


def test_incremental_batches_meet_history(spark):
    from litquarry.llm.common import new_folder, written
    from litquarry.llm.fingerprints import packed_shards
    from litquarry.llm.substring_dedup import FingerprintIndex, remove_covered

    text = " ".join(f"w{i}" for i in range(40))
    index = FingerprintIndex(spark, new_folder(spark, "index"), width=13, buckets=16, fanout=2)
    for k, rows in enumerate([[(50, text)], [(10, "new words here"), (11, text + " more")], [(5, text)], [(1, "x " + text)]]):
        batch = written(packed_shards(spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, batch int")), "batch")
        got = {r["id"]: r["n_removed"] for r in remove_covered(batch, index.ingest(batch), width=13, buckets=16).collect()}
        assert got == {i: 40 if k and text in t else 0 for i, t in rows}
        index = FingerprintIndex.open(spark, index.folder)  # as a later session would
    assert 0 < sum(map(len, index.levels)) < 4
    index.drop()
    assert FingerprintIndex.open(spark, index.folder).levels == [[]]
    with pytest.raises(FileNotFoundError):
        FingerprintIndex.open(spark, new_folder(spark, "nothing"))


def test_token_counts(docs, nothing, rows):
    from litquarry.llm.token_count import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts(docs, path).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == key((i, len((t or "").encode()), len(encoded("byte_bpe_50k.json", t))) for i, t in rows)
    assert token_counts(nothing, path).collect() == []


def test_line_dedup(docs, nothing, rows):
    from litquarry.llm.line_dedup import line_dedup

    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    ids = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(norm(x)) >= 10:
                ids.setdefault(norm(x), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(ids.get(norm(x), ())) < 2 or i == min(ids[norm(x)])]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    got = line_dedup(docs).collect()
    assert key((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == key(want)
    assert sum(x[2] for x in want) > 0
    assert line_dedup(nothing).collect() == []


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_ngram_components(docs, nothing, rows, spark):
    from litquarry.llm.ngram_join import ngram_components

    def check(frame, rows):
        sets = []
        for i, t in rows:
            w = words((t or "").translate(LOW))
            sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
        known = [(i, s) for i, s in sets if i is not None and s]
        links = [(a, b) for k, (a, s) in enumerate(known) for b, t in known[:k] if 100 * len(s & t) >= 80 * len(s | t)]
        root = components({i for i, _ in known}, links)
        want = [(i, len(s), None if i is None else root[i] if s else i) for i, s in sets]
        got = ngram_components(frame).collect()
        assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(want)
        return sum(a != b for a, b in root.items())

    assert check(docs, rows)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(150):  # near copies of near copies: chains that no single centre links
        w = list(base if i % 3 else near[-1][1].split() if near else base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        near.append((1000 - i, " ".join(w)))
    assert check(spark.createDataFrame(near, "doc_id long, text string").repartition(4), near) > 50
    assert ngram_components(nothing).collect() == []


def test_decontamination(docs, nothing, rows, spark):
    from litquarry.llm.decontaminate import decontaminate, proximity_matches

    passage = corpus()[1]
    items = [(1, passage), (2, "zzz yyy"), (3, "Tail"), (4, None), (5, "..."), (10, passage.title()), (None, "word"), (6, "beta gamma"), (6, "x")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for i, t in rows:
        w, hit, found = words((t or "").translate(LOW), pattern), set(), set()
        for item, x in items:
            v = words((x or "").translate(LOW), pattern)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n and item is not None and i is not None else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[s : s + n]:
                        hit.update(range(k, k + n))
                        found.add(str(item))
        want.append((i, len(w), len(hit), sorted(found)))
    got = decontaminate(docs, bench).collect()
    assert key((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got) == key(want)
    assert sum(x[2] for x in want) > 20
    near = proximity_matches(docs, spark.createDataFrame([(1, "twelve one seven")], "item_id long, text string"), radius=12)
    assert {r["doc_id"] for r in near.collect()} == {i for i, t in rows if t and passage in t.lower()}
    assert decontaminate(nothing, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate(docs, bench.limit(0)).collect())


def test_decontamination_hot_terms(spark):
    """One word makes up most of the corpus and of the items; windows repeat words and overlap."""
    from litquarry.llm.decontaminate import build_index, search_phrases, word_counts

    rng = np.random.default_rng(12)
    some = lambda n: " ".join(rng.choice(["the", "The", "of", "sun", "moon"], n, p=[0.5, 0.2, 0.2, 0.08, 0.02]))
    rows = [(i, some(rng.integers(0, 90))) for i in range(60)] + [(60, "the " * 300), (61, None), (None, "the " * 12)]
    items = [(f"i{k}", some(n)) for k, n in enumerate([12, 14, 11, 10, 3, 1, 2])] + [("same", "the " * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    index = build_index(docs)
    assert {(r["id"], r["n_words"]) for r in word_counts(index).collect()} == {(i, len((t or "").split())) for i, t in rows}
    want = set()
    for i, t in rows[:-1]:
        w = (t or "").lower().split()
        for item, x in items:
            v = x.lower().split()
            n = min(10, len(v))
            for s in range(len(v) - n + 1):
                want |= {(i, item, p) for k in range(len(w) - n + 1) if w[k : k + n] == v[s : s + n] for p in range(k, k + n)}
    got = search_phrases(index, bench).collect()
    assert {(r["id"], item, p) for r in got for item in r["ids"] for p in range(r["first"], r["last"] + 1)} == want
    assert len(want) > 1000


def test_warc(spark):
    from litquarry.llm.warc import warc_round_trip

    big, other = "é" * 700, "b" * 1000
    pages = [(1, "http://a", big), (2, None, big), (3, "http://c\nd", big), (4, "u", None), (5, "u", ""), (6, "u", "b" * 999), (7, "u", "b" * 999), (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", other), (10, "u", "c" * 300_000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, key string").repartition(3)
    got = warc_round_trip(frame).collect()
    target = {big: 3, other: 9}
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = target.get(html) if i is not None and i < target.get(html, -1) else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to, None if to else html or ""))
    assert key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in got) == key(want)
    assert warc_round_trip(frame.limit(0)).collect() == []


def test_warc_damage(tmp_path, spark):
    from litquarry.llm.warc import plan_revisits, read_records, write_warc

    pages = spark.createDataFrame([(1, "u", "x" * 50), (2, "u", "y" * 50)], "page_id long, url string, html string").coalesce(1)
    path = [r["path"] for r in write_warc(plan_revisits(pages).coalesce(1), f"file://{tmp_path}/w").collect() if r["n_records"]][0]
    data = open(path.removeprefix("file://"), "rb").read()
    assert len(list(read_records(path))) == 2
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(data[:-9])
    with pytest.raises((ValueError, zlib.error)):
        list(read_records(path))


def test_embedding_filters_in_blocks(spark):
    """However a filter is cut into blocks, all pairs of its groups meet."""
    from litquarry.llm.embedding_dedup import _in_cells

    rows = [(f, i) for f, n in ((1, 23), (2, 5), (3, 1)) for i in range(100 * f, 100 * f + n)]
    cells = {}
    for r in _in_cells(spark.createDataFrame(rows, "filter long, leader long"), block=5).collect():
        cells.setdefault(r["filter"], []).append(r["leader"])
    met = {(a, b) for x in cells.values() for a in x for b in x if a < b}
    assert met == {(a, b) for f, a in rows for g, b in rows if f == g and a < b}
    assert max(map(len, cells.values())) < 23 and len(cells) > 3


def test_embedding_links(spark):
    from litquarry.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(100 + i, (base[i % 7] + rng.standard_normal(16) * s).tolist()) for i, s in enumerate([0.02] * 60 + [0.12] * 60 + [0.25] * 30)]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] + [1.0] * 15), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [float("inf")] + [0.0] * 15), (None, base[0].tolist())]
    odd += [(500, base[3].tolist()), (501, (base[3] * 5).tolist()), (500, base[3].tolist())]
    frame = spark.createDataFrame([(i, v, 0, "k") for i, v in vectors + odd], "vec_id long, embedding array<float>, label int, leader string").repartition(3)
    exact = {r["vec_id"]: r["embedding"] for r in frame.collect() if r["vec_id"] is not None}
    ok = {i: np.array(v, float) for i, v in exact.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = set()
    for a, x in ok.items():
        for b, y in ok.items():
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links.add((a, b))
    root = components(exact, links)
    got = embedding_links(frame).collect()
    assert len(got) == len(vectors) + len(odd)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert found.pop(None) == (0, None)
    want = {i: (sum(i in p for p in links), root[i]) for i in exact}
    assert found == want and sum(n for n, _ in want.values()) > 1000
    assert embedding_links(frame.limit(0)).collect() == []


def test_embedding_links_of_huge_and_tiny_vectors(spark):
    from litquarry.llm.embedding_dedup import embedding_links

    vectors = [(1, [1e-200, 0.0]), (2, [5e-324, 0.0]), (3, [1e200, 0.0]), (4, [1e300, 1e299]), (5, [0.0, 1e-310]), (6, [0.0, 3.0]), (7, [-1e308, 0.0]), (8, [1e-320, 1e-320]), (8, [0.0, -1.0])]
    got = embedding_links(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    # of two vectors under one id the smaller is compared, which is nobody's neighbour here
    assert key(map(tuple, got)) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8), (8, 0, 8)]


def test_toxicity(spark):
    from litquarry.llm.toxicity import held_out, toxicity

    rnd = random.Random(1)
    syllables = ["ta", "ren", "mi", "sol", "ku", "ber", "na", "lo", "vin", "ed"]
    insults = ["blarghead", "snorkface", "grumwit"]
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 40))]
        if toxic := int(i % 6 == 0):
            for _ in range(2):
                w[rnd.randrange(len(w))] = rnd.choice(insults)
        rows.append((i, " ".join(w), 0.5, "x"))
        labels.append((i, toxic))
    extra = [(2000, None, 0.1, "x"), (2001, "", 0.1, "x"), (None, "blarghead", 0.1, "x"), (2003, "b l a r g h e a d", 0.1, "x"), (2004, "snorkk-face", 0.1, "x"), (2005, "ren " * 20000, 0.1, "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score double, word string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs, marks).collect()}
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for i, r in got.items() if i in truth and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert got[2003]["predicted"] == got[None]["predicted"] == got[2004]["predicted"] == 1
    assert not (got[2000]["predicted"] or got[2001]["predicted"] or got[2005]["predicted"])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity(docs.limit(0), marks).collect() == []
    assert len(toxicity(docs, marks.limit(0)).collect()) == len(got)
    assert marks.select(held_out(F.col("doc_id"))).count() == len(labels) + 2


def test_runs_are_merged_block_by_block():
    from litquarry.llm.substring_dedup import _held

    rng = np.random.default_rng(8)
    for n, m, wide in ((0, 5, 10), (7, 0, 10), (500, 300, 90), (400, 900, 1 << 40), (60, 60, 2)):
        mine, theirs = (np.unique(np.stack([rng.integers(0, wide, k), rng.integers(0, 3, k)], 1), axis=0) for k in (n, m))
        blocks = [(theirs[i : i + 7, 0].astype(np.uint64), theirs[i : i + 7, 1].astype(np.uint32)) for i in range(0, len(theirs), 7)]
        want = {tuple(x) for x in theirs.tolist()}
        got = _held(mine[:, 0].astype(np.uint64), mine[:, 1].astype(np.uint32), iter(blocks))
        assert got.tolist() == [tuple(x) in want for x in mine.tolist()]


def test_buckets_follow_the_data(spark):
    from litquarry.llm.fingerprints import IN_BUCKET, bucket_count

    frame = spark.range(1)
    assert bucket_count(frame) == bucket_count(frame, 10) == 16 and bucket_count(frame, 1000 * IN_BUCKET) == 1024


def test_sets_beyond_sixteen_bits_are_joined(spark, monkeypatch):
    """Sets with more shingles than a cell can count have no suffix filter, and lose no link by that."""
    from litquarry.llm import ngram_join

    monkeypatch.setattr(ngram_join, "MOST_CELL", 63)
    rnd = random.Random(12)
    vocab = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(24):
        words_ = [rnd.choice(vocab) for _ in range(rnd.choice([30, 60, 120]))]
        texts.append(" ".join(words_))
        for changes in (1, 2, 6):
            near = list(words_)
            for _ in range(changes):
                near[rnd.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    root = components(dict(enumerate(sets)), links)
    got = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root and len(links) > 10

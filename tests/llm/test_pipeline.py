"""The corpus pipeline against brute force, stage by stage, on a small table with nulls, repeats, copies and clashing columns."""

import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as cp

BLANKS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long"


def some(rng, n):
    return " ".join(rng.choice([f"{a}{b}" for a in ("ka", "lo", "mi", "sun", "wind") for b in ("ra", "te", "no", "field", "flux", "s")], n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    passage = some(rng, 14)
    base = [some(rng, 60) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(50 + i, base[i] + "\nend of it") for i in range(8)]  # near copies
    rows += [(60 + i, some(rng, 30) + "\nThis line comes again and again\n" + some(rng, 20)) for i in range(6)]
    rows += [(70, "This line comes again and again"), (71, "x " + passage.title() + " y"), (72, some(rng, 20) + " " + passage), (73, None), (74, ""), (75, " \n\t "), (76, base[1]), (76, base[1]), (77, some(rng, 2500))]
    rows += [(None, base[2]), (None, None), (80, some(rng, 30) + " snorkface " + some(rng, 5))]
    toxic = [(100 + i, some(rng, 20) + " snorkface " + some(rng, 20)) for i in range(40)] + [(160 + i, some(rng, 15)) for i in range(200)]
    rows += toxic
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, t, "en", "web", len(t or ""), "r", 7) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i == 80 or 100 <= i < 140)) for i in {i for i, _ in rows if i is not None}]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None), (None, base[5])], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def words(t, pattern):
    return re.findall(pattern, (t or "").translate(LOW))


def repeated_lines_gone(rows):
    key = lambda x: x.strip(BLANKS).translate(LOW)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or i == min(held[key(x)])]
        if len(kept) == len(lines):
            out.append((i, t))
        elif "\n".join(kept).strip(BLANKS):
            out.append((i, "\n".join(kept)))
    return out


def one_of_each_group(rows):
    sets = {}
    for i, t in rows:
        w = words(t, r"[^\x20\x09-\x0D]+")
        if i is not None and w:
            sets.setdefault(i, set()).update([tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, t) for i, t in rows if i is None or i not in sets or find(i) == i]


def uncontaminated(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for item, x in items:
        v = words(x, pattern)
        n = min(10, len(v))
        windows |= {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n and item is not None else set()
    hit = {i for i, t in rows if i is not None for w in [words(t, pattern)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows}
    return [(i, t) for i, t in rows if i not in hit]


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    key = lambda rows: sorted(rows, key=str)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = cp.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert key(left) == key([(i, t) for i, t in rows if "snorkface" not in (t or "")])
    wants = [repeated_lines_gone, one_of_each_group, lambda x: uncontaminated(x, [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])]
    for (_, stage), want in zip(cp.STAGES[1:4], wants, strict=True):
        docs = cp.written(got, "stage")
        got, before = stage(spark, docs, folder), left
        assert got.columns == docs.columns
        left = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert key(left) == key(want(before))
        assert len(left) < len(before)
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in cp.run(spark, folder).collect():
        sizes.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    want = {}
    for i, t in left:
        n = len(tool.encode(t or "", add_special_tokens=False).ids) + 1
        want.setdefault(i, []).extend((k, min(2048, n - at)) for k, at in enumerate(range(0, n, 2048)))
    assert {i: sorted(x) for i, x in sizes.items()} == {i: sorted(x) for i, x in want.items()}


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").collect() == []

"""Patches against plain Python on documents of several depths."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litquarry.functions import patches
from litquarry.functions.parsers import path_tokens

SCHEMA = "summary string, n int, tags array<string>, grid array<array<int>>, instruments array<struct<name: string, periods: array<struct<label: string, time: struct<start: string, end: string>, quotes: array<string>, score: double>>>>"
PERIOD = {"label": "p", "time": {"start": "a", "end": "b"}, "quotes": ["q", "r"], "score": 1.5}
DOCUMENT = {"summary": "s", "n": 1, "tags": ["x", "y"], "grid": [[1, 2], [3]], "instruments": [{"name": "A", "periods": [PERIOD, {**PERIOD, "label": "o", "time": None}]}, {"name": "B", "periods": []}]}
CASES = [
    ("summary", "new", ["summary"]), ("n", "7", ["n"]), ("n", "seven", ["n"]), ("tags[1]", "z", ["tags", 1]), ("grid", "[[9]]", ["grid"]), ("grid[0]", "[5,6]", ["grid", 0]),
    ("instruments[0].name", "N", ["instruments", 0, "name"]), ("instruments[0].periods[1].label", "L", ["instruments", 0, "periods", 1, "label"]),
    ("instruments[0].periods[0].time.start", "t", ["instruments", 0, "periods", 0, "time", "start"]), ("instruments[0].periods[0].time", '{"start":"u","end":"v"}', ["instruments", 0, "periods", 0, "time"]),
    ("instruments[0].periods[1].time.start", "t", None), ("instruments[0].periods[0].quotes[1]", "Q", ["instruments", 0, "periods", 0, "quotes", 1]), ("instruments[0].periods[0].score", "2.25", ["instruments", 0, "periods", 0, "score"]),
    ("instruments[1].periods[0].label", "x", None), ("instruments[2]", "{}", None), ("instruments[0].nothing", "x", None), ("nothing", "x", None), ("tags[9]", "x", None), ("tags.x", "x", None), ("summary.deep", "x", None), ("", "x", None), (None, "x", None),
    ("instruments[1]", '{"name":"C","periods":null}', ["instruments", 1]),
]


def test_paths(spark):
    paths = [("paper_summary",), ("instruments[0]",), ("instruments[0].data_collection_periods[1].time_range",), ("instruments[2].data_collection_periods[5]",), ("odd[x].b",)]
    want = [["paper_summary"], ["instruments", "0"], ["instruments", "0", "data_collection_periods", "1", "time_range"], ["instruments", "2", "data_collection_periods", "5"], ["odd[x]", "b"]]
    assert [r[0] for r in spark.createDataFrame(paths, "p string").select(path_tokens(F.col("p"))).collect()] == want


def test_patches_at_every_depth(spark):
    schema = StructType.fromDDL(SCHEMA)
    rows = spark.createDataFrame([(k, json.dumps(DOCUMENT), p, v) for k, (p, v, _) in enumerate(CASES)], "k int, d string, p string, v string").withColumn("d", F.from_json("d", schema))
    found = rows.select("k", patches.path_leads(F.col("d"), schema, F.col("p")).alias("leads"), F.to_json(patches.apply_patch(F.col("d"), schema, F.col("p"), F.col("v")), {"ignoreNullFields": "false"}).alias("d")).orderBy("k").collect()
    for r, (path, value, steps) in zip(found, CASES, strict=True):
        want = json.loads(json.dumps(DOCUMENT))
        if steps:
            at = want
            for s in steps[:-1]:
                at = at[s]
            old = at[steps[-1]]
            at[steps[-1]] = value if isinstance(old, str) else {"seven": None}.get(value, json.loads(value) if value != "seven" else None)
        assert r["leads"] == bool(steps) and json.loads(r["d"]) == want, path


def test_documents_that_are_null_stay_null(spark):
    schema = StructType.fromDDL("a array<struct<b: string>>")
    rows = spark.createDataFrame([(None, "a[0].b"), (([None],), "a[0].b"), (([("x",)],), "a[0].b")], StructType().add("d", schema).add("p", "string"))
    found = rows.select(patches.apply_patch(F.col("d"), schema, F.col("p"), F.lit("new")).alias("d")).collect()
    assert [r["d"] if r["d"] is None else [None if x is None else x["b"] for x in r["d"]["a"]] for r in found] == [None, [None], ["new"]]


def test_a_path_is_read_once_for_a_row(spark, capsys):
    schema = StructType.fromDDL(SCHEMA)
    rows = spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("d"), F.concat(F.lit("instruments["), "id", F.lit("].name")).alias("p"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    rows.select(patches.apply_patch(F.col("d"), schema, F.col("p"), F.lit("new"))).explain()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert capsys.readouterr().out.lower().count("rlike") <= 2  # it was in the plan 138 times

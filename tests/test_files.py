"""Readers and sinks on real files."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from litquarry.sources import files, npy


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\n\n  {"a": 2} \n{"a": \n[3]\n{"a": 4\x00}\n"5"\nnull\n')
    assert sorted(r["a"] for r in files.jsonl_tolerant(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.jsonl_strict(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()


def test_ids_and_turtle(spark, tmp_path):
    (tmp_path / "one.txt").write_text(" a \n\n\tb\n")
    assert [tuple(r) for r in files.id_lines(spark, f"file://{tmp_path}/one.txt").orderBy("id").collect()] == [("a", "one"), ("b", "one")]
    (tmp_path / "x.ttl").write_text('@prefix hkp: <http://x#> .\n\nhkp:A rdf:type hk:Phenomenon ;\n  skos:prefLabel "a b"@en .\n<http://x#B> rdf:type hkp:PrincipalPhenomenon ;\n  skos:prefLabel "b"@en .\n<http://y#C> rdf:type hk:Phenomenon ; skos:prefLabel "c"@en .\nhkp:D rdf:type hk:Phenomenon .\n')
    got = files.turtle_terms(spark, f"file://{tmp_path}/x.ttl", "hkp", ["hk:Phenomenon", "hkp:PrincipalPhenomenon"])
    assert sorted(tuple(r) for r in got.collect()) == [("hkp:A", "a b"), ("hkp:B", "b")]


def test_catalog(spark, tmp_path):
    schema = "k int, mission_code string, mission_name string, data_system string"
    (tmp_path / "good.json").write_text('[{"k": 1, "mission_code": " A", "mission_name": "a", "data_system": "VSO "},\n {"k": 2, "mission_code": "B", "mission_name": "b", "data_system": "new"}]')
    got = files.json_catalog(spark, f"file://{tmp_path}/good.json", schema, "k")
    assert sorted((r["mission_code"], r["data_system"], r["known_system"]) for r in got.collect()) == [("A", "vso", True), ("B", "new", False)]
    (tmp_path / "bad.json").write_text('[{"k": 1, "mission_code": "A", "mission_name": " ", "data_system": null}]')
    with pytest.raises(ValueError, match="1: mission_name must not be empty, data_system must not be empty"):
        files.json_catalog(spark, f"file://{tmp_path}/bad.json", schema, "k")


def test_numpy(spark, tmp_path):
    x = np.arange(35, dtype=np.float64).reshape(7, 5)
    np.save(tmp_path / "x.npy", x)
    npy.register(spark)
    read = lambda path, n: spark.read.format("npy").option("rows", n).load(f"file://{tmp_path}/{path}")
    rows = read("x.npy", 3)
    got = rows.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(7)) and rows.rdd.getNumPartitions() == 3
    assert np.array_equal(np.array([r["vector"] for r in got]), x)
    with pytest.raises(ValueError, match="7 vectors for 6"):
        files.check_counts(rows, spark.range(6))
    npy.write_npy(rows.repartitionByRange(3, "row").sortWithinPartitions("row"), f"file://{tmp_path}/many", "vector")
    again = read("many", 2).orderBy("row").collect()
    assert np.array_equal(np.array([r["vector"] for r in again]), x) and len(list((tmp_path / "many").glob("*.npy"))) == 3
    np.save(tmp_path / "none.npy", np.zeros((0, 5)))
    assert read("none.npy", 3).collect() == []
    np.save(tmp_path / "flat.npy", np.zeros(5))
    with pytest.raises(Exception, match="two dimensions"):
        read("flat.npy", 3).collect()


def test_append(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("x").alias("v"))
    assert files.append_missing(rows.where("id < 4"), f"file://{tmp_path}/out", "id") == 4
    assert files.append_missing(rows, f"file://{tmp_path}/out", "id") == 6
    assert files.append_missing(rows.unionByName(rows), f"file://{tmp_path}/out", "id") == 0


def test_turtle_of_several_splits(spark, tmp_path):
    """A file in many splits, with stanzas cut by them, gives what it gives in one; each line is carried alone, not with its file."""
    stanza = '<http://x#N{0}> rdf:type hk:Phenomenon ;\n\n\tskos:altLabel "z" ;\n  skos:prefLabel "n{0}"@en .\n'
    (tmp_path / "a.ttl").write_text("  # indented first\n@prefix hkp: <http://x#> .\n@prefix hkp: <http://later#> .\n" + "".join(stanza.format(k) for k in range(300)))
    (tmp_path / "b.ttl").write_text("@prefix hkp: <http://y#> .\n" + stanza.format(7) + "<http://y#M> rdf:type hk:Phenomenon ;\r\n  skos:prefLabel\n   \"m\"@en .")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = files.turtle_terms(spark, f"file://{tmp_path}/*.ttl", "hkp", ["hk:Phenomenon"])
        assert sorted(tuple(r) for r in found.collect()) == sorted([(f"hkp:N{k}", f"n{k}") for k in range(300)] + [("hkp:M", "m")])
        assert "wholetext" not in found._jdf.queryExecution().toString().lower()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_turtle_of_many_stanzas(spark, tmp_path):
    """One file of 200,000 stanzas; with its whole text beside each of them this took hours."""
    stanza = F.concat(F.lit("@prefix hkp: <http://x#> .\nhkp:N"), "id", F.lit(' rdf:type hk:Phenomenon ;\n  skos:prefLabel "n"@en .'))
    spark.range(200_000, numPartitions=1).select(stanza).write.text(f"file://{tmp_path}/t")
    began = time.time()
    assert files.turtle_terms(spark, f"file://{tmp_path}/t", "hkp", ["hk:Phenomenon"]).count() == 200_000 and time.time() - began < 120

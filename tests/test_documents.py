"""Documents are made once a query and behind one shuffle by the analysis, whatever is read from them."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from litquarry.operators import materialize as m
from litquarry.plans.catalogue import QUERIES
from litquarry.sources.files import parts_for

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    rows.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    with contextlib.redirect_stdout(io.StringIO()) as told:
        rows.explain()
    rows.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")
    return told.getvalue()


@pytest.mark.parametrize("name", ["c14_quotes_from_documents", "c17_phenomenon_mentions", "n2_backfill_mentions", "n5_pruned_documents", "n5_validated_stubs", "n10_unplaced_quotes", "n15_enrichment_selection", "n16_missing_coordinates"])
def test_one_shuffle_by_analysis(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("/lineitem.parquet") == 1
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "analysis_id" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]


def test_parts_follow_the_files(spark, tmp_path):
    spark.range(200_000).select(F.rand(1).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert parts_for(rows) == spark.sparkContext.defaultParallelism
    assert parts_for(rows.unionByName(rows), mb=1) <= parts_for(rows, mb=1) + 1
    spark.range(2_000_000).select(F.rand(1).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/more")
    assert parts_for(spark.read.parquet(f"{tmp_path}/more"), mb=1) > 10


def test_entries_of_equal_names_and_none(spark):
    entry = '{"name": {"original": " A ", "normalized": {"matched_instrument_code": %s, "matched_mission_code": "M", "data_system": "s"}}, "general_quotes": %s, "data_collection_periods": [%s]}'
    period = '{"time_range": {"normalized": {"start_datetime": "2020-01-01T00:00:00Z", "end_datetime": "2020-01-02T00:00:00Z"}}, "supporting_quotes": %s, "physical_observable": "%s", "phenomena": %s}'
    first = entry % ('"x"', '["g", " ", null]', ",".join((period % ('[{"category": "odd", "text": "q"}, {"category": "physobs", "text": "p"}]', "o1", '[{"iri": "i"}]'), period % ("null", "o2", "null"))))
    second = entry % ('"x"', "null", period % ('[{"category": "physobs", "text": "p"}, {"category": "physobs", "text": "r"}]', "o3", '[{"iri": "i"}, {"iri": "j"}, {"iri": "k"}]'))
    docs = spark.createDataFrame([("1-O", 1, f'{{"instruments": [{first}, {second}, {{"name": null}}]}}')], "analysis_id string, paper_id long, details string")
    catalog = spark.createDataFrame([("s", "M", "x", 7)], "system string, mission string, code string, instrument_id long")
    quotes = m.usage_quotes(docs, catalog).select("instrument_id", "parameter", "quote").collect()
    assert sorted(map(tuple, quotes)) == [(7, "general", "g"), (7, "general", "q"), (7, "physobs", "p"), (7, "physobs", "r")]
    known = spark.createDataFrame([("i",), ("j",)], "iri string")
    told = m.phenomenon_mentions(docs, known).select("iri", "name", "observable", "n_quotes").collect()
    assert sorted(map(tuple, told)) == [("i", "A", "o1", 2), ("j", "A", "o3", 2)]


def test_run_pairs_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    from litquarry.plans import relational

    monkeypatch.setattr(relational, "parts_for", lambda rows: 77)
    plan = plan_of(QUERIES["j17_run_pairs"](spark, SF))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and all(", 77), REPARTITION_BY_NUM" in line for line in shuffles)

"""Queries over whole tables: no id is left out, and names are looked up in the whole catalog."""

from pyspark.sql import functions as F

from litquarry.operators import joins
from litquarry.plans.catalogue import QUERIES
from litquarry.sources.roles import instruments, reader, usages

SF = "/root/testdata/sf0.01"


def test_every_paper_and_observatory_has_its_rows(spark):
    use = usages(reader(spark, SF))
    assert QUERIES["x7_jaccard_every_paper"](spark, SF).count() == use.select("paper_id").distinct().count()
    per = QUERIES["a39_quotes_by_paper"](spark, SF)
    assert per.agg(F.sum("n")).first()[0] == use.count()
    assert per.select("observatory_id").distinct().count() == use.select("observatory_id").distinct().count()


def test_names_of_the_catalog_are_all_found(spark):
    every, found = instruments(reader(spark, SF)), QUERIES["j15_ambiguity_whole_catalog"](spark, SF)
    assert found.count() == every.select("instrument").distinct().count()
    assert found.where("resolution = 'lookup-none'").count() == 0


def test_lookup_none(spark):
    names = spark.createDataFrame([("aia",), ("HMI",), ("Nix",), (None,)], "name string")
    catalog = spark.createDataFrame([("AIA", "SDO"), ("Hmi", "SDO"), ("hmi", "X")], "instrument string, mission string")
    found = joins.resolve_unique(names, catalog, name_col="name", catalog_col="instrument", code_col="mission")
    assert {tuple(r) for r in found.collect()} == {("aia", "lookup-unique", "SDO"), ("HMI", "ambiguous", None), ("Nix", "lookup-none", None), (None, "lookup-none", None)}

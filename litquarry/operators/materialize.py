"""Normalized analysis documents to usages, quotes, mentions and phenomena.

An analysis holds its instruments as JSON. Each step explodes the document's arrays and joins the catalog; a bad entry is
left out and never stops the others of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.operators.joins import contained_join
from litquarry.sources.files import written

#: The parts of a normalized document that are read.
NORMALIZED = """instruments array<struct<
  name: struct<original: string, normalized: struct<matched_instrument_code: string, matched_mission_code: string, data_system: string>>,
  general_quotes: array<string>,
  data_collection_periods: array<struct<period_name: string,
    time_range: struct<normalized: struct<start_datetime: string, end_datetime: string>>,
    supporting_quotes: array<struct<category: string, text: string>>,
    physical_observable: string, phenomena: array<struct<iri: string>>>>>>"""
#: How an entry is named once exploded: its document's key and place, and the names that it was matched with.
ENTRY = ["analysis_id", "entry"]
CATEGORIES = ["time", "wavelength", "physobs", "general"]


def entries(analyses: DataFrame) -> DataFrame:
    """One row for each instrument of the documents (analysis_id, paper_id, details) that has a normalized name."""
    parsed = analyses.select("analysis_id", "paper_id", F.from_json("details", NORMALIZED).alias("d"))
    each = parsed.select("analysis_id", "paper_id", F.posexplode("d.instruments").alias("entry", "x")).where("x.name.normalized IS NOT NULL")
    names = F.col("x.name.normalized")
    return each.select(
        "analysis_id", "paper_id", "entry", F.trim("x.name.original").alias("name"), names["matched_instrument_code"].alias("code"), names["matched_mission_code"].alias("mission"), names["data_system"].alias("system"),
        F.coalesce("x.general_quotes", F.array().cast("array<string>")).alias("general_quotes"), F.col("x.data_collection_periods").alias("periods"),
    )


def resolved(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` with instrument_id by (system, mission, code); a code without a known mission resolves if only one instrument has it.

    ``mission_known`` tells whether the system has the mission. ``catalog`` is (system, mission, code, instrument_id), unique.
    It is written first: by the size of its files Spark knows a small one, and doesn't shuffle the rows to meet it.
    """
    catalog = written(catalog, "catalog")
    exact = catalog.select("system", "mission", "code", F.col("instrument_id").alias("_exact"))
    missions = catalog.select("system", "mission", F.lit(True).alias("_mission")).distinct()
    single = catalog.groupBy("code").agg(F.count("*").alias("_n"), F.min("instrument_id").alias("_single")).where("_n = 1").drop("_n")
    met = rows.join(exact, ["system", "mission", "code"], "left").join(missions, ["system", "mission"], "left").join(single, "code", "left")
    known = F.coalesce("_mission", F.lit(False))
    return met.withColumn("mission_known", known).withColumn("instrument_id", F.when(known, F.col("_exact")).otherwise(F.col("_single"))).drop("_exact", "_mission", "_single")


def periods(rows: DataFrame) -> DataFrame:
    """One row a period, with its start and end and its entry's general quotes; a reversed or unreadable window has none."""
    each = rows.withColumn("p", F.explode("periods"))
    tells = F.col("p.time_range.normalized")
    start, end = F.try_to_timestamp(tells["start_datetime"]), F.try_to_timestamp(tells["end_datetime"])
    sound = start <= end
    return each.select("analysis_id", "paper_id", "entry", "name", "instrument_id", F.when(sound, start).alias("win_start"), F.when(sound, end).alias("win_end"), F.col("p.supporting_quotes").alias("quotes"), F.col("p.physical_observable").alias("observable"), F.col("p.phenomena").alias("phenomena"), "general_quotes")


def exactly_resolved(analyses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries that name system, mission and instrument of the catalog: only these become usages."""
    return resolved(entries(analyses), catalog).where("mission_known AND code IS NOT NULL AND instrument_id IS NOT NULL")


def dataset_usages(analyses: DataFrame, catalog: DataFrame) -> DataFrame:
    """(paper_id, analysis_id, instrument_id, win_start, win_end), each once however often the document says so."""
    return periods(exactly_resolved(analyses, catalog)).where("win_start IS NOT NULL").select("paper_id", "analysis_id", "instrument_id", "win_start", "win_end").distinct()


def said_quotes(analyses: DataFrame, catalog: DataFrame) -> DataFrame:
    """``usage_quotes``, as often as documents say them: each period's row gives its own quotes and those of its entry."""
    of = periods(exactly_resolved(analyses, catalog)).where("win_start IS NOT NULL")
    quote = lambda parameter, text: F.struct(parameter.alias("parameter"), text.alias("quote"))
    own = F.transform("quotes", lambda q: quote(F.when(q["category"].isin(CATEGORIES), q["category"]).otherwise("general"), q["text"]))
    general = F.transform("general_quotes", lambda t: quote(F.lit("general"), t))
    every = F.concat(F.coalesce(own, F.slice(general, 1, 0)), general)
    told = of.select("analysis_id", "paper_id", "instrument_id", "win_start", "win_end", F.explode(every).alias("q")).where("trim(q.quote) <> ''")
    return told.select("analysis_id", "paper_id", "instrument_id", "win_start", "win_end", "q.parameter", "q.quote")


def usage_quotes(analyses: DataFrame, catalog: DataFrame) -> DataFrame:
    """(analysis_id, instrument_id, win_start, win_end, parameter, quote): a period's quotes belong to its own usage, those of
    an instrument, as ``general``, to all usages of its entry. Blank quotes are none; unknown categories are general.
    """
    return said_quotes(analyses, catalog).drop("paper_id").distinct()


def mentions(analyses: DataFrame, catalog: DataFrame) -> DataFrame:
    """(analysis_id, instrument_id, system, mission, match_level): instruments by how many of their periods have readable times,
    else known missions alone. Reversed times can be read. Entries of nothing known are left out.
    """
    met = resolved(entries(analyses), catalog)
    readable = lambda p: F.try_to_timestamp(p["time_range"]["normalized"]["start_datetime"]).isNotNull() & F.try_to_timestamp(p["time_range"]["normalized"]["end_datetime"]).isNotNull()
    every = F.size(F.coalesce("periods", F.array().cast(met.schema["periods"].dataType)))
    sound = F.size(F.coalesce(F.filter("periods", readable), F.array().cast(met.schema["periods"].dataType)))
    level = F.when(F.col("instrument_id").isNull(), "mission_only").when(sound == 0, "instrument_no_time").when(sound < every, "partial").otherwise("full")
    kept = met.where("instrument_id IS NOT NULL OR mission_known")
    only = F.col("instrument_id").isNull()
    found = kept.select("analysis_id", "entry", "instrument_id", F.when(only, F.col("system")).alias("system"), F.when(only, F.col("mission")).alias("mission"), level.alias("match_level"))
    last = found.groupBy("analysis_id", "instrument_id", "system", "mission").agg(F.max_by("match_level", "entry").alias("match_level"))
    return last


def mission_backfill(choices: DataFrame, known: DataFrame, missions: DataFrame) -> DataFrame:
    """(analysis_id, mission) that selection calls chose and that the analysis has no resolved instrument of.

    ``choices`` is (analysis_id, candidates: numbers to codes, chosen: numbers), ``known`` (analysis_id, mission), and
    ``missions`` the catalog's names, met without regard to case.
    """
    named = choices.select("analysis_id", F.explode(F.transform("chosen", lambda k: F.try_element_at("candidates", k))).alias("code")).where("code IS NOT NULL").distinct()
    met = named.join(missions.select("mission").distinct(), F.lower("code") == F.lower("mission")).select("analysis_id", "mission").distinct()
    return met.join(known, ["analysis_id", "mission"], "left_anti")


def phenomenon_mentions(analyses: DataFrame, known: DataFrame) -> DataFrame:
    """(analysis_id, iri, name, observable, n_quotes): one row for each phenomenon and instrument of a document.

    The observable is that of the first period that names the phenomenon; quotes are the instrument's distinct ones on
    observables, from all periods. Phenomena that ``known`` (iri) lacks are left out.
    """
    told = lambda p, k: F.transform(p["phenomena"], lambda x: F.struct(x["iri"].alias("iri"), F.struct(F.col("entry"), k.alias("period")).alias("at"), p["physical_observable"].alias("observable")))
    asked = lambda p: F.transform(F.filter(p["supporting_quotes"], lambda q: (q["category"] == "physobs") & (F.trim(q["text"]) != "")), lambda q: q["text"])
    lists = lambda of: F.flatten(F.array_compact(F.transform("periods", of)))
    each = entries(analyses).select("analysis_id", "name", lists(told).alias("told"), lists(asked).alias("texts"))
    per = each.groupBy("analysis_id", "name").agg(F.flatten(F.collect_list("told")).alias("told"), F.size(F.array_distinct(F.flatten(F.collect_list("texts")))).cast("long").alias("n_quotes"))
    first = per.select("analysis_id", "name", "n_quotes", F.explode("told").alias("x")).groupBy("analysis_id", "name", "n_quotes", "x.iri").agg(F.min_by("x.observable", "x.at").alias("observable"))
    return first.join(known.select("iri").distinct(), "iri", "left_semi").select("iri", "analysis_id", "name", "observable", "n_quotes")


def grounded(candidates: DataFrame) -> DataFrame:
    """(entry, system, mission, code): per system the instruments that were selected and validated.

    Of a (mission, system) an instrument beats the mission alone. A system in which nothing was selected, or nothing of
    it validated, keeps its first mission (by ``place``) as a stub. ``candidates``: entry, system, place, mission, code,
    selected, accepted.
    """
    good = candidates.where("selected AND accepted").select("entry", "system", "mission", "code").distinct()
    stub = candidates.groupBy("entry", "system").agg(F.min_by("mission", "place").alias("mission"))
    alone = stub.join(good.select("entry", "system").distinct(), ["entry", "system"], "left_anti").withColumn("code", F.lit(None).cast("string"))
    specific = good.where("code IS NOT NULL")
    bare = good.where("code IS NULL").join(specific.select("entry", "system", "mission").distinct(), ["entry", "system", "mission"], "left_anti")
    return specific.unionByName(bare).unionByName(alone.select("entry", "system", "mission", "code")).distinct()


def archive_checks(calls: DataFrame, entries: DataFrame, *, as_of: Column) -> DataFrame:
    """``calls`` with ``errors`` and ``warnings``, arrays in the order in which they are looked for.

    Calls are (source, instrument, a, b, low, high); entries (source, instrument, f, t, low, high), an open one without
    ``t``, with a single wavelength as ``low`` alone. A call without an instrument, a source or any entry has that error
    only. A call without a time range is warned about. Its time has to lie whole in one entry; its wavelengths in one
    entry's range, or around an entry's single one; entries without wavelengths fit none, calls without any are fine.
    """
    keys = ["source", "instrument"]
    known = entries.select(*keys).distinct().withColumn("_known", F.lit(True))
    timed = contained_join(calls, entries, keys=keys, window=("a", "b"), valid=("f", "t"), as_of=as_of)
    bands = entries.where("low IS NOT NULL").select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
    asked = calls.where("low IS NOT NULL").select(*keys, "low", "high").distinct()
    held = F.when(F.col("_high").isNull(), F.col("_low").between(F.col("low"), F.col("high"))).otherwise((F.col("low") >= F.col("_low")) & (F.col("high") <= F.col("_high")))
    near = asked.join(bands, keys).where(held).select(*keys, "low", "high").distinct().withColumn("_near", F.lit(True))
    met = timed.join(known, keys, "left").join(near, [*keys, "low", "high"], "left")
    text = lambda c, e: F.when(c, F.lit(e))
    timeless = F.col("a").isNull() | F.col("b").isNull()
    first = F.coalesce(text(F.col("instrument").isNull(), "no instrument"), text(F.col("source").isNull(), "no source"), text(F.col("_known").isNull(), "unknown combination"))
    rest = F.array_compact(F.array(text(~timeless & ~F.col("inside"), "time range not valid"), text(F.col("low").isNotNull() & F.col("_near").isNull(), "wavelength range not valid")))
    warnings = F.when(first.isNull() & timeless, F.array(F.lit("no time range"))).otherwise(F.array().cast("array<string>"))
    return met.withColumns({"errors": F.when(first.isNotNull(), F.array(first)).otherwise(rest), "warnings": warnings}).drop("inside", "_known", "_near")

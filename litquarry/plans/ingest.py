"""Files written and read back: tolerant and strict scans, catalogs, ontologies, exports and appends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litquarry.functions import patches
from litquarry.functions.text import percent_encode
from litquarry.plans.composites import analyses
from litquarry.plans.registry import query
from litquarry.sources import files, npy
from litquarry.sources.roles import calls, instruments, observatories, papers, usages


@query("SELECT call_id, call_type, tokens FROM calls WHERE call_id % 10 NOT IN (3, 4, 5, 6)", "calls")
def s2_jsonl_tolerant(read):
    """Lines with blanks around them, empty ones, some with a NUL, some cut off, and some that are JSON but no object."""
    line = F.to_json(F.struct("call_id", "call_type", "tokens"))
    rest = F.col("call_id") % 10
    lines = calls(read).select(F.when(rest == 3, "  ").when(rest == 4, F.concat(line, F.lit("\0"))).when(rest == 5, F.substring(line, 1, 12)).when(rest == 6, "[1, 2]").when(rest == 7, F.concat(F.lit(" \t"), line, F.lit(" "))).otherwise(line).alias("value"))
    spark = lines.sparkSession
    place = files.scratch(spark, "jsonl")
    lines.write.text(place)
    return files.jsonl_tolerant(spark, place, "call_id long, call_type string, tokens int")


@query("SELECT call_type, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1", "calls")
def s3_jsonl_strict(read):
    rows = calls(read).select("call_id", "call_type", "tokens")
    place = files.scratch(rows.sparkSession, "jsonl-strict")
    rows.write.json(place)
    return files.jsonl_strict(rows.sparkSession, place, "call_id long, call_type string, tokens int").groupBy("call_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SELECT paper_id::VARCHAR AS id, count(DISTINCT configuration) AS n_sources, string_agg(DISTINCT configuration, ',' ORDER BY configuration) AS sources FROM usages GROUP BY 1", "usages")
def s4_id_lines(read):
    """Ids of two sources, a folder each, with blank lines between, merged to one row an id."""
    use = usages(read)
    place = files.scratch(use.sparkSession, "ids")
    parts = []
    for name in ("F", "O"):
        lines = use.where(F.col("configuration") == name).select(F.explode(F.array(F.concat(F.lit(" "), F.col("paper_id"), F.lit("\t")), F.lit(" "))).alias("value"))
        lines.write.text(f"{place}/{name}")
        parts.append(files.id_lines(use.sparkSession, f"{place}/{name}").select("id", F.lit(name).alias("source")))
    return parts[0].unionByName(parts[1]).groupBy("id").agg(F.count_distinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(
    """SELECT instrument_id, concat_ws('; ', CASE WHEN instrument_id % 7 = 0 THEN 'mission_code must not be empty' END, CASE WHEN instrument_id % 5 = 0 THEN 'data_system must not be empty' END) AS errors FROM instruments WHERE instrument_id % 7 = 0 OR instrument_id % 5 = 0""",
    "instruments",
)
def s5_catalog_errors(read):
    """Rows of a catalog that a scan refuses, with all that is wrong with each."""
    k = F.col("instrument_id")
    rows = instruments(read).select(k, F.when(k % 7 != 0, F.col("mission")).otherwise(" \t").alias("mission_code"), F.col("instrument").alias("mission_name"), F.when(k % 5 != 0, F.lit(" VSO ")).alias("data_system"))
    return files.catalog_errors(rows, "instrument_id").select("instrument_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT instrument_id, mission AS mission_code, CASE WHEN channels % 3 = 0 THEN 'vso' WHEN channels % 3 = 1 THEN 'cdaweb' ELSE 'other' END AS data_system, channels % 3 < 2 AS known_system FROM instruments", "instruments")
def s5_catalog_scan(read):
    """A catalog written as JSON documents and read with its checks."""
    k = F.col("channels") % 3
    rows = instruments(read).select("instrument_id", F.concat(F.lit(" "), F.col("mission")).alias("mission_code"), F.col("instrument").alias("mission_name"), F.when(k == 0, " VSO").when(k == 1, "CDAWeb ").otherwise("Other").alias("data_system"))
    place = files.scratch(rows.sparkSession, "catalog")
    rows.write.json(place)
    found = files.json_catalog(rows.sparkSession, place, "instrument_id long, mission_code string, mission_name string, data_system string", "instrument_id", lines=True)
    return found.select("instrument_id", "mission_code", "data_system", "known_system")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, len(embedding) AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def s6_embeddings_scan(read):
    """All vectors written as NumPy files in order of their ids, and read back by the source of such files, counted against the catalog's ids."""
    e = read("embeddings").select("vec_id", "embedding")
    spark, place = e.sparkSession, files.scratch(e.sparkSession, "npy")
    npy.write_npy(e.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id"), place, "embedding")
    npy.register(spark)
    vectors = spark.read.format("npy").option("rows", 700).load(place)
    counted = files.check_counts(vectors, e.select("vec_id"))
    return counted.select("row", F.size("vector").alias("size"), F.round(F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT 'hkp:' || replace(mission, '#', '') || '_' || instrument_id AS iri, instrument AS label FROM instruments WHERE channels % 4 <> 3 AND channels % 5 <> 4", "instruments")
def s7_turtle(read):
    """An ontology of instruments: short and full subjects of two types, some of another type or without an English label."""
    k, base = F.col("channels") % 4, "http://terms.example/p#"
    local = F.concat(F.replace("mission", F.lit("#"), F.lit("")), F.lit("_"), "instrument_id")
    subject = F.when(k % 2 == 0, F.concat(F.lit("hkp:"), local)).otherwise(F.concat(F.lit(f"<{base}"), local, F.lit(">")))
    kind = F.when(k == 3, "hk:Other").when(k == 0, "hk:Phenomenon").otherwise("hkp:PrincipalPhenomenon")
    label = F.concat(F.lit('    skos:prefLabel "'), F.col("instrument"), F.when(F.col("channels") % 5 == 4, '"@fr .').otherwise('"@en .'))
    stanza = F.concat(F.lit(f"@prefix hkp: <{base}> .\n"), subject, F.lit(" rdf:type "), kind, F.lit(" ;\n"), label, F.lit("\n"))
    rows = instruments(read).select(stanza.alias("value"))
    place = files.scratch(rows.sparkSession, "turtle")
    rows.write.text(place)
    return files.turtle_terms(rows.sparkSession, place, "hkp", ["hk:Phenomenon", "hkp:PrincipalPhenomenon"])


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def s8_static_dataset(read):
    rows = read("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    place = files.scratch(rows.sparkSession, "static")
    rows.write.json(place)
    return files.static_dataset(rows.sparkSession, place, lines=True).select(F.col("id").cast(rows.schema["id"].dataType).alias("id"), "name")


@query(
    """, ids AS (SELECT DISTINCT paper_id + 3 AS paper_id FROM usages) SELECT ids.paper_id, tag, papers.paper_id IS NOT NULL AS found FROM ids LEFT JOIN papers ON papers.paper_id = ids.paper_id""",
    "usages",
    "papers",
)
def s11_batch_lookup(read):
    """Ids of which some are unknown, looked up in one join."""
    return files.looked_up(usages(read).select((F.col("paper_id") + 3).alias("paper_id")), papers(read).select("paper_id", "tag"), "paper_id")


@query("SELECT DISTINCT observatory AS Bibcode, 'https://papers.example/abs/' || url_encode(observatory || ' & co/' || country) AS URL FROM observatories", "observatories")
def s13_csv_sink(read):
    """Distinct addresses in order, written as CSV with a header and read back."""
    rows = observatories(read).select(F.col("observatory").alias("Bibcode"), F.concat(F.lit("https://papers.example/abs/"), percent_encode(F.concat("observatory", F.lit(" & co/"), "country"))).alias("URL")).distinct()
    place = files.scratch(rows.sparkSession, "csv")
    files.write_csv(rows, place, "Bibcode", "URL")
    return rows.sparkSession.read.option("header", True).csv(place)


@query(
    """SELECT call_id, call_type, model FROM calls WHERE call_type IN ('click', 'error') AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-10' AND (contains(props, '1') OR model % 4 = 0) ORDER BY call_id LIMIT 500""",
    "calls",
)
def s14_jsonl_export(read):
    """Calls of two types, a span of time and any of two tags, the first 500 in order, as JSON lines."""
    rows = calls(read).select("call_id", "call_type", "model", "created_at", "props")
    fits = F.col("call_type").isin("click", "error") & (F.col("created_at") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("created_at") < F.lit("2024-01-10").cast("timestamp")) & (F.contains("props", F.lit("1")) | (F.col("model") % 4 == 0))
    place = files.scratch(rows.sparkSession, "export")
    files.write_jsonl(rows, place, where=fits, order="call_id", limit=500)
    return rows.sparkSession.read.schema("call_id long, call_type string, model long").json(place)


@query("SELECT c_custkey AS author_id, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS wave FROM customer")
def s16_resumable_append(read):
    """A first run writes a third of the rows; the second, over all, adds the others only, and a third one nothing."""
    rows = read("customer").select(F.col("c_custkey").alias("author_id"), F.col("c_mktsegment").alias("segment"))
    wave = lambda k: rows.withColumn("wave", F.lit(k))
    place = files.scratch(rows.sparkSession, "append")
    files.append_missing(wave(1).where("author_id % 3 = 0"), place, "author_id")
    files.append_missing(wave(2), place, "author_id")
    if files.append_missing(wave(3), place, "author_id"):
        raise ValueError("rows were appended twice")
    return rows.sparkSession.read.schema(wave(1).schema).json(place)


@query(
    """, p AS (SELECT paper_id || '-' || configuration AS analysis_id, paper_id, u.instrument_id, observatory_id, instrument, mission, channels, (paper_id + observatory_id) % 9 AS odd, win_start, win_end FROM usages u JOIN instruments USING (instrument_id)),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY analysis_id ORDER BY instrument_id) - 1 AS instrument_index,
      row_number() OVER (PARTITION BY analysis_id, instrument_id ORDER BY CASE WHEN odd = 0 THEN win_end ELSE win_start END, CASE odd WHEN 0 THEN strftime(win_start, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'unknown' ELSE strftime(win_end, '%Y-%m-%dT%H:%M:%SZ') END, 'seen by ' || observatory_id) - 1 AS period_index FROM p)
    SELECT analysis_id, instrument_index, period_index, 'flux ' || observatory_id AS original, strftime(CASE WHEN odd = 0 THEN win_end ELSE win_start END, '%Y-%m-%dT%H:%M:%SZ') AS normalized FROM n WHERE odd <> 1""",
    "usages",
    "instruments",
)
def s17_test_cases(read):
    """Pairs of what a paper says and what it was normalized to, with the places in the document that they come from."""
    from litquarry.operators.materialize import NORMALIZED

    parsed = analyses(read).select("analysis_id", F.posexplode(F.from_json("details", NORMALIZED)["instruments"]).alias("instrument_index", "x"))
    each = parsed.select("analysis_id", "instrument_index", F.posexplode("x.data_collection_periods").alias("period_index", "p"))
    tells = F.col("p.time_range.normalized")
    return each.where(F.try_to_timestamp(tells["end_datetime"]).isNotNull()).select("analysis_id", "instrument_index", "period_index", F.col("p.physical_observable").alias("original"), tells["start_datetime"].alias("normalized"))


@query(
    """, p AS (SELECT paper_id || '-' || configuration AS analysis_id, paper_id, u.instrument_id, observatory_id, instrument, mission, channels, (paper_id + observatory_id) % 9 AS odd, win_start, win_end FROM usages u JOIN instruments USING (instrument_id)),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY analysis_id ORDER BY instrument_id) - 1 AS instrument_index,
      row_number() OVER (PARTITION BY analysis_id, instrument_id ORDER BY CASE WHEN odd = 0 THEN win_end ELSE win_start END, CASE odd WHEN 0 THEN strftime(win_start, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'unknown' ELSE strftime(win_end, '%Y-%m-%dT%H:%M:%SZ') END, 'seen by ' || observatory_id) - 1 AS period_index FROM p)
    SELECT analysis_id, instrument_index, period_index, CASE WHEN hit AND paper_id % 4 < 2 THEN 'new ' || analysis_id ELSE 'flux ' || observatory_id END AS observable, CASE WHEN hit AND paper_id % 4 >= 2 THEN 'new ' || analysis_id ELSE start END AS start
    FROM (SELECT *, instrument_index = paper_id % 3 AND period_index = paper_id % 2 AS hit, CASE WHEN odd = 0 THEN strftime(win_end, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(win_start, '%Y-%m-%dT%H:%M:%SZ') END AS start FROM n)""",
    "usages",
    "instruments",
)
def r12_patches(read):
    """Every normalized document with one field of one period set by its path, two steps or four below the period; paths that lead nowhere change nothing."""
    from litquarry.operators.materialize import NORMALIZED

    schema, k = StructType.fromDDL(NORMALIZED), F.col("paper_id")
    field = F.when(k % 4 < 2, "physical_observable").otherwise("time_range.normalized.start_datetime")
    path = F.concat(F.lit("instruments["), k % 3, F.lit("].data_collection_periods["), k % 2, F.lit("]."), field)
    parsed = analyses(read).select("analysis_id", "paper_id", F.from_json("details", schema).alias("d"))
    told = parsed.select("analysis_id", patches.apply_patch(F.col("d"), schema, path, F.concat(F.lit("new "), "analysis_id")).alias("d"))
    each = told.select("analysis_id", F.posexplode("d.instruments").alias("instrument_index", "x"))
    periods = each.select("analysis_id", "instrument_index", F.posexplode("x.data_collection_periods").alias("period_index", "p"))
    return periods.select("analysis_id", "instrument_index", "period_index", F.col("p.physical_observable").alias("observable"), F.col("p.time_range.normalized.start_datetime").alias("start"))

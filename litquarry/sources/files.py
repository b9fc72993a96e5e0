"""Readers and sinks of text formats: JSON lines, id lists, catalogs, Turtle, NumPy arrays, CSV, resumable appends.

All take any path that Spark reads. ``scratch`` is a new folder of the cluster's shared store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litquarry.functions.text import BLANKS

#: Data systems that a catalog may name without a warning.
KNOWN_SYSTEMS = ("vso", "cdaweb", "pds")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session of one machine may leave that unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{sc.applicationId}"
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder of the shared store."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``rows`` as a Parquet table of the shared store, read back: what uses it twice does not make it twice."""
    path = path or scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_states(rows: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that ``rows`` reads, in order of their paths."""
    spark = rows.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in sorted(rows.inputFiles()):
        state = path(name).getFileSystem(conf).getFileStatus(path(name))
        found.append((name, state.getLen(), state.getModificationTime()))
    return found


def parts_for(rows: DataFrame, *, mb: int = 8) -> int:
    """Into how many parts to deal what is made of ``rows``, so that a part stems from about ``mb`` of the files they are read from.

    What a task holds then stays the same, however large the table is. There are as many parts as cores at least.
    """
    size = sum(n for _, n, _ in file_states(rows))
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // (mb << 20)))


def exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Give a file or folder of the shared store another name; False if that is taken."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return not exists(spark, new) and path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(old), path(new))


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines, lines with a NUL and lines that hold no JSON object are left out."""
    lines = spark.read.text(path).select(F.btrim("value", F.lit(BLANKS)).alias("line")).where((F.col("line") != "") & ~F.contains(F.col("line"), F.lit("\0")))
    sound = lines.where(F.get_json_object("line", "$").startswith("{"))
    return sound.select(F.from_json("line", schema).alias("r")).select("r.*")


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; the first bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, source): one id a line without the blanks around it, and the file's name without its ending. Empty lines are none."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path).select(F.btrim("value", F.lit(BLANKS)).alias("id"), name.alias("source")).where("id <> ''")


def catalog_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, errors) of catalog rows that lack a mission's code or name or a data system; blanks are nothing."""
    blank = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(BLANKS)) == ""
    errors = F.array_compact(F.array(*(F.when(blank(c), F.lit(f"{c} must not be empty")) for c in ("mission_code", "mission_name", "data_system"))))
    return rows.select(key, errors.alias("errors")).where(F.size("errors") > 0)


def catalog_rows(rows: DataFrame) -> DataFrame:
    """Catalog rows trimmed, the data system in lower case, with ``known_system``; an unknown system is only marked."""
    trimmed = {c: F.btrim(c, F.lit(BLANKS)) for c in ("mission_code", "mission_name")} | {"data_system": F.lower(F.btrim("data_system", F.lit(BLANKS)))}
    return rows.withColumns(trimmed).withColumn("known_system", F.col("data_system").isin(*KNOWN_SYSTEMS))


def json_catalog(spark: SparkSession, path: str, schema: str, key: str, *, lines: bool = False) -> DataFrame:
    """A catalog in JSON (an array a file, or one object a line), every row checked. Bad rows raise an error that lists ten."""
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    first = catalog_errors(rows, key).orderBy(key).limit(10).collect()
    if first:
        raise ValueError("invalid catalog rows: " + "; ".join(f"{r[key]}: {', '.join(r['errors'])}" for r in first))
    return catalog_rows(rows)


def check_counts(vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """``vectors``, once it is sure that there are as many of them as rows of the catalog."""
    n, wanted = vectors.count(), catalog.count()
    if n != wanted:
        raise ValueError(f"{n} vectors for {wanted} catalog rows")
    return vectors


def turtle_terms(spark: SparkSession, path: str, prefix: str, types: list[str]) -> DataFrame:
    """(iri, label) of the stanzas of Turtle files whose subject has ``prefix`` and that state one of the ``types``.

    A stanza begins at a line that isn't indented, and a prefix is declared within one. Subjects are written with the
    prefix or with its address in full. Of a subject that comes twice, the last label in the alphabet stays.

    Files are read line by line, in as many splits as they have. Stanzas are numbered within each split, and the splits
    of a file, of which there are few, are added up: no task meets a whole file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    before = Window.partitionBy("file", "block").orderBy("line")
    dealt = written(lines.withColumn("n", F.sum(F.col("value").rlike(r"^\S").cast("long")).over(before)), "turtle-lines")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("file", "block").agg(F.max("n").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    told = dealt.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("first") + F.col("n")).alias("k"), F.struct("block", "line", "value").alias("x"))
    stanzas = told.groupBy("file", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["value"]), "\n").alias("stanza"))
    declared = stanzas.select("file", "k", F.regexp_extract("stanza", rf"@prefix\s+{prefix}:\s*<([^>]+)>", 1).alias("base")).where("base <> ''")
    bases = declared.groupBy("file").agg(F.min_by("base", "k").alias("base"))
    each = stanzas.join(F.broadcast(bases), "file", "left").select(F.coalesce("base", F.lit("")).alias("base"), "stanza")
    short, full = F.regexp_extract("stanza", rf"^({prefix}:\S+)", 1), F.regexp_extract("stanza", r"^<([^>]+)>", 1)
    iri = F.when(short != "", short).when((full != "") & full.startswith(F.col("base")), F.concat(F.lit(f"{prefix}:"), F.substr(full, F.length("base") + 1)))
    stated = F.lit(False)
    for t in types:
        stated = stated | F.contains(F.col("stanza"), F.lit(f"rdf:type {t}"))
    label = F.nullif(F.regexp_extract("stanza", r'skos:prefLabel\s+"([^"]+)"@en', 1), F.lit(""))
    return each.where(stated).select(iri.alias("iri"), label.alias("label")).where("iri IS NOT NULL AND label IS NOT NULL").groupBy("iri").agg(F.max("label").alias("label"))


def static_dataset(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """A small JSON dataset as it is: an array a file, or one object a line."""
    return spark.read.option("multiLine", not lines).json(path)


def looked_up(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``ids``, each once, with what ``table`` has for them and ``found``."""
    marked = table.withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(marked, key, "left").fillna(False, ["found"])


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """CSV with a header, in order; ``order`` sorts by ranges, so that no task holds all rows."""
    rows.orderBy(*order).write.option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, *, where: Column | None = None, order: str = "created_at", limit: int | None = None) -> None:
    """JSON lines of the rows that fit, in order, at most ``limit`` of them."""
    kept = rows.where(where) if where is not None else rows
    sorted_ = kept.orderBy(order)
    (sorted_ if limit is None else sorted_.limit(limit)).write.json(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the JSON lines at ``path`` lack; returns how many. Running it again adds nothing.

    The new rows are worked out once, as a table of the shared store, and the output is read for its keys only. A run
    that is cut off may leave some of its files: ``streaming.flows.append_batch`` is for sinks where that must not be.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    if exists(spark, path):
        new = new.join(spark.read.schema(rows.schema).json(path).select(key), key, "left_anti")
    kept = written(new, "appended")
    kept.write.mode("append").json(path)
    return kept.count()

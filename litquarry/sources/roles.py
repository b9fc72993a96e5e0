"""Star-schema tables in the roles of papers, dataset usages, instruments, votes and model calls.

Each function takes a reader of tables and returns a frame with the role's column names. The SQL of the same roles is
in ``ROLE_SQL``, as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Reader = Callable[[str], DataFrame]


def reader(spark: SparkSession, sf_dir: str) -> Reader:
    """Reads tables of a folder; a table's footers are looked at once a reader, however often a plan names it."""
    schemas: dict[str, StructType] = {}

    def read(name: str) -> DataFrame:
        rows = (spark.read.schema(schemas[name]) if name in schemas else spark.read).parquet(f"{sf_dir}/{name}.parquet")
        schemas.setdefault(name, rows.schema)
        return rows

    return read


def usages(read: Reader) -> DataFrame:
    """Dataset usages: a paper used an instrument over a closed time window, with a validation status."""
    line = read("lineitem")
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "O", "pending").otherwise("needs_review")
    return line.select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_partkey").alias("instrument_id"),
        F.col("l_suppkey").alias("observatory_id"),
        F.col("l_linestatus").alias("configuration"),
        F.col("l_shipdate").cast("timestamp").alias("win_start"),
        F.expr("cast(l_shipdate as timestamp) + make_dt_interval(cast(l_quantity as int))").alias("win_end"),
        status.alias("status"),
        F.col("l_extendedprice").alias("cost"),
    )


def instruments(read: Reader) -> DataFrame:
    part = read("part")
    return part.select(F.col("p_partkey").alias("instrument_id"), F.col("p_name").alias("instrument"), F.col("p_brand").alias("mission"), F.col("p_type").alias("kind"), F.col("p_size").alias("channels"))


def observatories(read: Reader) -> DataFrame:
    """Observatories with their country and data source (supplier, nation, region)."""
    nation, region = read("nation"), read("region")
    return (
        read("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("observatory_id"), F.col("s_name").alias("observatory"), F.col("n_name").alias("country"), F.col("r_name").alias("datasource"))
    )


def papers(read: Reader) -> DataFrame:
    return read("orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("state"))


def calls(read: Reader) -> DataFrame:
    """Model calls with their cost and tokens."""
    return read("events").select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("call_type"),
        F.col("user_id").alias("model"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("value").alias("cost"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"),
        F.col("props"),
    )


def votes(read: Reader) -> DataFrame:
    """The newest vote of each rater on each item."""
    status = F.when(F.col("event_type").isin("purchase", "signup"), "approved").when(F.col("event_type") == "error", "rejected").otherwise("needs_review")
    every = read("events").select((F.col("event_id") % 500).alias("item_id"), (F.col("user_id") % 5).alias("rater_id"), status.alias("status"), F.col("ts").alias("ts"), "event_id")
    return every.groupBy("item_id", "rater_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


ROLE_SQL = {
    "usages": """usages AS (SELECT l_orderkey AS paper_id, l_partkey AS instrument_id, l_suppkey AS observatory_id,
  l_linestatus AS configuration, l_shipdate AS win_start, l_shipdate + to_days(CAST(l_quantity AS INT)) AS win_end,
  CASE WHEN l_returnflag = 'A' THEN 'approved' WHEN l_returnflag = 'R' THEN 'rejected'
       WHEN l_linestatus = 'O' THEN 'pending' ELSE 'needs_review' END AS status, l_extendedprice AS cost FROM lineitem)""",
    "instruments": """instruments AS (SELECT p_partkey AS instrument_id, p_name AS instrument, p_brand AS mission, p_type AS kind,
  p_size AS channels FROM part)""",
    "observatories": """observatories AS (SELECT s_suppkey AS observatory_id, s_name AS observatory, n_name AS country,
  r_name AS datasource FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "papers": """papers AS (SELECT o_orderkey AS paper_id, o_custkey AS author_id, o_orderpriority AS tag, o_orderdate AS created_at,
  o_totalprice AS size, o_orderstatus AS state FROM orders)""",
    "calls": """calls AS (SELECT event_id AS call_id, event_type AS call_type, user_id AS model, ts AS created_at, value AS cost,
  CAST(json_extract_string(props, '$.k') AS INT) AS tokens, props FROM events)""",
    "votes": """votes AS (SELECT event_id % 500 AS item_id, user_id % 5 AS rater_id,
  arg_max(CASE WHEN event_type IN ('purchase', 'signup') THEN 'approved' WHEN event_type = 'error' THEN 'rejected'
               ELSE 'needs_review' END, (ts, event_id)) AS status FROM events GROUP BY 1, 2)""",
}


def with_roles(*names: str, body: str) -> str:
    """SQL that starts with the roles' common table expressions."""
    return "WITH " + ",\n".join(ROLE_SQL[n] for n in names) + "\n" + body

"""Logical tables of the engine over a dataset folder, and the same as SQL.

Change history is read from orders (commits) and lineitem (their files), the import graph from
neighbouring lines of an order, code files from part. An import is a line that was returned (flag
R) with a quantity of 40 or more and the line after it: this is what makes a line an import in this
binding, about four in a hundred lines, and not a sample; the graph operators take any edges. Spans come from events; everything else is
in the domain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.sources.tables import table


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").alias("is_fix")
    )


def commit_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file_id")).distinct()


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "p_type", "p_brand", F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string")))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("file_id"), path.alias("path"), F.col("p_size").cast("long").alias("max_cyclomatic"))


def imports(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct directed imports between code files."""
    a = table(spark, folder, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40))
    a = a.select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Trace spans: each event's parent is the event of the same user before it."""
    ordered = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("span_id"), F.lag("event_id").over(ordered).alias("parent_id"), F.col("user_id").alias("trace_id"), F.col("event_type").alias("service"),
        "ts", F.col("value").alias("duration"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"),
    )


def latest(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Rows of a reloaded table, one per id: the last load, ties by the smallest other values."""
    rows = table(spark, folder, name).select("id", "loaded_at", *columns)
    order = Window.partitionBy("id").orderBy(F.col("loaded_at").desc(), *[F.col(c).asc_nulls_first() for c in columns])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_sql(name: str, *columns: str) -> str:
    order = ", ".join(["loaded_at DESC", *(f"{c} ASC NULLS FIRST" for c in columns)])
    return f"(SELECT * EXCLUDE (n_) FROM (SELECT id, loaded_at, {', '.join(columns)}, row_number() OVER (PARTITION BY id ORDER BY {order}) AS n_ FROM {name}) WHERE n_ = 1)"


SQL = {
    "commits": "commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS is_fix FROM orders)",
    "cf": "cf AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file_id FROM lineitem)",
    "fl": "fl AS (SELECT p_partkey AS file_id, p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS BIGINT) AS max_cyclomatic FROM part)",
    "im": """im AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
             WHERE a.l_partkey <> b.l_partkey AND a.l_returnflag = 'R' AND a.l_quantity >= 40)""",
    "sp": """sp AS (SELECT event_id AS span_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id, user_id AS trace_id, event_type AS service, ts,
             value AS duration, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status FROM events)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in names)

"""Sinks: keyed upserts into parquet, graph exports, finding reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str) -> str:
    """Keep the newest version per key of the table at ``path`` and ``new``; returns the new generation's path.

    Generations are written beside each other and switched by the caller, so a lost job leaves the
    old one whole. A column that only one side has is null for the rows of the other; a column of
    another type is an error. Ties of the version go to the smallest remaining values.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.parquet(path).unionByName(new, allowMissingColumns=True) if there else new
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *[F.col(c) for c in rows.columns if c not in keys and c != version])
    out = f"{path.rstrip('/')}.next"
    rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").write.mode("overwrite").parquet(out)
    return out


def _xml(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a GraphML document; header 0, nodes 1, edges 2, footer 3."""
    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("node").cast("string")), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src").cast("string")), F.lit('" target="'), _xml(F.col("dst").cast("string")), F.lit('"/>')).alias("line"))
    ends = spark.createDataFrame([(0, '<graphml><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    return ends.unionByName(n).unionByName(e)


def cypher(edges: DataFrame) -> DataFrame:
    """One MERGE statement for each edge."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return edges.select(F.concat(F.lit("MERGE (a:Node {id: "), q("src"), F.lit("}) MERGE (b:Node {id: "), q("dst"), F.lit("}) MERGE (a)-[:LINKS]->(b);")).alias("line"))


def sarif(findings: DataFrame, key: str) -> DataFrame:
    """One SARIF result object for each finding (key, line_no, rule, class)."""
    place = F.struct(F.struct(F.struct(F.col(key).cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.struct(F.col("class").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("line"))


def annotations(findings: DataFrame, key: str) -> DataFrame:
    """One workflow command for each finding, as pull requests show them."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    level = F.when(F.col("class").startswith("CWE"), "error").otherwise("warning")
    return findings.select(F.concat(F.lit("::"), level, F.lit(" file="), safe(F.col(key)), F.lit(",line="), F.col("line_no").cast("string"), F.lit(",title="), safe(F.col("rule")), F.lit("::"), safe(F.col("class"))).alias("line"))


def markdown(rows: DataFrame) -> DataFrame:
    """(part, line) of a table in Markdown: two lines of header at 0 and 1, a line for each row at 2."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    head = rows.sparkSession.createDataFrame([(0, bar(rows.columns)), (1, bar(["-"] * len(rows.columns)))], "part int, line string")
    return head.unionByName(rows.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line")))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def dot(edges: DataFrame) -> DataFrame:
    """(part, line) of a directed graph for Graphviz."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    ends = edges.sparkSession.createDataFrame([(0, "digraph {"), (2, "}")], "part int, line string")
    return ends.unionByName(edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("line")))


def mermaid(edges: DataFrame) -> DataFrame:
    """(part, line) of a directed graph as a Mermaid diagram; nodes get ids of their own, their names become labels."""
    node = lambda c: F.concat(F.lit("n"), F.hex(F.xxhash64(F.col(c).cast("string"))), F.lit('["'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("#quot;")), F.lit('"]'))
    head = edges.sparkSession.createDataFrame([(0, "graph LR")], "part int, line string")
    return head.unionByName(edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), node("src"), F.lit(" --> "), node("dst")).alias("line")))


def capture(rows: DataFrame, folder: str, name: str) -> None:
    """Write a snapshot under a name; taking it again replaces it, others stay."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/snapshot={name}")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots of a folder as one table with their name; columns that came later are null in older ones."""
    return spark.read.option("mergeSchema", "true").option("basePath", folder).parquet(folder)


def timeline(taken: DataFrame, metrics: list[str]) -> DataFrame:
    """(snapshot, metric, value, change): sums of the metrics of each snapshot, and their change since the one before by name."""
    sums = taken.groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(*[F.sum(m).cast("double").alias(m) for m in metrics])
    rows = sums.select("snapshot", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("snapshot", "m.metric", "m.value")
    return rows.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("metric").orderBy("snapshot")))


def prune(log: DataFrame, at: str, now, days: int) -> DataFrame:
    """An audit log without what is older than ``days``; rows without a time stay."""
    return log.where(F.col(at).isNull() | (F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))

"""Symbol queries and plain relational constructs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import module_of
from codeweft.operators import code, graph
from codeweft.plans import bindings as b
from codeweft.sources.tables import table


def _symbols(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return b.latest(spark, folder, "symbols", *columns)


def c15_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions' symbol references resolved by id, qualified and plain name."""
    wanted = b.latest(spark, folder, "decisions", "symbol_id").where("symbol_id <> ''")
    return code.resolve_names(wanted, _symbols(spark, folder, "symbol_id", "fqn", "name"), "symbol_id")


def k8_call_graph(spark: SparkSession, folder: str) -> DataFrame:
    edges = b.imports(spark, folder)
    around = code.call_graph(edges, edges.agg(F.max("src").alias("node")), 3)
    return around.select("node", F.col("depth").cast("long").alias("depth"))


def k11_children(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols below the classes, by depth."""
    symbols = _symbols(spark, folder, "parent_id", "kind")
    below = code.descendants(symbols.where("parent_id is not null"), symbols.where("kind = 'class'").select(F.col("id").alias("node")))
    return below.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


def k27_dead_code(spark: SparkSession, folder: str) -> DataFrame:
    """Exported symbols without children, decisions, embeddings."""
    symbols = _symbols(spark, folder, "symbol_id", "parent_id", "metadata")
    exported = symbols.where(F.get_json_object("metadata", "$.exported") == "true")
    referenced = b.latest(spark, folder, "decisions", "symbol_id").join(symbols.select(F.col("id").alias("sid"), "symbol_id"), "symbol_id").select(F.col("sid").alias("id"))
    parents = symbols.where("parent_id is not null").select(F.col("parent_id").alias("id"))
    embedded = table(spark, folder, "symbol_embeddings").select(F.col("symbol_id").alias("id"))
    return code.dead_code(exported, {"referenced": referenced, "parent": parents, "embedded": embedded}, 0.6)


def l16_duplicate_names(spark: SparkSession, folder: str) -> DataFrame:
    return code.duplicate_names(_symbols(spark, folder, "file_id", "name", "kind", "param_count"), 0.75)


def l17_clones(spark: SparkSession, folder: str) -> DataFrame:
    return code.clone_groups(table(spark, folder, "documents").where("text is not null"), "doc_id", "text", 3)


def m6_debt(spark: SparkSession, folder: str) -> DataFrame:
    files = b.code_files(spark, folder).select("file_id", module_of(F.col("path"), 2).alias("module"), "max_cyclomatic")
    coupled = graph.coupling(b.imports(spark, folder)).select(F.col("node").alias("file_id"), "instability")
    changed = b.commit_files(spark, folder).groupBy("file_id").agg(F.count("*").alias("commits"))
    rows = files.join(coupled, "file_id", "left").join(changed, "file_id", "left").groupBy("module").agg(
        (F.avg("max_cyclomatic") / 50).alias("complexity"), F.avg(F.coalesce("instability", F.lit(0.0))).alias("coupling"), F.avg(F.when(F.col("instability").isNull(), 1.0).otherwise(0.0)).alias("untested"), (F.avg(F.coalesce("commits", F.lit(0))) / 60).alias("churn")
    )
    return code.debt(rows)


def m7_risk(spark: SparkSession, folder: str) -> DataFrame:
    files = b.code_files(spark, folder)
    degree = graph.degrees(b.imports(spark, folder)).select(F.col("node").alias("file_id"), "n_in", "n_out")
    changed = b.commit_files(spark, folder).groupBy("file_id").agg(F.count("*").alias("commits"))
    rows = files.join(degree, "file_id").join(changed, "file_id", "left")
    edges = b.imports(spark, folder)
    blast = graph.blast_radius(edges).withColumnRenamed("node", "file_id")
    fixed = b.commit_files(spark, folder).join(b.commits(spark, folder).where("is_fix"), "commit_id").select("file_id").distinct().withColumn("fixed", F.lit(1))
    rows = rows.join(blast, "file_id", "left").join(fixed, "file_id", "left")
    gap = F.when(F.col("fixed").isNull(), 1.0).otherwise(0.0)
    risk = code.change_risk(F.coalesce("blast", F.lit(0)), F.col("max_cyclomatic"), gap, F.coalesce("commits", F.lit(0)), F.col("n_out") / (F.col("n_in") + F.col("n_out")))
    return rows.select("file_id", risk.alias("risk"))


def d17_reload_lag(spark: SparkSession, folder: str) -> DataFrame:
    """How late reloads of a session came after its first load, in whole hours."""
    s = table(spark, folder, "sessions").groupBy("id").agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("z"), F.count("*").alias("n"))
    return s.where("n > 1").select("id", "n", F.floor((F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 3_600_000_000).alias("hours"))


def d2_shared_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that several sessions touch."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "target_file").where("target_file is not null")
    return calls.groupBy("target_file").agg(F.countDistinct("session_id").alias("sessions")).where("sessions >= 3")


def d4_languages(spark: SparkSession, folder: str) -> DataFrame:
    files = b.latest(spark, folder, "files", "language", "workspace")
    return files.groupBy("workspace").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def d14_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent tool of each session, ties by name."""
    n = b.latest(spark, folder, "tool_calls", "session_id", "tool_name").where("session_id <> ''").groupBy("session_id", "tool_name").agg(F.count("*").alias("n"))
    best = n.groupBy("session_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "tool_name")).alias("b"))
    return best.select("session_id", F.col("b.tool_name").alias("tool_name"), (-F.col("b.n")).alias("n"))


def e5_latest(spark: SparkSession, folder: str) -> DataFrame:
    return b.latest(spark, folder, "sessions", "input_tokens", "output_tokens").select("id", "input_tokens", "output_tokens")


def f4_provenance_top(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best decisions: manual first, then by confidence, hits and id."""
    rows = b.latest(spark, folder, "decisions", "source", "confidence", "hit_count").select("id", "source", "confidence", "hit_count")
    return rows.orderBy(F.when(F.col("source") == "manual", 0).otherwise(1), F.col("confidence").desc_nulls_last(), F.col("hit_count").desc_nulls_last(), "id").limit(50)


def g4_common_customers(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    of = lambda p: orders.where(F.col("o_orderpriority") == p).select("o_custkey")
    return of("1-URGENT").intersect(of("5-LOW"))


def b9_matching_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered list lines per document."""
    lines = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"^[0-9]+\. ")).groupBy("doc_id").agg(F.count("*").alias("n"))


def b2_filters(spark: SparkSession, folder: str) -> DataFrame:
    files = b.latest(spark, folder, "files", "path", "language", "gitignored")
    return files.where(F.col("path").contains("/cache-") | F.col("path").startswith("lib/") & ~F.col("language").isin("markdown", "sql")).where(F.col("gitignored") == 0).select("id", "path")


QUERIES = {f.__name__: f for f in (
    c15_resolved, k8_call_graph, k11_children, k27_dead_code, l16_duplicate_names, l17_clones, m6_debt, m7_risk, d17_reload_lag, d2_shared_files, d4_languages, d14_mode, e5_latest,
    f4_provenance_top, g4_common_customers, b9_matching_lines, b2_filters,
)}

_DEGREE = "dg AS (SELECT node AS file_id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM im UNION ALL SELECT dst, 1, 0 FROM im) GROUP BY 1), ch AS (SELECT file_id, count(*) AS commits FROM cf GROUP BY 1)"
_ROUND = "floor(({0}) * 1000 + 0.5) / 1000"

_SHAPE = "text"
for _shape, _instead in ((r"(//[^\n]*|#[^\n]*)", ""), (r"\"[^\"\n]*\"|'[^'\n]*'", "S"), (r"[\p{L}_][\p{L}\p{N}_]*", "N"), (r"\p{N}+", "0"), (r"[ \t\n\x0b\f\r]+", " ")):
    _SHAPE = "regexp_replace({}, '{}', '{}', 'g')".format(_SHAPE, _shape.replace("'", "''"), _instead)

ORACLES = {
    "l17_clones": f"WITH h AS (SELECT doc_id, substr(sha1({_SHAPE}), 1, 16) AS hash FROM documents WHERE text IS NOT NULL AND len(string_split(text, chr(10))) >= 3) SELECT hash, count(*) AS n, min(doc_id) AS first FROM h GROUP BY 1 HAVING count(*) > 1",
    "m6_debt": b.with_views("im", "fl", "cf") + """, ii AS (SELECT node AS file_id, floor(sum(o)::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS i FROM (SELECT src AS node, 1 AS o FROM im UNION ALL SELECT dst, 0 FROM im) GROUP BY 1), ch AS (SELECT file_id, count(*) AS c FROM cf GROUP BY 1),
      m AS (SELECT regexp_extract(path, '^[^/]+/[^/]+') AS module, avg(max_cyclomatic) / 50 AS x, avg(coalesce(i, 0.0::DOUBLE)) AS k, avg(CASE WHEN i IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS t, avg(coalesce(c, 0)) / 60 AS h FROM fl LEFT JOIN ii USING (file_id) LEFT JOIN ch USING (file_id) GROUP BY 1),
      s AS (SELECT module, floor((least(1, x) * 0.3::DOUBLE + least(1, k) * 0.25::DOUBLE + least(1, t) * 0.25::DOUBLE + least(1, h) * 0.2::DOUBLE) * 1000 + 0.5) / 1000 AS score FROM m)
      SELECT module, score, CASE WHEN score <= 0.2 THEN 'A' WHEN score <= 0.4 THEN 'B' WHEN score <= 0.6 THEN 'C' WHEN score <= 0.8 THEN 'D' ELSE 'F' END AS grade FROM s""",
    "c15_resolved": f"""WITH s AS {b.latest_sql('symbols', 'symbol_id', 'fqn', 'name')}, w AS (SELECT DISTINCT symbol_id AS n FROM {b.latest_sql('decisions', 'symbol_id')} WHERE symbol_id <> ''),
      k AS (SELECT id, 1.0::DOUBLE AS c, symbol_id AS n FROM s UNION ALL SELECT id, 0.9, fqn FROM s UNION ALL SELECT id, 0.7, name FROM s), f AS (SELECT w.n, k.id, k.c, count(*) FILTER (k.c = 0.7::DOUBLE) OVER (PARTITION BY w.n) AS same FROM w LEFT JOIN k ON k.n = w.n QUALIFY row_number() OVER (PARTITION BY w.n ORDER BY k.c DESC, k.id) = 1)
      SELECT n AS symbol_id, id, c AS confidence, coalesce(c = 0.7::DOUBLE AND same >= 10, false) AS weak FROM f""",
    "k8_call_graph": b.with_views("im", recursive=True) + """, dn(node, depth) AS (SELECT max(src), 0 FROM im UNION SELECT im.dst, dn.depth + 1 FROM dn JOIN im ON im.src = dn.node WHERE dn.depth < 3),
      up(node, depth) AS (SELECT max(src), 0 FROM im UNION SELECT im.src, up.depth + 1 FROM up JOIN im ON im.dst = up.node WHERE up.depth < 3)
      SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM dn GROUP BY 1 UNION ALL SELECT node, CAST(-min(depth) AS BIGINT) FROM up GROUP BY 1 HAVING min(depth) > 0""",
    "k11_children": f"""WITH RECURSIVE s AS {b.latest_sql('symbols', 'parent_id', 'kind')}, t(node, depth) AS (SELECT id, 0 FROM s WHERE kind = 'class' UNION SELECT s.id, t.depth + 1 FROM t JOIN s ON s.parent_id = t.node WHERE t.depth < 20)
      SELECT CAST(d AS BIGINT) AS depth, count(*) AS n FROM (SELECT node, min(depth) AS d FROM t GROUP BY 1) GROUP BY 1""",
    "k27_dead_code": f"""WITH s AS {b.latest_sql('symbols', 'symbol_id', 'parent_id', 'metadata')}, d AS (SELECT DISTINCT symbol_id FROM {b.latest_sql('decisions', 'symbol_id')}),
      r AS (SELECT s.id, CASE WHEN s.id NOT IN (SELECT parent_id FROM s WHERE parent_id IS NOT NULL) THEN 1 ELSE 0 END + CASE WHEN s.id NOT IN (SELECT symbol_id FROM symbol_embeddings WHERE symbol_id IS NOT NULL) THEN 1 ELSE 0 END AS f FROM s
        WHERE json_extract_string(metadata, '$.exported') = 'true' AND (symbol_id IS NULL OR symbol_id NOT IN (SELECT symbol_id FROM d WHERE symbol_id IS NOT NULL)))
      SELECT id, floor((f + 1)::DOUBLE / 3 * 1000 + 0.5) / 1000 AS confidence FROM r WHERE floor((f + 1)::DOUBLE / 3 * 1000 + 0.5) / 1000 >= 0.6""",
    "m7_risk": b.with_views("im", "fl", "cf", "commits") + f", {_DEGREE}, e2 AS (SELECT src, dst FROM im UNION SELECT z.src, a.dst FROM im a JOIN im z ON z.dst = a.src WHERE z.src <> a.dst), bl AS (SELECT dst AS file_id, count(*) AS blast FROM e2 GROUP BY 1), fx AS (SELECT DISTINCT file_id, 1 AS fixed FROM cf JOIN commits USING (commit_id) WHERE is_fix) SELECT fl.file_id, " + _ROUND.format("least(1, coalesce(blast, 0) / 50.0::DOUBLE) * 0.25::DOUBLE + least(1, max_cyclomatic / 20.0::DOUBLE) * 0.2::DOUBLE + CASE WHEN fixed IS NULL THEN 1.0::DOUBLE ELSE 0 END * 0.2::DOUBLE + least(1, coalesce(commits, 0) / 30.0::DOUBLE) * 0.2::DOUBLE + n_out::DOUBLE / (n_in + n_out) * 0.15::DOUBLE") + " AS risk FROM fl JOIN dg USING (file_id) LEFT JOIN ch USING (file_id) LEFT JOIN bl USING (file_id) LEFT JOIN fx USING (file_id)",
    "d17_reload_lag": "SELECT id, count(*) AS n, CAST(floor((epoch_us(max(loaded_at)) - epoch_us(min(loaded_at))) / 3600000000) AS BIGINT) AS hours FROM sessions GROUP BY 1 HAVING count(*) > 1",
    "d2_shared_files": f"WITH c AS {b.latest_sql('tool_calls', 'session_id', 'target_file')} SELECT target_file, count(DISTINCT session_id) AS sessions FROM c WHERE target_file IS NOT NULL GROUP BY 1 HAVING count(DISTINCT session_id) >= 3",
    "d4_languages": f"WITH f AS {b.latest_sql('files', 'language', 'workspace')} SELECT workspace, count(*) AS n, array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ',') AS languages FROM f GROUP BY 1",
    "d14_mode": f"WITH c AS {b.latest_sql('tool_calls', 'session_id', 'tool_name')} SELECT session_id, tool_name, count(*) AS n FROM c WHERE session_id <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, tool_name) = 1",
    "e5_latest": f"SELECT id, input_tokens, output_tokens FROM {b.latest_sql('sessions', 'input_tokens', 'output_tokens')}",
    "f4_provenance_top": f"SELECT id, source, confidence, hit_count FROM {b.latest_sql('decisions', 'source', 'confidence', 'hit_count')} ORDER BY CASE WHEN source = 'manual' THEN 0 ELSE 1 END, confidence DESC NULLS LAST, hit_count DESC NULLS LAST, id LIMIT 50",
    "g4_common_customers": "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'",
    "b9_matching_lines": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^[0-9]+\\. ') GROUP BY 1",
    "b2_filters": f"SELECT id, path FROM {b.latest_sql('files', 'path', 'language', 'gitignored')} WHERE (contains(path, '/cache-') OR starts_with(path, 'lib/') AND language NOT IN ('markdown', 'sql')) AND gitignored = 0",
}

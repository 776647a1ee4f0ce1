"""Queries of structure, impact, packages, projects and code rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import module_of, round_half_up, timestamp_of, url_pattern
from codeweft.operators import curation, detectors, flows, graph, graph_local, hierarchy, history, packages, telemetry
from codeweft.plans import bindings as b
from codeweft.plans.activity_queries import _PATTERN
from codeweft.runtime import materialise
from codeweft.sources.tables import table


def _calls_between_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Symbol edges (a line calls the next one of its order, by ship mode) and the lines as symbols of parts."""
    lines = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_partkey").alias("file_id"), F.col("l_returnflag").alias("workspace"), F.col("l_linestatus").alias("type"))
    return lines.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"), "type"), lines.select("node", "file_id", "workspace")


def k3_projection(spark: SparkSession, folder: str) -> DataFrame:
    """File edges of the edges within a workspace, without those of one type."""
    edges, nodes = _calls_between_lines(spark, folder)
    return graph.project_typed(edges, nodes, excluded=["F"])


def k5_traverse(spark: SparkSession, folder: str) -> DataFrame:
    """A walk of up to 60 nodes from the first importer."""
    edges = b.imports(spark, folder).withColumn("type", F.lit("imports"))
    start = edges.agg(F.min("src")).first()[0]
    nodes, _ = graph.traverse(edges, start, max_depth=3, max_nodes=60, token_budget=None)
    return nodes.select("node", F.col("depth").cast("long").alias("depth"), "in_degree")


def _heritage(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as classes: each extends the one of half its number."""
    return table(spark, folder, "supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("sub"), F.expr("s_suppkey div 2").alias("sup"))


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    """Their methods: a first line for each supplier, ship mode and return flag."""
    lines = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linestatus", "l_returnflag").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("method"))
    return lines.select("method", F.col("l_suppkey").alias("class"), F.concat_ws("_", "l_linestatus", "l_returnflag").alias("name"))


def k10_overrides(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.overrides(_methods(spark, folder), _heritage(spark, folder))


def k10_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.closure(_heritage(spark, folder), 20).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


def k12_implementations(spark: SparkSession, folder: str) -> DataFrame:
    """Classes whose signature names ``cursor`` among what they take."""
    rows = b.latest(spark, folder, "symbols", "name", "kind", "signature").where("kind in ('class', 'interface', 'method')")
    sups = F.transform(F.split(F.regexp_extract("signature", r"\((.*)\)", 1), ","), lambda x: F.trim(x))
    return hierarchy.implementations(rows.withColumn("sups", sups), "cursor").select("id", "name", "kind")


def _tests_of(spark: SparkSession, folder: str) -> DataFrame:
    """How many fixes touched a file: the tests of the binding."""
    fixed = b.commit_files(spark, folder).join(b.commits(spark, folder).where("is_fix"), "commit_id")
    return fixed.groupBy(F.col("file_id").alias("node")).agg(F.count("*").alias("n_tests"))


def k26_change_impact(spark: SparkSession, folder: str) -> DataFrame:
    """What a change of the most imported file reaches, hidden dependents included, with the risk of each."""
    edges = materialise(b.imports(spark, folder))
    changed = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "node").limit(1).select("node")
    facts = b.code_files(spark, folder).select(F.col("file_id").alias("node"), F.col("max_cyclomatic").alias("complexity"))
    return graph.impact(edges, changed, facts, history.co_changes(b.commit_files(spark, folder)), _tests_of(spark, folder), max_depth=2)


def k34_health(spark: SparkSession, folder: str) -> DataFrame:
    """The repository in one row: files, edges, files in cycles, mean instability, largest degree, files nobody imports."""
    edges = materialise(b.imports(spark, folder))
    coupled = graph.coupling(edges).agg(round_half_up(F.avg("instability"), 4).alias("instability"), F.max(F.col("ca") + F.col("ce")).alias("largest_degree"), F.count_if(F.col("ca") == 0).alias("not_imported"))
    cyclic = (graph_local.strong_components if edges.count() <= graph_local.LOCAL_EDGES else graph.strong_components)(edges).agg(F.count("*").alias("in_cycles"))
    n_files = b.code_files(spark, folder).agg(F.count("*").alias("files"))
    return n_files.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(cyclic).crossJoin(coupled)


def r6_edit_safety(spark: SparkSession, folder: str) -> DataFrame:
    edges = b.imports(spark, folder)
    dependents = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))
    facts = b.code_files(spark, folder).select(F.col("file_id").alias("node"), F.col("max_cyclomatic").alias("complexity"))
    rows = facts.join(dependents, "node", "left").join(_tests_of(spark, folder), "node", "left").na.fill(0, ["dependents", "n_tests"]).withColumnRenamed("n_tests", "tests")
    return detectors.edit_safety(rows).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def k37_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Source files with the number of test files of the folder of the same name."""
    files = b.latest(spark, folder, "files", "path").where("path is not null")
    rows = files.select("id", "path", F.get(F.split("path", "/"), 1).alias("area"), (F.col("path").startswith("tests/") | F.col("path").contains(".test.")).alias("is_test"))
    tests = rows.where("is_test and area is not null").groupBy("area").agg(F.count("*").alias("n_tests"))
    return rows.where(~F.col("is_test") & F.col("path").startswith("src/")).join(tests, "area").select("id", "area", "n_tests")


def c19_renames(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as files of two snapshots (sizes up to 30, and from 20) under other names: renamed where the content (the price) is of one file on each side."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("content"))
    old = parts.where("p_size <= 30").select(F.concat(F.lit("old/"), F.col("p_partkey").cast("string")).alias("path"), "content")
    new = parts.where("p_size >= 20").select(F.concat(F.lit("new/"), F.col("p_partkey").cast("string")).alias("path"), "content")
    return graph.renames(old, new, "path", "content")


def q2_service_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of services with endpoints of the same method and pattern."""
    e = b.latest(spark, folder, "api_endpoints", "service_id", "method", "path").where("path is not null and method is not null")
    keyed = e.select("service_id", F.concat_ws(" ", F.upper("method"), url_pattern(F.col("path"))).alias("endpoint")).distinct()
    a, z = keyed.withColumnRenamed("service_id", "service_a"), keyed.withColumnRenamed("service_id", "service_b")
    return a.join(z, "endpoint").where("service_a < service_b").groupBy("service_a", "service_b").agg(F.count("*").alias("n"))


def q3_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Operations with a request or response schema, per contract."""
    e = b.latest(spark, folder, "api_endpoints", "contract_id", "request_schema", "response_schema")
    kind = lambda c: F.get_json_object(c, "$.type")
    return e.groupBy("contract_id").agg(F.count("*").alias("n"), F.count_if(kind("request_schema") == "object").alias("objects"), F.count_if(kind("response_schema") == "array").alias("arrays"))


def _installs(spark: SparkSession, folder: str) -> DataFrame:
    """(project, package, version, at) of packages that commands install."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "timestamp", "input_snippet").where(F.col("input_snippet").startswith("npm i "))
    package, version = F.regexp_extract("input_snippet", r"^npm i (@?[^@\s]+)@", 1), F.regexp_extract("input_snippet", r"@([0-9][^@\s]*)$", 1)
    rows = calls.select("session_id", timestamp_of(F.col("timestamp")).alias("at"), package.alias("package"), version.alias("version")).where("package <> '' and version <> ''")
    sessions = b.latest(spark, folder, "sessions", "project_path").select(F.col("id").alias("session_id"), F.col("project_path").alias("project"))
    return rows.join(sessions, "session_id").where("project is not null").select("project", "package", "version", "at")


def q9_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return packages.dependents(_installs(spark, folder), "package", "project")


def q9_batch_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Projects that a change of all packages beginning with a to m reaches."""
    uses = _installs(spark, folder)
    return packages.batch_impact(uses, uses.where(F.regexp_replace("package", "^@[^/]*/", "").rlike("^[a-m]")), "package", "project")


def q9_bill(spark: SparkSession, folder: str) -> DataFrame:
    return packages.bill_of_materials(_installs(spark, folder), "project", "package", "version", "at")


def q5_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between projects and the workspaces whose files their sessions touch."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "target_file").where("target_file is not null")
    sessions = b.latest(spark, folder, "sessions", "project_path").select(F.col("id").alias("session_id"), F.col("project_path").alias("project"))
    files = b.latest(spark, folder, "files", "path", "workspace").where("workspace is not null").select(F.col("path").alias("target_file"), "workspace")
    return packages.project_graph(calls.join(sessions, "session_id").join(files, "target_file"), "project", "workspace")


def q10_index_health(spark: SparkSession, folder: str) -> DataFrame:
    files = b.latest(spark, folder, "files", "status", "byte_length", "indexed_at", "mtime_ms")
    seen = table(spark, folder, "symbols").where("file_id is not null").select(F.col("file_id").alias("id")).distinct().withColumn("_s", F.lit(1))
    return files.join(seen, "id", "left").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("_s").isNull()).alias("without_symbols"), F.sum("byte_length").alias("bytes"), F.count_if(F.col("byte_length").isNull()).alias("unknown_size"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    calls = b.latest(spark, folder, "tool_calls", "input_snippet").where("input_snippet is not null").select(F.col("id").alias("key"), F.col("input_snippet").alias("text"))
    return docs.unionByName(calls)


def r2_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows.taint(_texts(spark, folder), "key", "text")


def r3_antipatterns(spark: SparkSession, folder: str) -> DataFrame:
    return detectors.counted_rules(_texts(spark, folder), "key", F.col("text"), detectors.ANTIPATTERNS)


def r4_smells(spark: SparkSession, folder: str) -> DataFrame:
    return detectors.counted_rules(_texts(spark, folder), "key", F.col("text"), detectors.SMELLS)


def r1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return detectors.counted_rules(_texts(spark, folder), "key", F.col("text"), detectors.RULES)


def r7_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return detectors.complexity_report(b.latest(spark, folder, "symbols", "name", "cyclomatic", "max_nesting", "param_count"))


def usage_models(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions and all four kinds of tokens of each model."""
    kinds = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens"]
    s = b.latest(spark, folder, "sessions", "model", *kinds)
    return s.groupBy("model").agg(F.count("*").alias("sessions"), *[F.sum(k).alias(k) for k in kinds])


def usage_technologies(spark: SparkSession, folder: str) -> DataFrame:
    """Languages in use that no rule knows."""
    known = ["typescript", "javascript", "python", "go", "rust", "java", "ruby", "php", "kotlin", "c", "css", "sql", "yaml", "json", "markdown", "vue"]
    files = b.latest(spark, folder, "files", "language").where("language is not null")
    return files.groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("n")).where(~F.col("language").isin(known))


def usage_savings(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of whole-file reads of indexed files, and what an outline and one symbol would have cost."""
    calls = b.latest(spark, folder, "tool_calls", "tool_short_name", "target_file", "output_tokens_estimate").where("tool_short_name = 'Read' and target_file is not null")
    reads = calls.groupBy(F.col("target_file").alias("path")).agg(F.count("*").alias("reads"), F.sum("output_tokens_estimate").alias("tokens"))
    files = b.latest(spark, folder, "files", "path", "byte_length").where("byte_length > 0").select(F.col("id").alias("file_id"), "path", "byte_length")
    symbols = b.latest(spark, folder, "symbols", "file_id", "signature", "byte_start", "byte_end").where("file_id is not null")
    s = symbols.groupBy("file_id").agg(F.sum(F.coalesce(F.length("signature"), F.lit(0))).alias("sig"), F.avg(F.coalesce(F.col("byte_end") - F.col("byte_start"), F.lit(0))).alias("size"))
    outline = F.when(F.col("sig") > 0, F.ceil(F.col("sig") / 3.5)).otherwise(F.ceil(F.col("byte_length") * 0.1 / 3.5))
    cost = F.when(F.col("size").isNull(), F.ceil(F.col("byte_length") * 0.15 / 3.5)).otherwise(outline + F.ceil(F.col("size") / 3.5))
    rows = reads.join(files, "path").join(s, "file_id", "left").select("path", "reads", "tokens", F.least(cost * F.col("reads"), F.col("tokens")).alias("instead"))
    return rows.select("*", F.when(F.col("tokens") > 0, round_half_up((1 - F.col("instead") / F.col("tokens")) * 100, 0)).otherwise(0.0).alias("saved_pct"))


def runtime_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Each operation's requests, errors and latencies, with how many services call it and the most frequent one."""
    spans = b.spans(spark, folder)
    own = telemetry.profile(telemetry.hourly(spans, "service"), "service")
    callers = telemetry.dependencies(spans).groupBy(F.col("callee").alias("service")).agg(F.count("*").alias("callers"), F.max(F.struct("calls", "caller"))["caller"].alias("main_caller"))
    return own.join(callers, "service", "left").select("service", "calls", "errors", round_half_up(F.col("errors") / F.col("calls"), 3).alias("error_rate"), "p50_wavg", "p95_wavg", F.coalesce("callers", F.lit(0)).alias("callers"), "main_caller")


QUERIES = {f.__name__: f for f in (
    k3_projection, k5_traverse, k10_overrides, k10_ancestors, k12_implementations, k26_change_impact, k34_health, r6_edit_safety, k37_tests, c19_renames, q2_service_links, q3_schemas,
    q9_dependents, q9_batch_impact, q9_bill, q5_projects, q10_index_health, r2_flows, r3_antipatterns, r4_smells, r1_classes, r7_complexity, usage_models, usage_technologies, usage_savings, runtime_endpoints,
)}

_TS = "try_cast(replace(replace({0}, 'T', ' '), 'Z', '+00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"
_HERITAGE = "he AS (SELECT s_suppkey AS sub, s_suppkey // 2 AS sup FROM supplier WHERE s_suppkey > 1)"
_INSTALLS = f"""ins AS (SELECT s.project_path AS project, c.* EXCLUDE (session_id) FROM (SELECT session_id, {_TS.format('"timestamp"')} AS moment, regexp_extract(input_snippet, '^npm i (@?[^@\\s]+)@', 1) AS package, regexp_extract(input_snippet, '@([0-9][^@\\s]*)$', 1) AS version
  FROM {b.latest_sql('tool_calls', 'session_id', '"timestamp"', 'input_snippet')} WHERE starts_with(input_snippet, 'npm i ')) c JOIN {b.latest_sql('sessions', 'project_path')} s ON s.id = c.session_id WHERE package <> '' AND version <> '' AND project_path IS NOT NULL)"""
_TESTS = "te AS (SELECT file_id AS node, count(*) AS n_tests FROM cf JOIN commits USING (commit_id) WHERE is_fix GROUP BY 1)"
_R4 = "floor(({0}) * 1e4 + 0.5) / 1e4"


def _rules_sql(rules: list[tuple[str, str, str]]) -> str:
    q = lambda s: s.replace("'", "''")
    each = " UNION ALL ".join(f"SELECT '{n}' AS rule, '{c}' AS class, key FROM l WHERE regexp_matches(line, '{q(p)}')" for n, c, p in rules)
    texts = f"SELECT 'd' || CAST(doc_id AS VARCHAR) AS key, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT id, input_snippet FROM {b.latest_sql('tool_calls', 'input_snippet')} WHERE input_snippet IS NOT NULL"
    return f"WITH t AS ({texts}), l AS (SELECT key, unnest(string_split(text, chr(10))) AS line FROM t), f AS ({each}) SELECT rule, class, count(DISTINCT key) AS texts, count(*) AS lines FROM f GROUP BY 1, 2"


ORACLES = {
    "k3_projection": """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_linestatus <> 'F')
      SELECT DISTINCT a.l_partkey AS src, z.l_partkey AS dst FROM e JOIN lineitem a ON a.l_orderkey = o AND a.l_linenumber = n JOIN lineitem z ON z.l_orderkey = o AND z.l_linenumber = n + 1 WHERE a.l_returnflag = z.l_returnflag AND a.l_partkey <> z.l_partkey""",
    "k5_traverse": b.with_views("im", recursive=True) + """, w(node, depth, path) AS (SELECT min(src), 0, [min(src)] FROM im UNION ALL SELECT im.dst, w.depth + 1, list_append(w.path, im.dst) FROM w JOIN im ON im.src = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, im.dst)),
      f AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), o AS (SELECT w.node, f.depth, min(w.path) AS path FROM w JOIN f ON f.node = w.node AND f.depth = w.depth GROUP BY 1, 2), t AS (SELECT node, depth FROM o ORDER BY depth, path LIMIT 60)
      SELECT t.node, CAST(t.depth AS BIGINT) AS depth, count(s.node) AS in_degree FROM t LEFT JOIN im ON im.dst = t.node LEFT JOIN t s ON s.node = im.src AND s.depth < 3 GROUP BY 1, 2""",
    "k10_overrides": f"""WITH RECURSIVE {_HERITAGE}, m AS (SELECT min(l_orderkey * 10 + l_linenumber) AS method, l_suppkey AS class, l_linestatus || '_' || l_returnflag AS name FROM lineitem GROUP BY 2, 3),
      u(sub, sup, d) AS (SELECT sub, sup, 1 FROM he UNION SELECT u.sub, he.sup, u.d + 1 FROM u JOIN he ON he.sub = u.sup WHERE u.d < 10), p AS (SELECT DISTINCT a.method AS s, z.method AS p FROM m a JOIN u ON u.sub = a.class JOIN m z ON z.class = u.sup AND z.name = a.name WHERE a.method <> z.method)
      SELECT method, method AS other, 'self' AS relation FROM m UNION ALL SELECT s, p, 'ancestor_method' FROM p UNION ALL SELECT p, s, 'descendant_method' FROM p""",
    "k10_ancestors": f"WITH RECURSIVE {_HERITAGE}, u(sub, sup, d) AS (SELECT sub, sup, 1 FROM he UNION SELECT u.sub, he.sup, u.d + 1 FROM u JOIN he ON he.sub = u.sup) SELECT CAST(d AS BIGINT) AS depth, count(*) AS n FROM u GROUP BY 1",
    "k12_implementations": f"SELECT id, name, kind FROM {b.latest_sql('symbols', 'name', 'kind', 'signature')} WHERE kind IN ('class', 'interface', 'method') AND list_contains(list_transform(string_split(regexp_extract(signature, '\\((.*)\\)', 1), ','), lambda x: trim(x)), 'cursor')",
    "k26_change_impact": b.with_views("im", "fl", "cf", "commits", recursive=True) + f""", {_TESTS}, ch AS (SELECT dst AS node FROM im GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), hit(node, depth) AS (SELECT node, 0 FROM ch UNION SELECT im.src, hit.depth + 1 FROM hit JOIN im ON im.dst = hit.node WHERE hit.depth < 2),
      re AS (SELECT node, min(depth) AS depth FROM hit GROUP BY 1 HAVING min(depth) > 0), kept AS (SELECT * FROM cf WHERE commit_id IN (SELECT commit_id FROM cf GROUP BY 1 HAVING count(*) <= 50)), own AS (SELECT file_id, count(*) AS n FROM kept GROUP BY 1),
      cp AS (SELECT z.file_id AS node, count(*) AS together FROM kept a JOIN kept z ON a.commit_id = z.commit_id AND a.file_id <> z.file_id WHERE a.file_id = (SELECT node FROM ch) GROUP BY 1 HAVING count(*) >= 2),
      co AS (SELECT cp.node, floor(together::DOUBLE / (own.n + (SELECT n FROM own WHERE file_id = (SELECT node FROM ch)) - together) * 1000 + 0.5) / 1000 AS coupled FROM cp JOIN own ON own.file_id = cp.node)
      SELECT coalesce(re.node, co.node) AS node, CAST(re.depth AS BIGINT) AS depth, coalesce(co.coupled, 0.0::DOUBLE) AS coupled, coalesce(te.n_tests, 0) AS tests,
        {_R4.format("coalesce(1.0::DOUBLE / re.depth, 0) * 0.4::DOUBLE + least(1.0::DOUBLE, coalesce(fl.max_cyclomatic, 0) / 20.0::DOUBLE) * 0.3::DOUBLE + coalesce(co.coupled, 0) * 0.2::DOUBLE + CASE WHEN te.n_tests IS NULL THEN 0.1::DOUBLE ELSE 0 END")} AS risk
      FROM re FULL JOIN co ON co.node = re.node LEFT JOIN fl ON fl.file_id = coalesce(re.node, co.node) LEFT JOIN te ON te.node = coalesce(re.node, co.node)""",
    "k34_health": b.with_views("im", "fl", recursive=True) + """, hit(node, root) AS (SELECT dst, src FROM im UNION SELECT im.dst, hit.root FROM hit JOIN im ON im.src = hit.node), d AS (SELECT node, sum(i) AS ca, sum(o) AS ce FROM (SELECT src AS node, 0 AS i, 1 AS o FROM im UNION ALL SELECT dst, 1, 0 FROM im) GROUP BY 1)
      SELECT (SELECT count(*) FROM fl) AS files, (SELECT count(*) FROM im) AS edges, (SELECT count(DISTINCT node) FROM hit WHERE node = root) AS in_cycles, floor(avg(floor(ce::DOUBLE / (ca + ce) * 1000 + 0.5) / 1000) * 1e4 + 0.5) / 1e4 AS instability, CAST(max(ca + ce) AS BIGINT) AS largest_degree, count(*) FILTER (ca = 0) AS not_imported FROM d""",
    "r6_edit_safety": b.with_views("im", "fl", "cf", "commits") + f""", {_TESTS}, d AS (SELECT dst AS node, count(*) AS n FROM im GROUP BY 1), p AS (SELECT CASE WHEN coalesce(d.n, 0) >= 10 THEN 2 WHEN coalesce(d.n, 0) >= 3 THEN 1 ELSE 0 END + CASE WHEN max_cyclomatic > 20 THEN 1 ELSE 0 END + CASE WHEN te.n_tests IS NULL THEN 1 ELSE 0 END AS p
      FROM fl LEFT JOIN d ON d.node = file_id LEFT JOIN te ON te.node = file_id) SELECT CASE WHEN p >= 3 THEN 'risky' WHEN p = 2 THEN 'careful' ELSE 'safe' END AS verdict, count(*) AS n, CAST(sum(p) AS BIGINT) AS points FROM p GROUP BY 1""",
    "k37_tests": f"""WITH f AS (SELECT id, path, string_split(path, '/')[2] AS area, starts_with(path, 'tests/') OR contains(path, '.test.') AS is_test FROM {b.latest_sql('files', 'path')} WHERE path IS NOT NULL), t AS (SELECT area, count(*) AS n_tests FROM f WHERE is_test AND area IS NOT NULL GROUP BY 1)
      SELECT f.id, f.area, t.n_tests FROM f JOIN t ON t.area = f.area WHERE NOT is_test AND starts_with(path, 'src/')""",
    "c19_renames": """WITH o AS (SELECT 'old/' || CAST(p_partkey AS VARCHAR) AS path, p_retailprice AS content FROM part WHERE p_size <= 30), n AS (SELECT 'new/' || CAST(p_partkey AS VARCHAR) AS path, p_retailprice AS content FROM part WHERE p_size >= 20),
      a AS (SELECT content, min(path) AS path FROM o GROUP BY 1 HAVING count(*) = 1), z AS (SELECT content, min(path) AS path FROM n GROUP BY 1 HAVING count(*) = 1) SELECT a.path AS old_path, z.path AS new_path FROM a JOIN z USING (content)""",
    "q2_service_links": f"""WITH k AS (SELECT DISTINCT service_id, upper(method) || ' ' || {_PATTERN.format('path')} AS e FROM {b.latest_sql('api_endpoints', 'service_id', 'method', 'path')} WHERE path IS NOT NULL AND method IS NOT NULL)
      SELECT a.service_id AS service_a, z.service_id AS service_b, count(*) AS n FROM k a JOIN k z ON a.e = z.e AND a.service_id < z.service_id GROUP BY 1, 2""",
    "q3_schemas": f"SELECT contract_id, count(*) AS n, count(*) FILTER (json_extract_string(request_schema, '$.type') = 'object') AS objects, count(*) FILTER (json_extract_string(response_schema, '$.type') = 'array') AS arrays FROM {b.latest_sql('api_endpoints', 'contract_id', 'request_schema', 'response_schema')} GROUP BY 1",
    "q9_dependents": f"WITH {_INSTALLS} SELECT package, count(DISTINCT project) AS projects, count(*) AS uses FROM ins GROUP BY 1",
    "q9_batch_impact": f"WITH {_INSTALLS} SELECT project, count(DISTINCT package) AS packages FROM ins WHERE regexp_matches(regexp_replace(package, '^@[^/]*/', ''), '^[a-m]') GROUP BY 1",
    "q9_bill": f"WITH {_INSTALLS} SELECT project, package, first(version ORDER BY moment DESC NULLS LAST, version DESC) AS version, count(DISTINCT version) AS versions FROM ins GROUP BY 1, 2",
    "q5_projects": f"""WITH n AS (SELECT s.project_path AS project, f.workspace, count(*) AS n FROM {b.latest_sql('tool_calls', 'session_id', 'target_file')} c JOIN {b.latest_sql('sessions', 'project_path')} s ON s.id = c.session_id JOIN {b.latest_sql('files', 'path', 'workspace')} f ON f.path = c.target_file
      WHERE f.workspace IS NOT NULL AND s.project_path <> f.workspace GROUP BY 1, 2) SELECT *, {_R4.format('n::DOUBLE / sum(n) OVER (PARTITION BY project)')} AS share FROM n""",
    "q10_index_health": f"SELECT status, count(*) AS n, count(*) FILTER (id NOT IN (SELECT file_id FROM symbols WHERE file_id IS NOT NULL)) AS without_symbols, CAST(sum(byte_length) AS BIGINT) AS bytes, count(*) FILTER (byte_length IS NULL) AS unknown_size FROM {b.latest_sql('files', 'status', 'byte_length', 'indexed_at', 'mtime_ms')} GROUP BY 1",
    "r3_antipatterns": _rules_sql(detectors.ANTIPATTERNS),
    "r4_smells": _rules_sql(detectors.SMELLS),
    "r1_classes": _rules_sql(detectors.RULES),
    "r7_complexity": f"""SELECT id, name, cyclomatic, max_nesting, param_count, concat_ws(',', CASE WHEN cyclomatic > 10 THEN 'complex' END, CASE WHEN max_nesting > 4 THEN 'nested' END, CASE WHEN param_count > 5 THEN 'parameters' END) AS verdict
      FROM {b.latest_sql('symbols', 'name', 'cyclomatic', 'max_nesting', 'param_count')} WHERE cyclomatic >= 5 ORDER BY cyclomatic DESC, max_nesting DESC NULLS LAST, param_count DESC NULLS LAST, id LIMIT 50""",
    "usage_models": "SELECT model, count(*) AS sessions, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens")) + f" FROM {b.latest_sql('sessions', 'model', 'input_tokens', 'output_tokens', 'cache_read_tokens', 'cache_create_tokens')} GROUP BY 1",
    "usage_technologies": f"SELECT lower(language) AS language, count(*) AS n FROM {b.latest_sql('files', 'language')} WHERE language IS NOT NULL AND lower(language) NOT IN ('typescript', 'javascript', 'python', 'go', 'rust', 'java', 'ruby', 'php', 'kotlin', 'c', 'css', 'sql', 'yaml', 'json', 'markdown', 'vue') GROUP BY 1",
    "usage_savings": f"""WITH r AS (SELECT target_file AS path, count(*) AS reads, CAST(sum(output_tokens_estimate) AS BIGINT) AS tokens FROM {b.latest_sql('tool_calls', 'tool_short_name', 'target_file', 'output_tokens_estimate')} WHERE tool_short_name = 'Read' AND target_file IS NOT NULL GROUP BY 1),
      s AS (SELECT file_id, sum(coalesce(length(signature), 0))::DOUBLE AS sig, avg(coalesce(byte_end - byte_start, 0)) AS size FROM {b.latest_sql('symbols', 'file_id', 'signature', 'byte_start', 'byte_end')} WHERE file_id IS NOT NULL GROUP BY 1),
      c AS (SELECT r.*, CAST(CASE WHEN s.size IS NULL THEN ceil(byte_length * 0.15::DOUBLE / 3.5::DOUBLE) ELSE CASE WHEN sig > 0 THEN ceil(sig / 3.5::DOUBLE) ELSE ceil(byte_length * 0.1::DOUBLE / 3.5::DOUBLE) END + ceil(size / 3.5::DOUBLE) END AS BIGINT) AS cost FROM r JOIN {b.latest_sql('files', 'path', 'byte_length')} f ON f.path = r.path LEFT JOIN s ON s.file_id = f.id WHERE byte_length > 0),
      i AS (SELECT path, reads, tokens, least(cost * reads, tokens) AS instead FROM c) SELECT *, CASE WHEN tokens > 0 THEN floor((1 - instead::DOUBLE / tokens) * 100 + 0.5) ELSE 0.0 END::DOUBLE AS saved_pct FROM i""",
    "runtime_endpoints": b.with_views("sp") + """, h AS (SELECT service, date_trunc('hour', ts) AS hour, count(*) AS calls, count(*) FILTER (status = 2) AS errors, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95 FROM sp GROUP BY 1, 2),
      p AS (SELECT service, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, floor(sum(p50 * calls) / sum(calls) * 1000 + 0.5) / 1000 AS p50_wavg, floor(sum(p95 * calls) / sum(calls) * 1000 + 0.5) / 1000 AS p95_wavg FROM h GROUP BY 1),
      d AS (SELECT p.service AS caller, c.service AS callee, count(*) AS calls FROM sp c JOIN sp p ON p.span_id = c.parent_id AND p.trace_id = c.trace_id GROUP BY 1, 2), k AS (SELECT callee AS service, count(*) AS callers, first(caller ORDER BY calls DESC, caller DESC) AS main_caller FROM d GROUP BY 1)
      SELECT p.service, calls, errors, floor(errors::DOUBLE / calls * 1000 + 0.5) / 1000 AS error_rate, p50_wavg, p95_wavg, coalesce(callers, 0) AS callers, main_caller FROM p LEFT JOIN k ON k.service = p.service""",
}

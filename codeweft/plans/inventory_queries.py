"""Further queries of the inventory over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import decay_heat, module_of, recency, round_half_up, segments, timestamp_of
from codeweft.operators import detectors, graph, graph_local, memory
from codeweft.plans import bindings as b
from codeweft.runtime import materialise
from codeweft.sources.tables import table

AT = "2026-01-01"


def k9_references(spark: SparkSession, folder: str) -> DataFrame:
    """Files that import the most imported file, with their complexity."""
    edges = b.imports(spark, folder)
    top = edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dst").limit(1)
    users = edges.join(F.broadcast(top.select("dst")), "dst").select(F.col("src").alias("file_id"))
    return b.code_files(spark, folder).join(users, "file_id").select("file_id", "path", "max_cyclomatic")


def k13_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """Degree of every file in both directions and whether an import is mutual."""
    edges = b.imports(spark, folder)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = edges.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("mutual"))
    return graph.degrees(edges).join(mutual, "node", "left").na.fill(0, ["mutual"])


def k20_bottlenecks(spark: SparkSession, folder: str) -> DataFrame:
    """Edge betweenness over its maximum, raised by the target's complexity."""
    between = materialise(graph_local.edge_betweenness(b.imports(spark, folder)))  # read twice, walked once
    scored = between.join(b.code_files(spark, folder).select(F.col("file_id").alias("dst"), "max_cyclomatic"), "dst")
    most = scored.agg(F.max("betweenness").alias("bm"), F.max("max_cyclomatic").alias("cm"))
    return scored.crossJoin(F.broadcast(most)).select("src", "dst", round_half_up(F.col("betweenness") / F.col("bm") * (1 + F.col("max_cyclomatic") / F.col("cm")), 3).alias("score"))


def k22_module_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Imports between modules: edges, distinct sources and distinct targets."""
    m = b.code_files(spark, folder).select("file_id", module_of(F.col("path"), 2).alias("module"))
    e = b.imports(spark, folder).join(m.select(F.col("file_id").alias("src"), F.col("module").alias("from_module")), "src").join(m.select(F.col("file_id").alias("dst"), F.col("module").alias("to_module")), "dst")
    return e.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_from"), F.countDistinct("dst").alias("n_to"))


def k29_dead_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Exported symbols whose name no command or search mentions."""
    symbols = b.latest(spark, folder, "symbols", "name", "metadata").where((F.get_json_object("metadata", "$.exported") == "true") & F.col("name").isNotNull())
    words = F.explode(F.regexp_extract_all("input_snippet", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    named = table(spark, folder, "tool_calls").where("input_snippet is not null").select(words.alias("name")).distinct()
    return symbols.select("id", "name").join(named, "name", "left_anti").select("id", "name")


def l11_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Files per workspace that changed after they were indexed."""
    files = b.latest(spark, folder, "files", "workspace", "indexed_at", "mtime_ms")
    stale = F.timestamp_millis("mtime_ms") > timestamp_of(F.col("indexed_at"))
    return files.groupBy("workspace").agg(F.count("*").alias("n"), F.count_if(stale).alias("stale"), F.count_if(F.col("mtime_ms").isNull()).alias("unknown"))


def l21_common_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most frequent parts of symbol names."""
    parts = b.latest(spark, folder, "symbols", "name").select(F.explode(segments(F.col("name"))).alias("part"))
    return parts.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "part").limit(100)


def n3_heat(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "hit_count", "last_hit_at", "created_at")
    days = lambda c: F.datediff(F.lit(AT), timestamp_of(F.col(c)))
    warm = decay_heat(F.coalesce("hit_count", F.lit(0)), F.coalesce(days("last_hit_at"), days("created_at")), days("created_at"), 30.0, 7.0)
    return facts.select("id", round_half_up(warm, 6).alias("heat"), round_half_up(recency(days("created_at")), 6).alias("recency"))


def n5_reviews(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "review_status", "source", "confidence")
    return facts.groupBy(F.coalesce("review_status", F.lit("none")).alias("status"), "source").agg(F.count("*").alias("n"), round_half_up(F.avg("confidence"), 4).alias("confidence"))


def h25_scripts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", round_half_up(memory.latin_share(F.col("text")), 6).alias("latin"))


def h27_stripped(spark: SparkSession, folder: str) -> DataFrame:
    """Commands and notes that change when their secrets are stripped."""
    calls = b.latest(spark, folder, "tool_calls", "input_snippet").where("input_snippet is not null")
    clean = detectors.strip_secrets(F.col("input_snippet"))
    return calls.where(clean != F.col("input_snippet")).select("id", clean.alias("text"))


def usage_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and tokens of usage patterns that an index would save."""
    calls = b.latest(spark, folder, "tool_calls", "tool_short_name", "input_snippet", "output_size_chars", "output_tokens_estimate", "semantic_degraded")
    snippet = F.coalesce("input_snippet", F.lit(""))
    rules = [("grep", snippet.startswith("grep ")), ("cat", snippet.rlike("^(cat|head) ")), ("large_read", (F.col("tool_short_name") == "Read") & (F.col("output_size_chars") > 5000)), ("degraded", F.col("semantic_degraded") == 1), ("agent", F.col("tool_short_name") == "Task")]
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda r: r.isNotNull())
    return calls.select(F.explode(fired).alias("rule"), "output_tokens_estimate").groupBy("rule").agg(F.count("*").alias("calls"), F.sum("output_tokens_estimate").alias("tokens"))


def usage_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages installed by commands: versions asked for, and sessions."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "input_snippet").where(F.col("input_snippet").startswith("npm i "))
    package, version = F.regexp_extract("input_snippet", r"^npm i (@?[^@\s]+)@", 1), F.regexp_extract("input_snippet", r"@([0-9][^@\s]*)$", 1)
    return calls.select("session_id", package.alias("package"), version.alias("version")).where("package <> ''").groupBy("package").agg(F.count("*").alias("n"), F.countDistinct("version").alias("versions"), F.countDistinct("session_id").alias("sessions"))


def session_journal(spark: SparkSession, folder: str) -> DataFrame:
    """Per session: calls, errors, distinct files, first and last tool."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "timestamp", "tool_name", "is_error", "target_file").where("session_id <> ''")
    at = timestamp_of(F.col("timestamp"))
    first, last = F.min(F.struct(at.alias("t"), "id", "tool_name")), F.max(F.struct(at.alias("t"), "id", "tool_name"))
    g = calls.groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if(F.col("is_error") == 1).alias("errors"), F.countDistinct("target_file").alias("files"), first.alias("a"), last.alias("z"))
    return g.select("session_id", "calls", "errors", "files", F.col("a.tool_name").alias("first_tool"), F.col("z.tool_name").alias("last_tool"))


def q3_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts by type: loads, versions, declared paths."""
    c = b.latest(spark, folder, "api_contracts", "contract_type", "version", "parsed_spec")
    return c.groupBy("contract_type").agg(F.count("*").alias("n"), F.countDistinct("version").alias("versions"), F.sum(F.get_json_object("parsed_spec", "$.paths").cast("long")).alias("paths"))


def d17_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    commits = b.commits(spark, folder)
    g = commits.groupBy("author").agg(F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    weeks = F.greatest(F.datediff("last", "first") / 7.0, F.lit(1.0))
    return g.select("author", "commits", round_half_up(F.col("fixes") / F.col("commits"), 4).alias("fix_ratio"), round_half_up(weeks, 2).alias("weeks"))


QUERIES = {f.__name__: f for f in (
    k9_references, k13_neighbourhood, k20_bottlenecks, k22_module_dependencies, k29_dead_exports, l11_freshness, l21_common_parts, n3_heat, n5_reviews, h25_scripts, h27_stripped,
    usage_rules, usage_packages, session_journal, q3_versions, d17_lifespans,
)}

_TS = "try_cast(replace(replace({0}, 'T', ' '), 'Z', '+00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"
_DAYS = "date_diff('day', CAST(" + _TS + " AS DATE), DATE '" + AT + "')"

def _stripped_sql(text: str) -> str:
    for shape, instead in detectors.SECRETS:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, shape.replace("'", "''"), instead.replace("$", "\\"))
    return text


ORACLES = {
    "h27_stripped": f"WITH c AS (SELECT id, input_snippet AS s, {_stripped_sql('input_snippet')} AS text FROM {b.latest_sql('tool_calls', 'input_snippet')} WHERE input_snippet IS NOT NULL) SELECT id, text FROM c WHERE text <> s",
    "k9_references": b.with_views("im", "fl") + " SELECT fl.* FROM fl JOIN im ON im.src = fl.file_id WHERE im.dst = (SELECT dst FROM im GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1)",
    "k13_neighbourhood": b.with_views("im") + """, d AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM im UNION ALL SELECT dst, 1, 0 FROM im) GROUP BY 1),
      m AS (SELECT a.src AS node, count(*) AS mutual FROM im a JOIN im z ON a.src = z.dst AND a.dst = z.src GROUP BY 1) SELECT d.*, coalesce(mutual, 0) AS mutual FROM d LEFT JOIN m ON m.node = d.node""",
    "k22_module_dependencies": b.with_views("im", "fl") + """, m AS (SELECT file_id, regexp_extract(path, '^[^/]+/[^/]+') AS module FROM fl) SELECT a.module AS from_module, z.module AS to_module, count(*) AS n_edges, count(DISTINCT src) AS n_from, count(DISTINCT dst) AS n_to
      FROM im JOIN m a ON a.file_id = src JOIN m z ON z.file_id = dst WHERE a.module <> z.module GROUP BY 1, 2""",
    "k29_dead_exports": f"""WITH s AS {b.latest_sql('symbols', 'name', 'metadata')}, w AS (SELECT DISTINCT unnest(regexp_extract_all(input_snippet, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM tool_calls WHERE input_snippet IS NOT NULL)
      SELECT id, name FROM s WHERE name IS NOT NULL AND json_extract_string(metadata, '$.exported') = 'true' AND name NOT IN (SELECT name FROM w)""",
    "l11_freshness": f"WITH f AS {b.latest_sql('files', 'workspace', 'indexed_at', 'mtime_ms')} SELECT workspace, count(*) AS n, count(*) FILTER (make_timestamp(CAST(mtime_ms AS BIGINT) * 1000) > {_TS.format('indexed_at')}) AS stale, count(*) FILTER (mtime_ms IS NULL) AS unknown FROM f GROUP BY 1",
    "l21_common_parts": f"WITH s AS {b.latest_sql('symbols', 'name')}, p AS (SELECT unnest(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\-.:/]+')) AS part FROM s) SELECT part, count(*) AS n FROM p WHERE part <> '' GROUP BY 1 ORDER BY n DESC, part LIMIT 100",
    "n3_heat": f"""WITH f AS {b.latest_sql('decisions', 'hit_count', 'last_hit_at', 'created_at')}, d AS (SELECT id, coalesce(hit_count, 0) AS hits, {_DAYS.format('created_at')} AS c, coalesce({_DAYS.format('last_hit_at')}, {_DAYS.format('created_at')}) AS l FROM f)
      SELECT id, floor(least(1000.0::DOUBLE, hits * exp(-l / 30.0::DOUBLE) + exp(-c / 7.0::DOUBLE)) * 1e6 + 0.5) / 1e6 AS heat, floor(greatest(0.0::DOUBLE, 1 - c / 30.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS recency FROM d""",
    "n5_reviews": f"WITH f AS {b.latest_sql('decisions', 'review_status', 'source', 'confidence')} SELECT coalesce(review_status, 'none') AS status, source, count(*) AS n, floor(avg(confidence) * 1e4 + 0.5) / 1e4 AS confidence FROM f GROUP BY 1, 2",
    "h25_scripts": "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 THEN floor(length(regexp_replace(text, '[^\\p{Latin}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) * 1e6 + 0.5) / 1e6 ELSE 1.0 END AS latin FROM documents WHERE text IS NOT NULL",
    "usage_rules": f"""WITH c AS {b.latest_sql('tool_calls', 'tool_short_name', 'input_snippet', 'output_size_chars', 'output_tokens_estimate', 'semantic_degraded')}, u AS (SELECT 'grep' AS rule, output_tokens_estimate AS t FROM c WHERE starts_with(input_snippet, 'grep ') UNION ALL SELECT 'cat', output_tokens_estimate FROM c WHERE regexp_matches(input_snippet, '^(cat|head) ')
      UNION ALL SELECT 'large_read', output_tokens_estimate FROM c WHERE tool_short_name = 'Read' AND output_size_chars > 5000 UNION ALL SELECT 'degraded', output_tokens_estimate FROM c WHERE semantic_degraded = 1 UNION ALL SELECT 'agent', output_tokens_estimate FROM c WHERE tool_short_name = 'Task')
      SELECT rule, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens FROM u GROUP BY 1""",
    "usage_packages": f"WITH c AS (SELECT session_id, regexp_extract(input_snippet, '^npm i (@?[^@\\s]+)@', 1) AS package, regexp_extract(input_snippet, '@([0-9][^@\\s]*)$', 1) AS version FROM {b.latest_sql('tool_calls', 'session_id', 'input_snippet')} WHERE starts_with(input_snippet, 'npm i ')) SELECT package, count(*) AS n, count(DISTINCT version) AS versions, count(DISTINCT session_id) AS sessions FROM c WHERE package <> '' GROUP BY 1",
    "session_journal": f"""WITH c AS (SELECT *, {_TS.format('"timestamp"')} AS t FROM {b.latest_sql('tool_calls', 'session_id', '"timestamp"', 'tool_name', 'is_error', 'target_file')} WHERE session_id <> '')
      SELECT session_id, count(*) AS calls, count(*) FILTER (is_error = 1) AS errors, count(DISTINCT target_file) AS files, first(tool_name ORDER BY t ASC NULLS FIRST, id) AS first_tool, first(tool_name ORDER BY t DESC NULLS LAST, id DESC) AS last_tool FROM c GROUP BY 1""",
    "q3_versions": f"SELECT contract_type, count(*) AS n, count(DISTINCT version) AS versions, CAST(sum(CAST(json_extract_string(parsed_spec, '$.paths') AS BIGINT)) AS BIGINT) AS paths FROM {b.latest_sql('api_contracts', 'contract_type', 'version', 'parsed_spec')} GROUP BY 1",
    "d17_lifespans": b.with_views("commits") + " SELECT author, count(*) AS commits, floor(count(*) FILTER (is_fix)::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS fix_ratio, floor(greatest(date_diff('day', min(ts), max(ts)) / 7.0::DOUBLE, 1.0::DOUBLE) * 100 + 0.5) / 100 AS weeks FROM commits GROUP BY 1",
}

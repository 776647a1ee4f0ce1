"""Telemetry, usage, memory, topology and detector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import round_half_up, timestamp_of, token_estimate, url_pattern
from codeweft.operators import detectors, history, memory, telemetry, topology
from codeweft.plans import bindings as b
from codeweft.plans.history_queries import _similar
from codeweft.sources.tables import table

DOMAINS = {"billing": ["ledger", "budget", "wallet", "vault"], "search": ["query", "index", "ranker", "corpus", "vector"], "storage": ["cache", "store", "archive", "table"]}

#: (rule, metric, warning above, error above)
GATES = [
    ("parse_failures", "bad_pct", 5.0, 20.0), ("large_files", "large", 0.0, 1e9), ("no_language", "no_language_pct", 5.0, 25.0), ("most_complex", "most_complex", 15.0, 50.0), ("complex_share", "complex_pct", 5.0, 30.0),
    ("deepest_nesting", "deepest", 4.0, 10.0), ("many_parameters", "params_pct", 5.0, 30.0), ("undocumented", "undocumented_pct", 50.0, 90.0),
]


def _calls(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return b.latest(spark, folder, "tool_calls", *columns)


def d6_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.hourly(b.spans(spark, folder), "service")


def d8_latency(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.latency(b.spans(spark, folder), "service", "duration", F.col("status") == 2)


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.profile(d6_hourly(spark, folder), "service")


def runtime_tree(spark: SparkSession, folder: str) -> DataFrame:
    spans = b.spans(spark, folder)
    tree = telemetry.call_tree(spans, spans.where("parent_id is null"), 3, most_children=10)
    return tree.groupBy("root", "depth").agg(F.count("*").alias("n_spans")).withColumn("depth", F.col("depth").cast("long"))


def runtime_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.dependencies(b.spans(spark, folder))


def attribution_nearest(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type")
    return telemetry.nearest_before(events.where("event_type = 'view'"), events.where("event_type in ('click', 'purchase')"), "user_id", 7200)


def attribution_once(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type")
    return telemetry.attribute(events.where("event_type = 'view'"), events.where("event_type in ('click', 'purchase')"), "user_id", 7200)


def usage_by_tool(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder, "tool_name", "is_error", "output_tokens_estimate")
    g = calls.groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(F.col("is_error") == 1).alias("errors"), F.sum("output_tokens_estimate").alias("tokens"))
    total = g.agg(F.sum("calls").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("tool_name", "calls", "errors", "tokens", round_half_up(F.col("calls") / F.col("total") * 100, 0).alias("pct"))


def usage_trend(spark: SparkSession, folder: str) -> DataFrame:
    sessions = b.latest(spark, folder, "sessions", "started_at", "input_tokens", "output_tokens", "tool_call_count")
    day = F.date_format(timestamp_of(F.col("started_at")), "yyyy-MM-dd").alias("day")
    return sessions.groupBy(day).agg(F.count("*").alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("tool_call_count").alias("calls"))


def usage_repeated_reads(spark: SparkSession, folder: str) -> DataFrame:
    reads = _calls(spark, folder, "session_id", "tool_short_name", "target_file").where("tool_short_name = 'Read' and target_file is not null")
    return telemetry.repeated(reads, ["session_id", "target_file"], 2)


def usage_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder, "session_id", "tool_server", "output_tokens_estimate").where("session_id is not null")
    return telemetry.cohorts(calls, "session_id", F.col("tool_server") != "builtin", "output_tokens_estimate").withColumn("flagged", F.col("flagged").cast("long"))


def usage_weights(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder, "tool_short_name", "is_error").groupBy("tool_short_name").agg(F.count("*").alias("shown"), F.count_if(F.col("is_error") == 0).alias("accepted"))
    return telemetry.tune_weights(calls, "tool_short_name", "shown", "accepted")


def session_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Searches asked again within a session."""
    calls = _calls(spark, folder, "session_id", "tool_short_name", "input_snippet").where("tool_short_name = 'search' and input_snippet is not null and session_id <> ''")
    query = F.get_json_object("input_snippet", "$.query")
    return telemetry.repeated(calls.select("session_id", query.alias("query")).where("query is not null"), ["session_id", "query"], 2)


def n1_valid_at(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "type", "valid_from", "valid_until")
    facts = facts.select("id", "type", timestamp_of(F.col("valid_from")).alias("valid_from"), timestamp_of(F.col("valid_until")).alias("valid_until"))
    return memory.valid_at(facts, F.lit("2025-07-01").cast("timestamp")).select("id", "type")


def n2_stats(spark: SparkSession, folder: str) -> DataFrame:
    return memory.fact_stats(b.latest(spark, folder, "decisions", "type", "source", "valid_until"), "type", "source")


def n2_timeline(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "type", "created_at")
    return memory.timeline(facts.withColumn("at", timestamp_of(F.col("created_at"))), "at", "type")


def n4_supersede(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("state"), F.col("o_orderdate").alias("valid_from"))
    return memory.supersede(orders, ["subject", "state"], "valid_from", "id")


def n6_similar(spark: SparkSession, folder: str) -> DataFrame:
    return memory.similar_titles(b.latest(spark, folder, "decisions", "title").where("title is not null"), "id", "title", "Rebuild the segment oracle", least=0.2)


def n11_mined(spark: SparkSession, folder: str) -> DataFrame:
    return memory.mine(table(spark, folder, "documents").where("text is not null"), "doc_id", "text")


def n12_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.length("text") >= 50).select("doc_id", F.posexplode(memory.chunks(F.col("text"), 400)).alias("chunk_index", "chunk"))
    return docs.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("length"))


def q1_services(spark: SparkSession, folder: str) -> DataFrame:
    return topology.service_map(table(spark, folder, "api_contracts"), b.latest(spark, folder, "api_endpoints", "service_id", "method"), "service_id")


def q3_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Services with a contract but no endpoint, and the reverse."""
    return topology.contract_drift(table(spark, folder, "api_contracts").select("service_id"), table(spark, folder, "api_endpoints").select("service_id"), ["service_id"])


def q4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Calls through a gateway, with values in place of parameters, linked to the endpoints they meet."""
    endpoints = b.latest(spark, folder, "api_endpoints", "method", "path").where("path is not null")
    url = F.concat(F.lit("https://gateway.example/edge"), F.regexp_replace("path", r"\{[^}/]*\}|:[A-Za-z_][A-Za-z0-9_]*", "42"), F.lit("?page=2"))
    calls = endpoints.select(F.col("id").alias("call_id"), url.alias("url"), F.lower("method").alias("method"))
    return topology.link_calls(calls, endpoints)


def q4_patterns(spark: SparkSession, folder: str) -> DataFrame:
    endpoints = b.latest(spark, folder, "api_endpoints", "path").where("path is not null")
    return endpoints.groupBy(url_pattern(F.col("path")).alias("pattern")).agg(F.count("*").alias("n"))


def q6_tunnels(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "project_root", "service_name")
    return topology.shared_topics(facts, "project_root", "service_name", F.lit(1.0))


def q8_domains(spark: SparkSession, folder: str) -> DataFrame:
    return topology.classify(b.latest(spark, folder, "decisions", "title").where("title is not null"), "id", F.col("title"), DOMAINS)


def r1_scan(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder, "input_snippet").where("input_snippet is not null")
    return detectors.scan_lines(calls, "id", F.col("input_snippet"))


def m13_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Eight gates over files and symbols, and the worst verdict of all."""
    files = b.latest(spark, folder, "files", "status", "byte_length", "language")
    pct = lambda met: F.count_if(met) / F.count("*") * 100
    of_files = files.agg(pct(F.col("status") != "ok").alias("bad_pct"), F.count_if(F.col("byte_length") > 1_000_000).alias("large"), pct(F.col("language").isNull()).alias("no_language_pct"))
    symbols = b.latest(spark, folder, "symbols", "cyclomatic", "max_nesting", "param_count", "summary")
    of_symbols = symbols.agg(F.max("cyclomatic").alias("most_complex"), pct(F.col("cyclomatic") > 10).alias("complex_pct"), F.max("max_nesting").alias("deepest"), pct(F.col("param_count") > 5).alias("params_pct"), pct(F.col("summary").isNull()).alias("undocumented_pct"))
    gated = detectors.gates(of_files.crossJoin(of_symbols), GATES).withColumn("value", round_half_up(F.col("value"), 4))
    worst = F.when(F.max(F.col("verdict") == "error"), "error").when(F.max(F.col("verdict") == "warning"), "warning").otherwise("pass")
    return gated.unionByName(gated.agg(F.lit("overall").alias("rule"), F.count_if(F.col("verdict") != "pass").cast("double").alias("value"), worst.alias("verdict")))


def h10_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("docs"))


def d16_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(round_half_up(F.avg("l_quantity"), 4).alias("mean"), round_half_up(F.stddev_samp("l_quantity"), 4).alias("spread"), telemetry.nearest_rank("l_quantity", 0.95).alias("p95"))


def d12_share(spark: SparkSession, folder: str) -> DataFrame:
    return history.share_of_total(table(spark, folder, "events"), ["user_id"], ["event_type"])


QUERIES = {f.__name__: f for f in (
    d6_hourly, d8_latency, runtime_tree, runtime_dependencies, attribution_nearest, attribution_once, usage_by_tool, usage_trend, usage_repeated_reads, usage_cohorts, usage_weights,
    session_duplicates, n1_valid_at, n2_stats, n2_timeline, n4_supersede, n6_similar, n11_mined, n12_chunks, q1_services, q3_drift, q4_links, q4_patterns, q6_tunnels, q8_domains,
    r1_scan, m13_gates, h10_tokens, d16_dispersion, d12_share,
)} | {"runtime_profile": p1_profile}

_HOUR = """, h AS (SELECT service, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS hour, count(*) AS calls, count(*) FILTER (status = 2) AS errors, floor(sum(duration) * 100 + 0.5) / 100 AS total, min(duration) AS least, max(duration) AS most,
  quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95, quantile_disc(duration, 0.99) AS p99 FROM sp GROUP BY 1, 2)"""
_TS = "try_cast(replace(replace({0}, 'T', ' '), 'Z', '+00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"
_PATTERN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\{{[^}}/]*\}}', '{{*}}', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{{*}}', 'g'), '/[0-9]+/', '/{{*}}/', 'g'), '/[0-9]+$', '/{{*}}'), '(.)/+$', '\1')"


def _calls_sql(*columns: str) -> str:
    return f"c AS {b.latest_sql('tool_calls', *columns)}"


def _domain_sql() -> str:
    parts = [f"SELECT id, '{d}' AS domain, len(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: t IN ({', '.join(repr(w) for w in ws)}))) AS hits FROM s" for d, ws in DOMAINS.items()]
    return f"WITH s AS (SELECT * FROM {b.latest_sql('decisions', 'title')} WHERE title IS NOT NULL), u AS ({' UNION ALL '.join(parts)}) SELECT id, domain, hits FROM u WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, domain) = 1"


ORACLES = {
    "n6_similar": f"WITH t AS (SELECT id, title, {_similar('title', repr('Rebuild the segment oracle'))} AS similarity FROM {b.latest_sql('decisions', 'title')} WHERE title IS NOT NULL) SELECT * FROM t WHERE similarity >= 0.2",
    "n11_mined": "WITH " + ", ".join(f"c{i} AS (SELECT doc_id, '{n}' AS cue, {c}::DOUBLE AS confidence, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents WHERE text IS NOT NULL)" for i, (n, p, c) in enumerate(memory.CUES)) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(memory.CUES))) + ") WHERE n > 0",
    "q4_links": f"""WITH e AS (SELECT id, upper(method) AS m, {_PATTERN.format('path')} AS p, path FROM {b.latest_sql('api_endpoints', 'method', 'path')} WHERE path IS NOT NULL),
      c AS (SELECT id AS call_id, m AS cm, {_PATTERN.format("'/edge' || regexp_replace(path, '\\{[^}/]*\\}|:[A-Za-z_][A-Za-z0-9_]*', '42', 'g')")} AS cp FROM e),
      l AS (SELECT call_id, e.id, CASE WHEN p = cp THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END + CASE WHEN m IS NOT DISTINCT FROM cm THEN 0.2::DOUBLE ELSE 0 END AS s FROM c JOIN e ON starts_with(p, '/') AND (p = cp OR ends_with(cp, p)))
      SELECT call_id, id AS endpoint_id, least(s, 1.0::DOUBLE) AS confidence FROM l QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY s DESC, id) = 1""",
    "r1_scan": "WITH t AS (SELECT id, unnest(string_split(input_snippet, chr(10))) AS line, unnest(range(1, len(string_split(input_snippet, chr(10))) + 1)) AS no FROM " + b.latest_sql("tool_calls", "input_snippet") + " WHERE input_snippet IS NOT NULL) " + " UNION ALL ".join("SELECT id, CAST(no AS BIGINT) AS line_no, '{}' AS rule, '{}' AS class FROM t WHERE regexp_matches(line, '{}')".format(n, c, p.replace("'", "''")) for n, c, p in detectors.RULES),
    "d6_hourly": b.with_views("sp") + _HOUR + " SELECT * FROM h",
    "runtime_profile": b.with_views("sp") + _HOUR + """ SELECT service, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, floor(sum(p50 * calls) / sum(calls) * 1000 + 0.5) / 1000 AS p50_wavg,
      floor(sum(p95 * calls) / sum(calls) * 1000 + 0.5) / 1000 AS p95_wavg, floor(sum(p99 * calls) / sum(calls) * 1000 + 0.5) / 1000 AS p99_wavg FROM h GROUP BY 1""",
    "d8_latency": b.with_views("sp") + """ SELECT service, count(*) AS calls, count(*) FILTER (status = 2) AS errors, floor(count(*) FILTER (status = 2)::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS error_rate,
      floor(quantile_cont(duration, 0.5) * 1e4 + 0.5) / 1e4 AS p50, floor(quantile_cont(duration, 0.95) * 1e4 + 0.5) / 1e4 AS p95, max(duration) AS most FROM sp GROUP BY 1""",
    "runtime_tree": b.with_views("sp", recursive=True) + """, t(span_id, root, depth) AS (SELECT span_id, span_id, 0 FROM sp WHERE parent_id IS NULL UNION ALL SELECT sp.span_id, t.root, t.depth + 1 FROM t JOIN sp ON sp.parent_id = t.span_id WHERE t.depth < 3)
      SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n_spans FROM t GROUP BY 1, 2""",
    "runtime_dependencies": b.with_views("sp") + " SELECT p.service AS caller, c.service AS callee, count(*) AS calls, floor(avg(c.duration) * 1e4 + 0.5) / 1e4 AS mean FROM sp c JOIN sp p ON p.span_id = c.parent_id AND p.trace_id = c.trace_id GROUP BY 1, 2",
    "attribution_nearest": """WITH a AS (SELECT event_id, ts, user_id FROM events WHERE event_type IN ('click', 'purchase')), v AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'view')
      SELECT a.event_id AS accepted_id, v.event_id AS shown_id FROM a JOIN v ON v.user_id = a.user_id AND v.ts <= a.ts AND v.ts >= a.ts - INTERVAL 7200 SECOND QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY v.ts DESC, v.event_id DESC) = 1""",
    "usage_by_tool": f"WITH {_calls_sql('tool_name', 'is_error', 'output_tokens_estimate')} SELECT tool_name, count(*) AS calls, count(*) FILTER (is_error = 1) AS errors, CAST(sum(output_tokens_estimate) AS BIGINT) AS tokens, floor(count(*)::DOUBLE / (SELECT count(*) FROM c) * 100 + 0.5) AS pct FROM c GROUP BY 1",
    "usage_trend": f"WITH s AS {b.latest_sql('sessions', 'started_at', 'input_tokens', 'output_tokens', 'tool_call_count')} SELECT strftime({_TS.format('started_at')}, '%Y-%m-%d') AS day, count(*) AS sessions, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(tool_call_count) AS BIGINT) AS calls FROM s GROUP BY 1",
    "usage_repeated_reads": f"WITH {_calls_sql('session_id', 'tool_short_name', 'target_file')} SELECT session_id, target_file, count(*) AS n FROM c WHERE tool_short_name = 'Read' AND target_file IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "usage_cohorts": f"""WITH {_calls_sql('session_id', 'tool_server', 'output_tokens_estimate')}, p AS (SELECT session_id, max(CASE WHEN tool_server <> 'builtin' THEN 1 WHEN tool_server IS NOT NULL THEN 0 END) AS flagged, sum(output_tokens_estimate) AS tokens, count(*) AS calls FROM c WHERE session_id IS NOT NULL GROUP BY 1)
      SELECT CAST(flagged AS BIGINT) AS flagged, count(*) AS sessions, floor(avg(tokens) * 100 + 0.5) / 100 AS mean_tokens, floor(avg(calls) * 100 + 0.5) / 100 AS mean_calls FROM p GROUP BY 1""",
    "usage_weights": f"""WITH {_calls_sql('tool_short_name', 'is_error')}, r AS (SELECT tool_short_name, (count(*) FILTER (is_error = 0) + 0.5::DOUBLE) / (count(*) + 1) AS rate FROM c GROUP BY 1), w AS (SELECT tool_short_name, greatest(rate / sum(rate) OVER (), 0.05::DOUBLE) AS w FROM r)
      SELECT tool_short_name, floor(w / sum(w) OVER () * 1e6 + 0.5) / 1e6 AS weight FROM w""",
    "session_duplicates": f"WITH {_calls_sql('session_id', 'tool_short_name', 'input_snippet')} SELECT session_id, json_extract_string(input_snippet, '$.query') AS query, count(*) AS n FROM c WHERE tool_short_name = 'search' AND session_id <> '' AND json_extract_string(input_snippet, '$.query') IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "n1_valid_at": f"WITH s AS {b.latest_sql('decisions', 'type', 'valid_from', 'valid_until')}, t AS (SELECT id, type, {_TS.format('valid_from')} AS f, valid_until AS u0, {_TS.format('valid_until')} AS u FROM s) SELECT id, type FROM t WHERE f <= TIMESTAMP '2025-07-01' AND (u IS NULL OR u > TIMESTAMP '2025-07-01')",
    "n2_stats": f"WITH s AS {b.latest_sql('decisions', 'type', 'source', 'valid_until')} SELECT type, source, count(*) AS n, count(*) FILTER (valid_until IS NULL) AS open, count(*) FILTER (valid_until IS NOT NULL) AS closed FROM s GROUP BY 1, 2",
    "n2_timeline": f"WITH s AS {b.latest_sql('decisions', 'type', 'created_at')}, m AS (SELECT type, strftime({_TS.format('created_at')}, '%Y-%m') AS month, count(*) AS n FROM s GROUP BY 1, 2) SELECT type, month, n, CAST(sum(n) OVER (PARTITION BY type ORDER BY month) AS BIGINT) AS total FROM m",
    "n4_supersede": "SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS state, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders",
    "q1_services": f"WITH e AS {b.latest_sql('api_endpoints', 'service_id', 'method')}, n AS (SELECT service_id, count(*) AS n_endpoints, count(DISTINCT upper(method)) AS n_methods FROM e GROUP BY 1) SELECT c.service_id, coalesce(n_endpoints, 0) AS n_endpoints, coalesce(n_methods, 0) AS n_methods FROM (SELECT DISTINCT service_id FROM api_contracts) c LEFT JOIN n ON n.service_id = c.service_id",
    "q3_drift": "SELECT service_id, 'declared_only' AS side FROM (SELECT service_id FROM api_contracts EXCEPT SELECT service_id FROM api_endpoints) UNION ALL SELECT service_id, 'implemented_only' FROM (SELECT service_id FROM api_endpoints EXCEPT SELECT service_id FROM api_contracts)",
    "q4_patterns": f"WITH e AS {b.latest_sql('api_endpoints', 'path')} SELECT {_PATTERN.format('path')} AS pattern, count(*) AS n FROM e WHERE path IS NOT NULL GROUP BY 1",
    "q6_tunnels": f"WITH s AS {b.latest_sql('decisions', 'project_root', 'service_name')}, r AS (SELECT DISTINCT project_root, service_name FROM s WHERE project_root IS NOT NULL AND service_name IS NOT NULL) SELECT a.project_root AS group_a, z.project_root AS group_b, count(*) AS n_shared, count(*)::DOUBLE AS weight FROM r a JOIN r z ON a.service_name = z.service_name AND a.project_root < z.project_root GROUP BY 1, 2",
    "q8_domains": _domain_sql(),
    "m13_gates": f"""WITH f AS (SELECT count(*) FILTER (status <> 'ok')::DOUBLE / count(*) * 100 AS bad_pct, count(*) FILTER (byte_length > 1000000)::DOUBLE AS large, count(*) FILTER (language IS NULL)::DOUBLE / count(*) * 100 AS no_language_pct FROM {b.latest_sql('files', 'status', 'byte_length', 'language')}),
      s AS (SELECT max(cyclomatic)::DOUBLE AS most_complex, count(*) FILTER (cyclomatic > 10)::DOUBLE / count(*) * 100 AS complex_pct, max(max_nesting)::DOUBLE AS deepest, count(*) FILTER (param_count > 5)::DOUBLE / count(*) * 100 AS params_pct, count(*) FILTER (summary IS NULL)::DOUBLE / count(*) * 100 AS undocumented_pct FROM {b.latest_sql('symbols', 'cyclomatic', 'max_nesting', 'param_count', 'summary')}),
      g AS ({" UNION ALL ".join(f"SELECT '{n}' AS rule, floor({c} * 1e4 + 0.5) / 1e4 AS value, CASE WHEN {c} > {e} THEN 'error' WHEN {c} > {w} THEN 'warning' ELSE 'pass' END AS verdict FROM f, s" for n, c, w, e in GATES)})
      SELECT * FROM g UNION ALL SELECT 'overall', count(*) FILTER (verdict <> 'pass')::DOUBLE, CASE WHEN bool_or(verdict = 'error') THEN 'error' WHEN bool_or(verdict = 'warning') THEN 'warning' ELSE 'pass' END FROM g""",
    "h10_tokens": "SELECT source, CAST(sum(CAST(ceil(length(text)::DOUBLE / 4 * 1.15::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "d16_dispersion": "SELECT l_returnflag, floor(avg(l_quantity) * 1e4 + 0.5) / 1e4 AS mean, floor(stddev_samp(l_quantity) * 1e4 + 0.5) / 1e4 AS spread, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "d12_share": "SELECT user_id, event_type, count(*) AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) * 1000 + 0.5) / 1000 AS share FROM events GROUP BY 1, 2",
}

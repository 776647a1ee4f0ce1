"""Queries of recorded facts and their SQL: confidence, quality, heat, pins, clusters, enrichment, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import param_count, round_half_up, timestamp_of
from codeweft.operators import curation, memory
from codeweft.plans import bindings as b
from codeweft.plans.history_queries import _grams
from codeweft.sources.tables import table

AT = "2026-01-01 00:00:00"


def m16_confidence(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "content", "type", "service_name", "symbol_id", "file_path", "tags")
    return facts.select("id", curation.confidence().alias("confidence"))


def h24_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that a quality rule rejects, by reason."""
    facts = b.latest(spark, folder, "decisions", "title", "content")
    return facts.groupBy(F.coalesce(curation.reject_reason(F.col("title"), F.col("content")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def h15_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "created_at", "last_hit_at")
    factor = curation.heat_multiplier(timestamp_of(F.col("created_at")), timestamp_of(F.col("last_hit_at")), F.lit(AT).cast("timestamp"))
    return facts.select("id", factor.alias("factor"))


def h29_keywords(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "title").where("title is not null")
    return facts.select("id", F.array_join(curation.keywords(F.col("title")), " ").alias("words"))


def h23_params(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols whose counted parameters differ from the recorded ones, and how many agree."""
    rows = b.latest(spark, folder, "symbols", "signature", "param_count").where("signature is not null")
    counted = rows.select(param_count(F.col("signature")).cast("long").alias("params"), F.col("param_count"))
    return counted.groupBy("params").agg(F.count("*").alias("n"), F.count_if(F.col("params") == F.col("param_count")).alias("agree"))


def m17_pins(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions as pins of their symbol, twice their confidence in weight, until they end."""
    facts = b.latest(spark, folder, "decisions", "symbol_id", "confidence", "valid_until").where("symbol_id <> ''")
    symbols = b.latest(spark, folder, "symbols", "symbol_id", "file_id").select("symbol_id", "file_id")
    files = b.latest(spark, folder, "files", "path").select(F.col("id").alias("file_id"), "path")
    pins = facts.join(symbols, "symbol_id").join(files, "file_id").select("path", (F.col("confidence") * 2).alias("weight"), timestamp_of(F.col("valid_until")).alias("expires_at"))
    return curation.pin_weights(pins, F.lit(AT).cast("timestamp"))


def n8_clusters(spark: SparkSession, folder: str) -> DataFrame:
    facts = b.latest(spark, folder, "decisions", "title").where("title is not null")
    return curation.title_clusters(facts, "id", "title", least=0.8)


def n10_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Files that calls touch, with the decisions on them: how many, how sure, the newest."""
    touched = b.latest(spark, folder, "tool_calls", "target_file").where("target_file is not null").groupBy(F.col("target_file").alias("file_path")).agg(F.count("*").alias("calls"))
    facts = b.latest(spark, folder, "decisions", "file_path", "confidence", "created_at").where("file_path <> ''")
    notes = facts.groupBy("file_path").agg(F.count("*").alias("decisions"), round_half_up(F.max("confidence"), 4).alias("best"), F.max(F.struct(timestamp_of(F.col("created_at")).alias("at"), "id"))["id"].alias("newest"))
    return touched.join(notes, "file_path")


def n4_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with the changes of their life applied in order: the last one decides."""
    facts = b.latest(spark, folder, "decisions", "created_at", "valid_until", "review_status").select("id", "created_at", "valid_until", "review_status")
    made = facts.select("id", timestamp_of(F.col("created_at")).alias("at"), F.lit("add").alias("change"))
    closed = facts.where("valid_until is not null").select("id", timestamp_of(F.col("valid_until")).alias("at"), F.lit("invalidate").alias("change"))
    reviewed = facts.where("review_status is not null").select("id", (timestamp_of(F.col("created_at")) + F.expr("INTERVAL 1 DAY")).alias("at"), F.concat(F.lit("review:"), "review_status").alias("change"))
    return memory.replay(made.unionByName(closed).unionByName(reviewed), "id", "at", "change").groupBy("state").agg(F.count("*").alias("n"), F.sum("changes").alias("changes"))


def n5_reviewed_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Share of approved ones among the reviewed facts of a source."""
    facts = b.latest(spark, folder, "decisions", "source", "review_status").where("review_status is not null")
    g = facts.groupBy("source").agg(F.count("*").alias("reviewed"), F.count_if(F.col("review_status") == "approved").alias("approved"))
    return g.select("*", round_half_up(F.col("approved") / F.col("reviewed"), 4).alias("ratio"))


def m14_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Large files as first and as last loaded, by path: new, fixed or the same."""
    rows = table(spark, folder, "files").where("path is not null and loaded_at is not null")
    first = rows.groupBy("path").agg(F.min(F.struct("loaded_at", "status"))["status"].alias("status"))
    last = rows.groupBy("path").agg(F.max(F.struct("loaded_at", "status"))["status"].alias("status"))
    bad = lambda df: df.where("status <> 'ok'").select("path", "status")
    return curation.compare_findings(bad(first), bad(last), ["path", "status"]).groupBy("status", "state").agg(F.count("*").alias("n"))


def b6_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose list of tags, kept as JSON text, holds a value."""
    facts = b.latest(spark, folder, "decisions", "tags").where(F.col("tags").startswith("["))
    return facts.where(F.col("tags").contains('"perf"')).select("id")


def b7_decorated(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that name a decorator: alone, qualified, or called."""
    facts = b.latest(spark, folder, "decisions", "content").where("content is not null")
    found = F.regexp_extract_all("content", F.lit(r"@([A-Za-z_.]+\(?)"), F.lit(1))
    named = lambda d: (d == "Inject") | d.endswith(".Inject") | d.startswith("Inject(")
    return facts.where(F.exists(found, named)).select("id")


def b15_code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a search looks at by default: no prose."""
    files = b.latest(spark, folder, "files", "path", "language", "workspace")
    prose = F.coalesce(F.lower("language") == "markdown", F.lit(False)) | F.coalesce(F.lower("path").rlike(r"\.mdx?$"), F.lit(False))
    return files.where(~prose).groupBy("workspace").agg(F.count("*").alias("n"))


def b16_minimal(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols at the least level of detail."""
    return memory.at_detail(b.latest(spark, folder, "symbols", "name", "kind", "fqn", "signature", "summary"), "minimal", {"minimal": ["id", "name", "kind"], "default": ["id", "name", "kind", "fqn", "signature"]})


def c12_symbol_at(spark: SparkSession, folder: str) -> DataFrame:
    """The symbol at lines 50, 150 and 250 of each file: the innermost, ties by id."""
    symbols = b.latest(spark, folder, "symbols", "file_id", "name", "line_start", "line_end").where("file_id is not null and line_start is not null and line_end is not null")
    points = symbols.select("file_id").distinct().withColumn("line", F.explode(F.array(F.lit(50), F.lit(150), F.lit(250))))
    return memory.interval_at(points, symbols, "file_id", "line", "line_start", "line_end", "id").select("file_id", F.col("line").cast("long").alias("line"), "id")


QUERIES = {f.__name__: f for f in (
    m16_confidence, h24_rejects, h15_multiplier, h29_keywords, h23_params, m17_pins, n8_clusters, n10_enriched, n4_closed, n5_reviewed_by_source, m14_baseline, b6_tagged, b7_decorated,
    b15_code_files, b16_minimal, c12_symbol_at,
)}

_TS = "try_cast(replace(replace({0}, 'T', ' '), 'Z', '+00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"


def _count(x: str, sign: str) -> str:
    return f"(length({x}) - length(replace({x}, '{sign}', '')))"


def _unbalanced(x: str) -> str:
    return f"({_count(x, '`')} % 2 = 1 OR ({_count(x, '**')} // 2) % 2 = 1 OR {_count(x, '(')} <> {_count(x, ')')} OR {_count(x, '[')} <> {_count(x, ']')} OR {_count(x, '{')} <> {_count(x, '}')})"


_FOREIGN = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) > length(regexp_replace({0}, '[^\\p{{Latin}}]', '', 'g'))"
_REASON = f"""CASE WHEN length(t) < 8 THEN 'title_too_short' WHEN contains(t, '�') OR contains(c, '�') THEN 'broken_encoding' WHEN {_FOREIGN.format('t')} OR {_FOREIGN.format('c')} THEN 'non_english'
  WHEN regexp_extract(t, '^[a-z]+') IN ({', '.join(repr(w) for w in curation.OPENERS)}) THEN 'title_mid_clause' WHEN {_unbalanced('t')} THEN 'title_truncated'
  WHEN length(c) < 16 OR len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]+')) < 4 THEN 'content_too_short' WHEN contains(c, '...') OR contains(c, '…') OR {_unbalanced('c')} THEN 'content_truncated' ELSE 'kept' END"""

ORACLES = {
    "m16_confidence": f"""SELECT id, floor(least(0.4::DOUBLE + CASE WHEN symbol_id <> '' OR file_path <> '' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(coalesce(content, '')) >= 200 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN tags <> '' THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN type IN ('architecture_decision', 'bug_root_cause') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN service_name <> '' THEN 0.05::DOUBLE ELSE 0 END, 1.0::DOUBLE) * 1e4 + 0.5) / 1e4 AS confidence FROM {b.latest_sql('decisions', 'content', 'type', 'service_name', 'symbol_id', 'file_path', 'tags')}""",
    "h24_rejects": f"WITH s AS (SELECT trim(coalesce(title, '')) AS t, trim(coalesce(content, '')) AS c FROM {b.latest_sql('decisions', 'title', 'content')}) SELECT {_REASON} AS reason, count(*) AS n FROM s GROUP BY 1",
    "h15_multiplier": f"""WITH s AS (SELECT id, {_TS.format('created_at')} AS c, {_TS.format('last_hit_at')} AS h FROM {b.latest_sql('decisions', 'created_at', 'last_hit_at')}), a AS (SELECT id, (epoch_us(TIMESTAMP '{AT}') - epoch_us(greatest(c, h))) / 86400000000.0 AS age FROM s)
      SELECT id, CASE WHEN age IS NULL THEN 1.0 WHEN age <= 7 THEN 1.5 WHEN age > 90 THEN 0.3 ELSE 1.0 END::DOUBLE AS factor FROM a""",
    "h29_keywords": f"""WITH s AS (SELECT id, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$')) AS l FROM {b.latest_sql('decisions', 'title')} WHERE title IS NOT NULL)
      SELECT id, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i)[1:8], ' ') AS words FROM s""",
    "h23_params": f"""WITH s AS (SELECT regexp_extract(signature, '\\((.*)\\)', 1) AS i, param_count FROM {b.latest_sql('symbols', 'signature', 'param_count')} WHERE signature IS NOT NULL), n AS (SELECT len(list_filter(string_split(i, ','), lambda x: trim(x) <> ''))::BIGINT AS params, param_count FROM s)
      SELECT params, count(*) AS n, count(*) FILTER (params = param_count) AS agree FROM n GROUP BY 1""",
    "m17_pins": f"""SELECT f.path, max(d.confidence * 2) AS weight FROM {b.latest_sql('decisions', 'symbol_id', 'confidence', 'valid_until')} d JOIN {b.latest_sql('symbols', 'symbol_id', 'file_id')} s ON s.symbol_id = d.symbol_id JOIN {b.latest_sql('files', 'path')} f ON f.id = s.file_id
      WHERE d.symbol_id <> '' AND ({_TS.format('d.valid_until')} IS NULL OR {_TS.format('d.valid_until')} > TIMESTAMP '{AT}') AND d.confidence * 2 BETWEEN 0.1 AND 3.0 GROUP BY 1""",
    "n8_clusters": f"""WITH RECURSIVE f AS (SELECT id, lower(title) AS t FROM {b.latest_sql('decisions', 'title')} WHERE title IS NOT NULL), g AS (SELECT t, min(id) AS f, {_grams('t')} AS l FROM f GROUP BY t), x AS (SELECT f, len(l) AS c, unnest(l) AS w FROM g),
      p AS (SELECT a.f AS a, z.f AS z FROM x a JOIN x z ON a.w = z.w AND a.f < z.f GROUP BY 1, 2, a.c, z.c HAVING count(*)::DOUBLE / (a.c + z.c - count(*)) >= 0.8 - 1e-9), u AS (SELECT a, z FROM p UNION SELECT z, a FROM p),
      h(node, root) AS (SELECT f, f FROM g UNION SELECT u.z, h.root FROM h JOIN u ON u.a = h.node WHERE h.root < u.z) SELECT f.id, min(h.root) AS cluster FROM f JOIN g ON g.t = f.t JOIN h ON h.node = g.f GROUP BY 1""",
    "n10_enriched": f"""WITH t AS (SELECT target_file AS file_path, count(*) AS calls FROM {b.latest_sql('tool_calls', 'target_file')} WHERE target_file IS NOT NULL GROUP BY 1),
      d AS (SELECT file_path, count(*) AS decisions, floor(max(confidence) * 1e4 + 0.5) / 1e4 AS best, first(id ORDER BY {_TS.format('created_at')} DESC NULLS LAST, id DESC) AS newest FROM {b.latest_sql('decisions', 'file_path', 'confidence', 'created_at')} WHERE file_path <> '' GROUP BY 1) SELECT t.*, d.* EXCLUDE (file_path) FROM t JOIN d USING (file_path)""",
    "n4_closed": f"""WITH f AS {b.latest_sql('decisions', 'created_at', 'valid_until', 'review_status')}, c AS (SELECT id, {_TS.format('created_at')} AS moment, 'add' AS change FROM f UNION ALL SELECT id, {_TS.format('valid_until')}, 'invalidate' FROM f WHERE valid_until IS NOT NULL
      UNION ALL SELECT id, {_TS.format('created_at')} + INTERVAL 1 DAY, 'review:' || review_status FROM f WHERE review_status IS NOT NULL), s AS (SELECT id, first(change ORDER BY moment DESC NULLS LAST, change DESC) AS state, count(*) AS n FROM c GROUP BY 1) SELECT state, count(*) AS n, CAST(sum(n) AS BIGINT) AS changes FROM s GROUP BY 1""",
    "n5_reviewed_by_source": f"SELECT source, count(*) AS reviewed, count(*) FILTER (review_status = 'approved') AS approved, floor(count(*) FILTER (review_status = 'approved')::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS ratio FROM {b.latest_sql('decisions', 'source', 'review_status')} WHERE review_status IS NOT NULL GROUP BY 1",
    "m14_baseline": """WITH r AS (SELECT path, first(status ORDER BY loaded_at, status NULLS FIRST) AS a, first(status ORDER BY loaded_at DESC, status DESC NULLS LAST) AS z FROM files WHERE path IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1), a AS (SELECT path, a AS status FROM r WHERE a <> 'ok'), z AS (SELECT path, z AS status FROM r WHERE z <> 'ok')
      SELECT coalesce(a.status, z.status) AS status, CASE WHEN a.path IS NULL THEN 'new' WHEN z.path IS NULL THEN 'fixed' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN z ON a.path = z.path AND a.status = z.status GROUP BY 1, 2""",
    "b6_tagged": f"SELECT id FROM {b.latest_sql('decisions', 'tags')} WHERE starts_with(tags, '[') AND contains(tags, '\"perf\"')",
    "b7_decorated": f"SELECT id FROM {b.latest_sql('decisions', 'content')} WHERE content IS NOT NULL AND len(list_filter(regexp_extract_all(content, '@([A-Za-z_.]+\\(?)', 1), lambda d: d = 'Inject' OR ends_with(d, '.Inject') OR starts_with(d, 'Inject('))) > 0",
    "b15_code_files": f"SELECT workspace, count(*) AS n FROM {b.latest_sql('files', 'path', 'language', 'workspace')} WHERE NOT (coalesce(lower(language) = 'markdown', false) OR coalesce(regexp_matches(lower(path), '\\.mdx?$'), false)) GROUP BY 1",
    "b16_minimal": f"SELECT id, name, kind FROM {b.latest_sql('symbols', 'name', 'kind', 'fqn', 'signature', 'summary')}",
    "c12_symbol_at": f"""WITH s AS {b.latest_sql('symbols', 'file_id', 'name', 'line_start', 'line_end')}, p AS (SELECT DISTINCT file_id, l.line FROM s, (VALUES (50), (150), (250)) l(line) WHERE file_id IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL)
      SELECT p.file_id, CAST(p.line AS BIGINT) AS line, s.id FROM p JOIN s ON s.file_id = p.file_id AND p.line BETWEEN s.line_start AND s.line_end QUALIFY row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY s.line_end - s.line_start, s.id) = 1""",
}

"""Further queries of the inventory: mappings, timelines, differences, owners, levels, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import branch_complexity, glob_to_regex, iso_of_nanos, micros_between, module_of, round_half_up, segments, timestamp_of, url_pattern
from codeweft.operators import code, curation, detectors, flows, graph, history, memory, search, topology
from codeweft.plans import bindings as b
from codeweft.plans.activity_queries import _PATTERN
from codeweft.plans.curation_queries import _REASON
from codeweft.plans.history_queries import _bm25
from codeweft.runtime import first_version, scratch
from codeweft.sources import sinks
from codeweft.sources.tables import table
from codeweft.streaming import spans as streams

AT = "2026-01-01 00:00:00"


def l20_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose texts speak of a stem of each asked word, best first."""
    docs = table(spark, folder, "documents").where("session_id is not null and text is not null").select("doc_id", "text")
    return search.stemmed_bm25(docs, "doc_id", {"text": 1.0}, "caching AND sessions")


def q6_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by the services and branches their decisions share; the main branch says little."""
    facts = b.latest(spark, folder, "decisions", "project_root", "service_name", "git_branch")
    kinds = F.explode(F.array(F.struct(F.lit("service").alias("kind"), F.col("service_name").alias("entity")), F.struct(F.lit("branch").alias("kind"), F.col("git_branch").alias("entity"))))
    items = facts.select("project_root", kinds.alias("k")).select("project_root", "k.*").where("entity is not null")
    return topology.weighted_topics(items, "project_root", "kind", "entity", {"service": 3.0, "branch": 1.0}, {"branch": ["main"]})


def n1_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred first of the facts that hold: manual ones first, then by warmth, confidence and id."""
    facts = b.latest(spark, folder, "decisions", "source", "confidence", "created_at", "last_hit_at", "valid_until")
    live = facts.where(F.col("valid_until").isNull() | (timestamp_of(F.col("valid_until")) > F.lit(AT).cast("timestamp")))
    factor = curation.heat_multiplier(timestamp_of(F.col("created_at")), timestamp_of(F.col("last_hit_at")), F.lit(AT).cast("timestamp"))
    rows = live.select("id", F.when(F.col("source") == "manual", 0).otherwise(1).alias("place"), factor.alias("factor"), "confidence")
    return rows.orderBy("place", F.col("factor").desc(), F.col("confidence").desc_nulls_last(), "id").limit(100).select("id", "factor", "confidence")


def b13_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes (files and symbols) per file that owns them."""
    files = b.latest(spark, folder, "files", "path").select(F.lit("file").alias("node_type"), F.col("id").alias("ref_id"))
    symbols = b.latest(spark, folder, "symbols", "file_id").select("id", "file_id")
    nodes = files.unionByName(symbols.select(F.lit("symbol").alias("node_type"), F.col("id").alias("ref_id")))
    joined = nodes.join(symbols.select(F.lit("symbol").alias("node_type"), F.col("id").alias("ref_id"), "file_id"), ["node_type", "ref_id"], "left")
    return joined.groupBy(F.when(F.col("node_type") == "file", F.col("ref_id")).otherwise(F.col("file_id")).alias("file_id")).agg(F.count("*").alias("nodes"))


def k40_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each month as snapshots: their number and worth, and the change since the month before."""
    orders = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.lit(1).alias("n"), F.floor("o_totalprice").alias("worth"))
    return sinks.timeline(orders, ["n", "worth"])


def g6_branch_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols as first loaded before July and as they are now: added, removed, modified, per kind."""
    symbols = table(spark, folder, "symbols").where("id is not null").select("id", "loaded_at", "kind", "line_start")
    base = first_version(symbols.where("loaded_at < timestamp '2025-07-01'"), ["id"]).select("id", "line_start")
    head = b.latest(spark, folder, "symbols", "kind", "line_start").select("id", "kind", "line_start")
    diff = graph.snapshot_diff(base, head.select("id", "line_start"), ["id"], "line_start")
    return diff.join(head.select("id", "kind"), "id", "left").groupBy("kind", "change").agg(F.count("*").alias("n"))


def g7_endpoint_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Operations that contracts declare (with an operation) and services answer (with a response), one without the other."""
    e = b.latest(spark, folder, "api_endpoints", "method", "path", "operation_id", "response_schema").where("method is not null and path is not null")
    keyed = e.select(F.upper("method").alias("method"), url_pattern(F.col("path")).alias("pattern"), "operation_id", "response_schema")
    return topology.contract_drift(keyed.where("operation_id is not null"), keyed.where("response_schema is not null"), ["method", "pattern"])


def e4_oldest_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Orders a month of each customer: the last month against the first."""
    n = table(spark, folder, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return history.oldest_delta(n, "o_custkey", "month", "n")


def m11_line_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a part's lines that come from each supplier."""
    return history.share_of_total(table(spark, folder, "lineitem"), ["l_partkey"], ["l_suppkey"])


def usage_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each server, and the share without an error."""
    calls = b.latest(spark, folder, "tool_calls", "tool_server", "is_error")
    g = calls.groupBy("tool_server").agg(F.count("*").alias("shown"), F.count_if(F.col("is_error") == 0).alias("accepted"))
    return g.select("*", round_half_up(F.col("accepted") / F.col("shown"), 4).alias("ratio"))


def k22_community(spark: SparkSession, folder: str) -> DataFrame:
    """Each module with its files, its links inside and outside, and its most linked file."""
    files = b.code_files(spark, folder).select(F.col("file_id").alias("node"), module_of(F.col("path"), 2).alias("community"))
    edges = b.imports(spark, folder)
    quality = graph.partition_quality(edges, files)
    degree = graph.degrees(edges).select("node", (F.col("n_in") + F.col("n_out")).alias("degree"))
    top = files.join(degree, "node").groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node"))["node"].alias("hub"))
    return quality.join(top, "community", "left").select("community", "n_nodes", "internal", "external", "hub")


def k32_related_files(spark: SparkSession, folder: str) -> DataFrame:
    edges = b.imports(spark, folder)
    target = edges.groupBy("dst").count().orderBy(F.col("count").desc(), "dst").first()["dst"]
    files = b.code_files(spark, folder).select(F.col("file_id").alias("node"), module_of(F.col("path"), 2).alias("module"), F.array_distinct(segments(F.regexp_extract("path", r"([^/]+)$", 1))).alias("parts"))
    return graph.related(edges, files, target)


def k9_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """References to each part by the kind of their edge (the ship mode of the line before)."""
    a = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("type"))
    z = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(z, ["l_orderkey", "l_linenumber"]).where("src <> dst").groupBy("dst", "type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


def q8_cross_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Imports between the nations whose suppliers deliver a part (a part belongs to many)."""
    nations = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("domain"))
    member = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(nations, "s_suppkey").select("node", "domain").distinct()
    return topology.cross_domain(b.imports(spark, folder), member)


def c16_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Files of calls mapped to indexed files: by path, else by name, else by folder."""
    calls = b.latest(spark, folder, "tool_calls", "target_file").where("target_file is not null").select("target_file").distinct()
    files = b.latest(spark, folder, "files", "path").where("path is not null").select(F.col("id").alias("file_id"), "path")
    name, place = lambda c: F.regexp_extract(c, r"([^/]+)$", 1), lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    by = lambda key: calls.select("target_file", key("target_file").alias("k")).where("k <> ''").join(files.groupBy(key("path").alias("k")).agg(F.min("file_id").alias("file_id")), "k").select("target_file", "file_id")
    return topology.first_match([(by(F.col), 1.0), (by(name), 0.7), (by(place), 0.4)], calls, "target_file", "file_id")


def h31_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Files by how many signs of risk agree on them."""
    changes = b.commit_files(spark, folder).join(b.commits(spark, folder), "commit_id").groupBy("file_id").agg(F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes"))
    users = b.imports(spark, folder).groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("users"))
    rows = b.code_files(spark, folder).join(changes, "file_id", "left").join(users, "file_id", "left").na.fill(0)
    fired = sum((F.when(c, 1).otherwise(0) for c in (F.col("max_cyclomatic") > 30, F.col("commits") > 30, F.col("fixes") >= 6, F.col("users") >= 2)), F.lit(0))
    level = F.when(fired >= 4, "multi").when(fired == 3, "high").when(fired == 2, "medium").otherwise("low")
    return rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def h30_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of the values of several text fields."""
    calls = b.latest(spark, folder, "tool_calls", "input_snippet", "target_file", "is_error")
    values = calls.select(F.explode(F.array("input_snippet", "target_file", F.col("is_error").cast("string"), F.lit("3.5"), F.lit("yes"), F.lit("https://a.example/x"))).alias("v"))
    return values.groupBy(detectors.env_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


def h21_branches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy("source").agg(F.sum(branch_complexity(F.col("text"))).alias("branches"), F.max(branch_complexity(F.col("text"))).cast("long").alias("most"))


def b8_glob(spark: SparkSession, folder: str) -> DataFrame:
    files = b.latest(spark, folder, "files", "path")
    return files.where(F.col("path").rlike(glob_to_regex("src/**/*.{ts,go}"))).select("id", "path")


def h20_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of equal content by the start of their hash."""
    docs = table(spark, folder, "documents").where("text is not null").select(F.substring(F.sha1("text"), 1, 16).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"))


def h18_times(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their instant and duration as nanoseconds in text, read back."""
    events = table(spark, folder, "events")
    start = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("789"))
    rows = events.select("event_id", iso_of_nanos(start).alias("at"), micros_between(start, F.concat((F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000).cast("string"), F.lit("000"))).alias("micros"))
    return rows


def k21_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Workspaces as communities, labelled by what their files' folders say."""
    files = b.latest(spark, folder, "files", "path", "workspace").where("path is not null and workspace is not null")
    return graph.label_communities(files.select(F.col("id").alias("node"), F.col("workspace").alias("community")), files.select(F.col("id").alias("node"), "path"))


def k7_question(spark: SparkSession, folder: str) -> DataFrame:
    """What depends on the most imported file, asked by its name."""
    edges = b.imports(spark, folder)
    names = b.code_files(spark, folder).select(F.col("file_id").alias("node"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    top = edges.groupBy("dst").count().orderBy(F.col("count").desc(), "dst").first()["dst"]
    name = names.where(F.col("node") == top).first()["name"]
    _, part = graph.answer(edges, names, f"what depends on {name}?")
    return part.select("node", F.col("depth").cast("long").alias("depth"))


def l1_index(spark: SparkSession, folder: str) -> DataFrame:
    """The full-text query out of an index written once."""
    place = scratch(spark, "index")
    search.write_index(b.latest(spark, folder, "decisions", "title", "content"), "id", {"title": 5.0, "content": 1.0}, place)
    return search.search_index(spark, place, "id", "cursor AND keeper")


def l18_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors nearest to that of the smallest id."""
    vectors = table(spark, folder, "embeddings")
    return search.similar_to(vectors, "vec_id", "embedding", vectors.agg(F.min("vec_id")).first()[0], 10)


def n11_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of the documents that record a decision, with what a quality rule says of them."""
    found = memory.extract(table(spark, folder, "documents"), "doc_id", "text")
    judged = found.withColumn("reason", F.coalesce(curation.reject_reason(F.substring("sentence", 1, 80), F.col("sentence")), F.lit("kept")))
    return judged.groupBy("cue", "confidence", "reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("place").alias("furthest"))


def k36_tree(spark: SparkSession, folder: str) -> DataFrame:
    """What hangs below each class, with the names on the way."""
    symbols = b.latest(spark, folder, "symbols", "parent_id", "kind", "name").where("name is not null")
    edges = symbols.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.col("kind").alias("type"))
    return graph.tree(edges, symbols.where("kind = 'class'").select(F.col("id").alias("node")), symbols.select(F.col("id").alias("node"), "name"), types=["method"])


def q2_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Services that a change of the most linked service may reach, over shared endpoints, by distance."""
    links = b.latest(spark, folder, "api_endpoints", "service_id", "path").where("path is not null and service_id is not null")
    keyed = links.select("service_id", url_pattern(F.col("path")).alias("p")).distinct()
    a, z = keyed.withColumnRenamed("service_id", "src"), keyed.withColumnRenamed("service_id", "dst")
    edges = a.join(z, "p").where("src <> dst").select("src", "dst").distinct()
    start = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "node").limit(1).select("node")
    return graph.reach(edges, start, max_depth=4).select("node", F.col("depth").cast("long").alias("depth"))


def q8_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Folders as a tree of domains: files at or below each, and the languages there."""
    files = b.latest(spark, folder, "files", "path", "language").where("path is not null")
    return topology.domain_tree(files.select("path", F.lower("language").alias("kind")), 3)


def p13_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The five last sessions of each project with their most used files."""
    sessions = b.latest(spark, folder, "sessions", "project_path", "started_at").where("project_path is not null").select("id", "project_path", timestamp_of(F.col("started_at")).alias("at"))
    last = sessions.withColumn("place", F.row_number().over(Window.partitionBy("project_path").orderBy(F.col("at").desc_nulls_last(), "id"))).where("place <= 5")
    used = b.latest(spark, folder, "tool_calls", "session_id", "target_file").where("target_file is not null and session_id <> ''").groupBy("session_id", "target_file").agg(F.count("*").alias("n"))
    top = used.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("n").desc(), "target_file"))).where("r <= 3").groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "target_file"))), lambda x: x["target_file"]), ",").alias("files"))
    return last.join(top, F.col("id") == F.col("session_id"), "left").select("project_path", F.col("place").cast("long").alias("place"), "id", "files")


def usage_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What sessions do again: reads of a file, searches, commands; how often, and the tokens of the repeats."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "tool_short_name", "target_file", "input_snippet", "output_tokens_estimate").where("session_id <> ''")
    what = F.when((F.col("tool_short_name") == "Read") & F.col("target_file").isNotNull(), F.struct(F.lit("read").alias("rule"), F.col("target_file").alias("what"), F.lit(3).alias("least"))).when(
        F.col("input_snippet").isNotNull(), F.struct(F.when(F.col("tool_short_name") == "search", "search").otherwise("command").alias("rule"), F.col("input_snippet").alias("what"), F.lit(2).alias("least"))
    )
    rows = calls.withColumn("w", what).where("w is not null").groupBy("session_id", "w").agg(F.count("*").alias("n"), F.sum("output_tokens_estimate").alias("tokens"), F.max("output_tokens_estimate").alias("once")).where(F.col("n") >= F.col("w.least"))
    return rows.groupBy(F.col("w.rule").alias("rule")).agg(F.count("*").alias("groups"), F.sum("n").alias("calls"), F.sum(F.col("tokens") - F.col("once")).alias("tokens"))


def r5_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Names that documents and commands assign and use."""
    docs = table(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    return flows.data_flow(docs, "key", "text")


def k13_specifiers(spark: SparkSession, folder: str) -> DataFrame:
    """What the part with the most lines imports and what imports it (the next and the line before of an order), with the flags as specifiers."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("specifier"))
    edges = a.join(lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]).where("src <> dst")
    top = lines.groupBy("l_partkey").count().orderBy(F.col("count").desc(), "l_partkey").first()["l_partkey"]
    ways = edges.where(F.col("src") == top).select(F.lit("out").alias("way"), F.col("dst").alias("file"), "specifier").unionByName(edges.where(F.col("dst") == top).select(F.lit("in").alias("way"), F.col("src").alias("file"), "specifier"))
    return ways.groupBy("way", "file").agg(F.array_join(F.array_sort(F.collect_set("specifier")), ",").alias("specifiers"))


def k30_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Exported symbols by how far calls know them: their file, their name."""
    symbols = b.latest(spark, folder, "symbols", "file_id", "name", "metadata").where((F.get_json_object("metadata", "$.exported") == "true") & F.col("name").isNotNull())
    files = b.latest(spark, folder, "files", "path").select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    calls = table(spark, folder, "tool_calls")
    touched = calls.where("target_file is not null").select(F.col("target_file").alias("file"))
    named = calls.where("input_snippet is not null").select(F.explode(F.regexp_extract_all("input_snippet", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("name"))
    return code.untested_levels(symbols.join(files, "file_id").select("id", "file", "name"), touched, named).groupBy("level").agg(F.count("*").alias("n"))


def m10_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Files a month of each author over an evenly sampled history: where it goes."""
    changes = b.commit_files(spark, folder).join(b.commits(spark, folder), "commit_id")
    n = changes.groupBy("author", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_files"))
    return history.trend(history.sampled_evenly(n, "author", "month", 10), "author", "month", "n_files", k=2)


def _run(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """What a stream yields until its sources end, written into the shared folder."""
    path = scratch(spark, "stream")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/events.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    source = spark.readStream.schema(table(spark, folder, "events").schema)
    events = source.parquet(path) if whole else source.option("pathGlobFilter", "events.parquet").parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def i2_hourly_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of the event stream that the watermark has closed."""
    events = _events(spark, folder).select(F.col("event_type").alias("service"), "ts", F.col("value").alias("duration"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"))
    return _run(streams.hourly_stream(events, "service"), spark).select("service", "hour", "calls", "errors", round_half_up(F.col("total"), 2).alias("total"), "most")


def i4_unique_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the stream delivered twice, each once, counted per kind."""
    events = _events(spark, folder)
    twice = events.unionByName(events).select("event_id", "event_type", "ts")
    return _run(streams.unique_spans(twice, ["event_id"]), spark).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    l20_sessions, q6_weighted, n1_ordered, b13_owners, k40_timeline, g6_branch_diff, g7_endpoint_drift, e4_oldest_delta, m11_line_owners, usage_channels, k22_community, k32_related_files, k9_by_type,
    q8_cross_domain, c16_mapped, h31_levels, h30_kinds, h21_branches, b8_glob, h20_hashes, h18_times, i2_hourly_stream, i4_unique_stream,
    k21_labels, k7_question, l1_index, l18_similar, n11_extracted, k36_tree, q2_impact, q8_tree, p13_resume, usage_repeats, r5_flows, k13_specifiers, k30_levels, m10_trends,
)}

_TS = "try_cast(replace(replace({0}, 'T', ' '), 'Z', '+00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"
_PARTS = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\-.:/]+'), lambda s: s <> ''))"

_CUED = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{n}'" for n, p, _ in sorted(memory.CUES, key=lambda c: -c[2])) + " END"

ORACLES = {
    "k13_specifiers": """WITH t AS (SELECT l_partkey AS t FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 1), e AS (SELECT a.l_partkey AS src, z.l_partkey AS dst, a.l_returnflag AS s FROM lineitem a JOIN lineitem z ON a.l_orderkey = z.l_orderkey AND z.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> z.l_partkey),
      w AS (SELECT 'out' AS way, dst AS file, s FROM e, t WHERE src = t UNION ALL SELECT 'in', src, s FROM e, t WHERE dst = t) SELECT way, file, string_agg(DISTINCT s, ',' ORDER BY s) AS specifiers FROM w GROUP BY 1, 2""",
    "k30_levels": f"""WITH s AS (SELECT s.id, s.name, f.path FROM {b.latest_sql('symbols', 'file_id', 'name', 'metadata')} s JOIN {b.latest_sql('files', 'path')} f ON f.id = s.file_id WHERE s.name IS NOT NULL AND json_extract_string(s.metadata, '$.exported') = 'true'),
      w AS (SELECT DISTINCT unnest(regexp_extract_all(input_snippet, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM tool_calls WHERE input_snippet IS NOT NULL), l AS (SELECT CASE WHEN path IS NULL OR path NOT IN (SELECT target_file FROM tool_calls WHERE target_file IS NOT NULL) THEN 'unreached' WHEN name NOT IN (SELECT name FROM w) THEN 'imported_not_called' END AS level FROM s)
      SELECT level, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY 1""",
    "m10_trends": b.with_views("commits", "cf") + """, n AS (SELECT author, strftime(ts, '%Y-%m') AS month, count(*) AS n_files FROM cf JOIN commits USING (commit_id) GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY month DESC) - 1 AS i, count(*) OVER (PARTITION BY author) AS c FROM n),
      s AS (SELECT * FROM i WHERE i % greatest(CAST(ceil(c / 10.0) AS BIGINT), 1) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY month) AS f, row_number() OVER (PARTITION BY author ORDER BY month DESC) AS l FROM s),
      g AS (SELECT author, count(*) AS n_points, floor((avg(n_files) FILTER (l <= 2) - avg(n_files) FILTER (f <= 2)) * 1e4 + 0.5) / 1e4 AS delta FROM r GROUP BY 1) SELECT *, CASE WHEN delta > 0.05 THEN 'rising' WHEN delta < -0.05 THEN 'falling' ELSE 'steady' END AS direction FROM g""",
    "k36_tree": f"""WITH RECURSIVE s AS (SELECT * FROM {b.latest_sql('symbols', 'parent_id', 'kind', 'name')} WHERE name IS NOT NULL), t(root, node, depth, path) AS (SELECT id, id, 0, name FROM s WHERE kind = 'class' UNION ALL SELECT t.root, s.id, t.depth + 1, t.path || ' > ' || s.name FROM t JOIN s ON s.parent_id = t.node AND s.kind = 'method' WHERE t.depth < 10)
      SELECT root, node, CAST(depth AS BIGINT) AS depth, path FROM t""",
    "q2_impact": f"""WITH RECURSIVE k AS (SELECT DISTINCT service_id, {_PATTERN.format('path')} AS p FROM {b.latest_sql('api_endpoints', 'service_id', 'path')} WHERE path IS NOT NULL AND service_id IS NOT NULL), e AS (SELECT DISTINCT a.service_id AS src, z.service_id AS dst FROM k a JOIN k z ON a.p = z.p AND a.service_id <> z.service_id),
      h(node, depth) AS (SELECT (SELECT src FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1), 0 UNION SELECT e.dst, h.depth + 1 FROM h JOIN e ON e.src = h.node WHERE h.depth < 4) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM h GROUP BY 1""",
    "q8_tree": f"""WITH f AS (SELECT string_split(path, '/') AS p, lower(language) AS kind FROM {b.latest_sql('files', 'path', 'language')} WHERE path IS NOT NULL), d AS (SELECT unnest(list_transform(range(1, least(len(p) - 1, 3) + 1), lambda i: array_to_string(p[1:i], '/'))) AS domain, kind FROM f)
      SELECT domain, CASE WHEN contains(domain, '/') THEN regexp_replace(domain, '/[^/]*$', '') ELSE '' END AS parent, CAST(length(domain) - length(replace(domain, '/', '')) + 1 AS BIGINT) AS depth, count(*) AS n, count(DISTINCT kind) AS kinds FROM d GROUP BY 1""",
    "p13_resume": f"""WITH l AS (SELECT id, project_path, row_number() OVER (PARTITION BY project_path ORDER BY {_TS.format('started_at')} DESC NULLS LAST, id) AS place FROM {b.latest_sql('sessions', 'project_path', 'started_at')} WHERE project_path IS NOT NULL QUALIFY place <= 5),
      u AS (SELECT session_id, target_file, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, target_file) AS r FROM {b.latest_sql('tool_calls', 'session_id', 'target_file')} WHERE target_file IS NOT NULL AND session_id <> '' GROUP BY 1, 2 QUALIFY r <= 3), t AS (SELECT session_id, string_agg(target_file, ',' ORDER BY r) AS files FROM u GROUP BY 1)
      SELECT project_path, place, id, files FROM l LEFT JOIN t ON t.session_id = l.id""",
    "usage_repeats": f"""WITH c AS (SELECT session_id, CASE WHEN tool_short_name = 'Read' AND target_file IS NOT NULL THEN 'read' WHEN input_snippet IS NOT NULL THEN CASE WHEN tool_short_name = 'search' THEN 'search' ELSE 'command' END END AS rule, CASE WHEN tool_short_name = 'Read' AND target_file IS NOT NULL THEN target_file ELSE input_snippet END AS what, output_tokens_estimate AS t
      FROM {b.latest_sql('tool_calls', 'session_id', 'tool_short_name', 'target_file', 'input_snippet', 'output_tokens_estimate')} WHERE session_id <> ''), g AS (SELECT rule, count(*) AS n, sum(t) AS tokens, max(t) AS once FROM c WHERE rule IS NOT NULL GROUP BY session_id, rule, what HAVING count(*) >= CASE WHEN rule = 'read' THEN 3 ELSE 2 END)
      SELECT rule, count(*) AS groups, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(tokens - once) AS BIGINT) AS tokens FROM g GROUP BY 1""",
    "k21_labels": f"""WITH f AS (SELECT workspace AS community, path FROM {b.latest_sql('files', 'path', 'workspace')} WHERE path IS NOT NULL AND workspace IS NOT NULL), p AS (SELECT community, unnest(string_split(path, '/')) AS f FROM f), n AS (SELECT community, f, count(*) AS n FROM p
      WHERE f NOT IN ('src', 'lib', 'app', 'dist', 'build', 'node_modules', 'vendor', 'index') AND NOT contains(f, '.') AND f <> '' GROUP BY 1, 2), l AS (SELECT community, first(f ORDER BY n DESC, f) AS label FROM n GROUP BY 1) SELECT DISTINCT f.community, coalesce(label, 'root') AS label FROM f LEFT JOIN l USING (community)""",
    "k7_question": b.with_views("im", recursive=True) + """, hit(node, depth) AS (SELECT (SELECT dst FROM im GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), 0 UNION SELECT im.src, hit.depth + 1 FROM hit JOIN im ON im.dst = hit.node WHERE hit.depth < 2) SELECT node, CAST(-min(depth) AS BIGINT) AS depth FROM hit GROUP BY 1""",
    "l1_index": f"WITH {_bm25()} SELECT * FROM bm",
    "l18_similar": "WITH q AS (SELECT embedding AS v, vec_id AS o FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS similarity FROM embeddings, q WHERE vec_id <> o ORDER BY similarity DESC, vec_id LIMIT 10",
    "n11_extracted": f"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]\\s+|\\n+') AS a FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(a) AS sentence, unnest(range(0, len(a))) AS place FROM s), c AS (SELECT doc_id, place, {_CUED} AS cue, trim(substr(sentence, 1, 80)) AS t, trim(sentence) AS c FROM l)
      SELECT cue, CASE cue {" ".join(f"WHEN '{n}' THEN {w}" for n, _, w in memory.CUES)} END::DOUBLE AS confidence, {_REASON} AS reason, count(*) AS n, count(DISTINCT doc_id) AS docs, max(place)::BIGINT AS furthest FROM c WHERE cue IS NOT NULL GROUP BY 1, 2, 3""",
    "q6_weighted": f"""WITH s AS {b.latest_sql('decisions', 'project_root', 'service_name', 'git_branch')}, i AS (SELECT DISTINCT project_root, 'service:' || service_name AS e, 3.0::DOUBLE AS w FROM s WHERE service_name IS NOT NULL UNION SELECT DISTINCT project_root, 'branch:' || git_branch, CASE WHEN git_branch = 'main' THEN 0.25::DOUBLE ELSE 1.0 END FROM s WHERE git_branch IS NOT NULL)
      SELECT a.project_root AS group_a, z.project_root AS group_b, count(*) AS n_shared, floor(sum(a.w) * 1000 + 0.5) / 1000 AS weight FROM i a JOIN i z ON a.e = z.e AND a.project_root < z.project_root GROUP BY 1, 2""",
    "n1_ordered": f"""WITH s AS (SELECT id, source, confidence, {_TS.format('created_at')} AS c, {_TS.format('last_hit_at')} AS h, valid_until, {_TS.format('valid_until')} AS u FROM {b.latest_sql('decisions', 'source', 'confidence', 'created_at', 'last_hit_at', 'valid_until')}),
      f AS (SELECT *, (epoch_us(TIMESTAMP '{AT}') - epoch_us(greatest(c, h))) / 86400000000.0 AS age FROM s WHERE valid_until IS NULL OR u > TIMESTAMP '{AT}'), g AS (SELECT id, source, confidence, CASE WHEN age IS NULL THEN 1.0 WHEN age <= 7 THEN 1.5 WHEN age > 90 THEN 0.3 ELSE 1.0 END::DOUBLE AS factor FROM f)
      SELECT id, factor, confidence FROM g ORDER BY CASE WHEN source = 'manual' THEN 0 ELSE 1 END, factor DESC, confidence DESC NULLS LAST, id LIMIT 100""",
    "b13_owners": f"WITH s AS {b.latest_sql('symbols', 'file_id')}, n AS (SELECT id AS file_id FROM {b.latest_sql('files', 'path')} UNION ALL SELECT file_id FROM s) SELECT file_id, count(*) AS nodes FROM n GROUP BY 1",
    "k40_timeline": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS snapshot, count(*)::DOUBLE AS n, sum(floor(o_totalprice))::DOUBLE AS worth FROM orders GROUP BY 1), u AS (SELECT snapshot, 'n' AS metric, n AS value FROM m UNION ALL SELECT snapshot, 'worth', worth FROM m)
      SELECT *, value - lag(value) OVER (PARTITION BY metric ORDER BY snapshot) AS change FROM u""",
    "g6_branch_diff": f"""WITH a AS (SELECT id, first(line_start ORDER BY loaded_at, kind NULLS FIRST, line_start NULLS FIRST) AS v FROM symbols WHERE id IS NOT NULL AND loaded_at < TIMESTAMP '2025-07-01' GROUP BY 1), z AS (SELECT id, kind, line_start AS v FROM {b.latest_sql('symbols', 'kind', 'line_start')})
      SELECT z.kind, CASE WHEN a.v IS NULL THEN 'added' WHEN z.v IS NULL THEN 'removed' WHEN a.v <> z.v THEN 'modified' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN z ON a.id = z.id GROUP BY 1, 2""",
    "g7_endpoint_drift": f"""WITH e AS (SELECT upper(method) AS method, {_PATTERN.format('path')} AS pattern, operation_id, response_schema FROM {b.latest_sql('api_endpoints', 'method', 'path', 'operation_id', 'response_schema')} WHERE method IS NOT NULL AND path IS NOT NULL),
      d AS (SELECT method, pattern FROM e WHERE operation_id IS NOT NULL), i AS (SELECT method, pattern FROM e WHERE response_schema IS NOT NULL) SELECT *, 'declared_only' AS side FROM (SELECT * FROM d EXCEPT SELECT * FROM i) UNION ALL SELECT *, 'implemented_only' FROM (SELECT * FROM i EXCEPT SELECT * FROM d)""",
    "e4_oldest_delta": """WITH n AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, (first(n ORDER BY month DESC, n DESC) - first(n ORDER BY month, n))::DOUBLE AS delta FROM n GROUP BY 1)
      SELECT *, CASE WHEN delta > 0.1 THEN 'rising' WHEN delta < -0.1 THEN 'falling' ELSE 'steady' END AS direction FROM g""",
    "m11_line_owners": "SELECT l_partkey, l_suppkey, count(*) AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_partkey) * 1000 + 0.5) / 1000 AS share FROM lineitem GROUP BY 1, 2",
    "usage_channels": f"SELECT tool_server, count(*) AS shown, count(*) FILTER (is_error = 0) AS accepted, floor(count(*) FILTER (is_error = 0)::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS ratio FROM {b.latest_sql('tool_calls', 'tool_server', 'is_error')} GROUP BY 1",
    "k22_community": b.with_views("im", "fl") + """, m AS (SELECT file_id AS node, regexp_extract(path, '^[^/]+/[^/]+') AS community FROM fl), e AS (SELECT a.community AS ca, z.community AS cz FROM im JOIN m a ON a.node = src JOIN m z ON z.node = dst),
      t AS (SELECT community, sum(i) AS internal, sum(x) AS external FROM (SELECT ca AS community, (ca = cz)::INT AS i, (ca <> cz)::INT AS x FROM e UNION ALL SELECT cz, 0, 1 FROM e WHERE ca <> cz) GROUP BY 1), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM im UNION ALL SELECT dst FROM im) GROUP BY 1),
      h AS (SELECT community, first(m.node ORDER BY degree DESC, m.node) AS hub FROM m JOIN d ON d.node = m.node GROUP BY 1) SELECT m.community, count(*) AS n_nodes, CAST(coalesce(max(internal), 0) AS BIGINT) AS internal, CAST(coalesce(max(external), 0) AS BIGINT) AS external, max(hub) AS hub FROM m LEFT JOIN t USING (community) LEFT JOIN h USING (community) GROUP BY 1""",
    "k32_related_files": b.with_views("im", "fl") + f""", t AS (SELECT dst FROM im GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), i AS (SELECT DISTINCT src FROM im WHERE dst = (SELECT dst FROM t)), f AS (SELECT file_id AS node, regexp_extract(path, '^[^/]+/[^/]+') AS module, {_PARTS} AS parts FROM fl),
      s AS (SELECT dst AS node, floor(count(DISTINCT src)::DOUBLE / (SELECT count(*) FROM i) * 1000 + 0.5) / 1000 AS ratio FROM im WHERE src IN (SELECT src FROM i) GROUP BY 1), o AS (SELECT module AS m, parts AS p FROM f WHERE node = (SELECT dst FROM t)),
      r AS (SELECT f.node, floor((CASE WHEN module = m THEN 0.3::DOUBLE ELSE 0 END + coalesce(ratio, 0) * 0.5::DOUBLE + len(list_intersect(parts, p))::DOUBLE / len(list_distinct(list_concat(parts, p))) * 0.2::DOUBLE) * 1e4 + 0.5) / 1e4 AS score FROM f LEFT JOIN s ON s.node = f.node, o WHERE f.node <> (SELECT dst FROM t)) SELECT * FROM r WHERE score > 0""",
    "k9_by_type": "SELECT z.l_partkey AS dst, a.l_returnflag AS type, count(*) AS n, count(DISTINCT a.l_partkey) AS sources FROM lineitem a JOIN lineitem z ON a.l_orderkey = z.l_orderkey AND z.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> z.l_partkey GROUP BY 1, 2",
    "q8_cross_domain": b.with_views("im") + """, m AS (SELECT DISTINCT l_partkey AS node, s_nationkey AS domain FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT a.domain AS from_domain, z.domain AS to_domain, count(*) AS n_edges FROM im JOIN m a ON a.node = src JOIN m z ON z.node = dst WHERE a.domain <> z.domain GROUP BY 1, 2)
      SELECT *, floor(n_edges::DOUBLE / sum(n_edges) OVER (PARTITION BY from_domain) * 1000 + 0.5) / 1000 AS share FROM n""",
    "c16_mapped": f"""WITH c AS (SELECT DISTINCT target_file AS t FROM {b.latest_sql('tool_calls', 'target_file')} WHERE target_file IS NOT NULL), f AS (SELECT id, path FROM {b.latest_sql('files', 'path')} WHERE path IS NOT NULL), k AS (
      SELECT t, min(id) AS id, 1.0::DOUBLE AS c FROM c JOIN f ON path = t GROUP BY 1 UNION ALL SELECT t, min(id), 0.7 FROM c JOIN f ON regexp_extract(path, '([^/]+)$', 1) = regexp_extract(t, '([^/]+)$', 1) GROUP BY 1
      UNION ALL SELECT t, min(id), 0.4 FROM c JOIN f ON regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(t, '^(.*)/[^/]*$', 1) AND regexp_extract(t, '^(.*)/[^/]*$', 1) <> '' GROUP BY 1)
      SELECT c.t AS target_file, k.id AS file_id, k.c AS confidence FROM c LEFT JOIN k ON k.t = c.t QUALIFY row_number() OVER (PARTITION BY c.t ORDER BY k.c DESC NULLS LAST, k.id) = 1""",
    "h31_levels": b.with_views("commits", "cf", "fl", "im") + """, h AS (SELECT file_id, count(*) AS commits, count(*) FILTER (is_fix) AS fixes FROM cf JOIN commits USING (commit_id) GROUP BY 1), u AS (SELECT dst AS file_id, count(*) AS users FROM im GROUP BY 1),
      s AS (SELECT (max_cyclomatic > 30)::INT + (coalesce(commits, 0) > 30)::INT + (coalesce(fixes, 0) >= 6)::INT + (coalesce(users, 0) >= 2)::INT AS n FROM fl LEFT JOIN h USING (file_id) LEFT JOIN u USING (file_id)) SELECT CASE WHEN n >= 4 THEN 'multi' WHEN n = 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM s GROUP BY 1""",
    "h30_kinds": f"""WITH c AS {b.latest_sql('tool_calls', 'input_snippet', 'target_file', 'is_error')}, v AS (SELECT unnest([input_snippet, target_file, CAST(is_error AS VARCHAR), '3.5', 'yes', 'https://a.example/x']) AS v FROM c)
      SELECT CASE WHEN v IS NULL OR v = '' THEN 'empty' WHEN regexp_matches(v, '(?i)^(true|false|yes|no|on|off)$') THEN 'boolean' WHEN regexp_matches(v, '^-?\\d+$') THEN 'integer' WHEN regexp_matches(v, '^-?\\d*\\.\\d+$') THEN 'number' WHEN regexp_matches(v, '^[a-z][a-z0-9+.-]*://') THEN 'url'
        WHEN regexp_matches(v, '^\\S+@\\S+\\.\\S+$') THEN 'email' WHEN regexp_matches(v, '^(\\.{{0,2}}/|~/|[A-Z]:\\\\)') THEN 'path' WHEN regexp_matches(v, '^[\\[{{].*[\\]}}]$') THEN 'json' ELSE 'text' END AS kind, count(*) AS n FROM v GROUP BY 1""",
    "h21_branches": """WITH d AS (SELECT source, 1 + len(regexp_extract_all(regexp_replace(text, '("(\\\\.|[^"\\\\])*"|''(\\\\.|[^''\\\\])*''|//[^\\n]*)', ' ', 'g'), '(\\b(?:if|for|while|case|catch)\\b|&&|\\|\\||\\?)')) AS n FROM documents WHERE text IS NOT NULL) SELECT source, CAST(sum(n) AS BIGINT) AS branches, max(n) AS most FROM d GROUP BY 1""",
    "b8_glob": f"SELECT id, path FROM {b.latest_sql('files', 'path')} WHERE regexp_matches(path, '{glob_to_regex('src/**/*.{ts,go}')}')",
    "h20_hashes": "SELECT substr(sha1(text), 1, 16) AS hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "h18_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, CAST(floor(((event_id % 1000) * 1000 - 789) / 1000.0) AS BIGINT) AS micros FROM events",
    "i2_hourly_stream": """WITH e AS (SELECT event_type AS service, date_trunc('hour', ts) AS h, value, event_type = 'error' AS bad FROM events), g AS (SELECT service, h, count(*) AS calls, count(*) FILTER (bad) AS errors, floor(sum(value) * 100 + 0.5) / 100 AS total, max(value) AS most FROM e GROUP BY 1, 2)
      SELECT service, strftime(h, '%Y-%m-%dT%H') AS hour, calls, errors, total, most FROM g WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "i4_unique_stream": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}

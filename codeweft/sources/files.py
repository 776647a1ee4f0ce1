"""File sources: agent session logs, git logs, settings, contracts, manifests, source files."""

from __future__ import annotations

import contextlib
import re
import sqlite3
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import glob_to_regex
from codeweft.operators.detectors import env_type

_LOG = "type string, sessionId string, timestamp string, message struct<model:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long>,content:array<struct<type:string,id:string,name:string,text:string,input:string>>>"


def session_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, tool calls) out of JSON lines; broken lines are left out."""
    return _logs_of(spark.read.schema(_LOG).option("mode", "DROPMALFORMED").json(path))


def _logs_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = lines.where("sessionId is not null")
    usage = F.col("message.usage")
    sessions = lines.groupBy(F.col("sessionId").alias("id")).agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.max("message.model").alias("model"),
        F.coalesce(F.sum(usage["input_tokens"]), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(usage["output_tokens"]), F.lit(0)).alias("output_tokens"), F.count("*").alias("lines"),
    )
    used = lines.select("sessionId", "timestamp", F.explode("message.content").alias("c")).where("c.type = 'tool_use'")
    return sessions, used.select(F.col("c.id").alias("id"), F.col("sessionId").alias("session_id"), "timestamp", F.col("c.name").alias("tool_name"), F.col("c.input").alias("input"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, ts, author, subject, is_fix, path) from ``git log --name-only --format=%x01%H|%at|%ae|%s``."""
    whole = spark.read.option("lineSep", "\u0001").text(path).where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    head = F.split(lines[0], r"\|", 4)
    rows = whole.select(head.alias("h"), F.explode_outer(F.slice(lines, 2, F.size(lines))).alias("path"))
    subject = F.get("h", 3)
    return rows.select(F.get("h", 0).alias("commit_id"), F.timestamp_seconds(F.get("h", 1).cast("long")).alias("ts"), F.get("h", 2).alias("author"), subject.alias("subject"), F.coalesce(subject.rlike(r"(?i)\b(fix(es|ed)?|bug|hotfix)\b"), F.lit(False)).alias("is_fix"), "path")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind) of the assignments of settings files; values are not kept.

    Spark's file sources skip names that begin with a dot, so such files need another name.
    """
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_.]*\s*=\s*['\"]?(.*?)['\"]?\s*$", 1).alias("_v"))
    return rows.where("key <> ''").select("key", env_type(F.col("_v")).alias("kind"))


def openapi(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, method, operation_id) of JSON contracts, one document each."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    paths = F.from_json(F.get_json_object("value", "$.paths"), "map<string,map<string,string>>")
    rows = docs.select("file", F.explode(paths).alias("path", "_ops")).select("file", "path", F.explode("_ops").alias("_m", "_op"))
    return rows.where(F.col("_m").isin("get", "put", "post", "delete", "patch", "head", "options")).select("file", "path", F.upper("_m").alias("method"), F.get_json_object("_op", "$.operationId").alias("operation_id"))


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, path, method, operation_id) of OpenAPI documents in JSON, GraphQL schemas and protobuf services under ``path``."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    paths = F.from_json(F.get_json_object("value", "$.paths"), "map<string,map<string,string>>")
    api = docs.where(F.lower("file").endswith(".json")).select("file", F.explode(paths).alias("path", "_ops")).select("file", "path", F.explode("_ops").alias("_m", "_op"))
    api = api.where(F.col("_m").isin("get", "put", "post", "delete", "patch", "head", "options")).select("file", F.lit("openapi").alias("kind"), "path", F.upper("_m").alias("method"), F.get_json_object("_op", "$.operationId").alias("operation_id"))
    roots = F.regexp_extract_all("value", F.lit(r"(?s)\b((?:extend\s+)?type\s+(?:Query|Mutation|Subscription)\s*\{[^}]*\})"), F.lit(1))
    types = docs.where(F.lower("file").rlike(r"\.(graphql|gql)$")).select("file", F.explode(roots).alias("_t"))
    fields = F.regexp_extract_all(F.regexp_replace("_t", r"(?s)^[^{]*\{|#[^\n]*|\([^)]*\)", " "), F.lit(r"(\w+)\s*:"), F.lit(1))
    graphql = types.select("file", F.lit("graphql").alias("kind"), F.explode(fields).alias("path"), F.upper(F.regexp_extract("_t", r"type\s+(\w+)", 1)).alias("method"), F.lit(None).cast("string").alias("operation_id"))
    service = F.regexp_extract_all("value", F.lit(r"(?s)\b(service\s+\w+\s*\{.*?\n\})"), F.lit(1))
    services = docs.where(F.lower("file").endswith(".proto")).select("file", F.explode(service).alias("_s"))
    calls = services.select("file", F.regexp_extract("_s", r"service\s+(\w+)", 1).alias("_n"), F.explode(F.regexp_extract_all("_s", F.lit(r"\brpc\s+(\w+)"), F.lit(1))).alias("_c"))
    grpc = calls.select("file", F.lit("grpc").alias("kind"), F.concat(F.lit("/"), "_n", F.lit("/"), "_c").alias("path"), F.lit("RPC").alias("method"), F.col("_c").alias("operation_id"))
    return api.unionByName(graphql).unionByName(grpc)


# Manifests of package managers (ending, ecosystem, scope, pattern with package and version as groups).
_MANIFEST_LINES = [
    (r"requirements[^/]*\.txt$", "pip", "run", r"^\s*([A-Za-z][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([\w.*]+))?"),
    (r"go\.mod$", "go", "run", r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+v([\w.+-]+)"),
    (r"Cargo\.toml$", "cargo", "run", r"^\s*([A-Za-z][\w-]*)\s*=\s*(?:\"|\{[^}]*version\s*=\s*\")[\^~=]?([\w.*]+)\""),
    (r"Gemfile$", "gem", "run", r"^\s*gem\s+['\"]([\w-]+)['\"](?:\s*,\s*['\"][~><= ]*([\w.]+)['\"])?"),
    (r"pom\.xml$", "maven", "run", r"<artifactId>([\w.-]+)</artifactId>\s*<version>([\w.-]+)</version>"),
]
_MANIFEST_KEYS = [("package.json", "npm", "dependencies", "run"), ("package.json", "npm", "devDependencies", "dev"), ("composer.json", "composer", "require", "run"), ("composer.json", "composer", "require-dev", "dev")]


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, package, version, scope, ecosystem) of the package manifests under ``path``.

    Other files in JSON are read like npm manifests. A version that is not given is empty.
    """
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = []
    for name, kind, key, scope in _MANIFEST_KEYS:
        own = F.col("file").endswith("composer.json") if kind == "composer" else F.lower("file").endswith(".json") & ~F.col("file").endswith("composer.json")
        parts.append(docs.where(own).select("file", F.explode(F.from_json(F.get_json_object("value", f"$.{key}"), "map<string,string>")).alias("package", "version"), F.lit(scope).alias("scope"), F.lit(kind).alias("ecosystem")))
    for ending, kind, scope, pattern in _MANIFEST_LINES:
        text = F.regexp_replace("value", r"(?m)#.*$", "") if kind in ("pip", "cargo", "gem") else F.col("value")
        if kind == "cargo":  # only tables of dependencies
            text = F.array_join(F.regexp_extract_all(text, F.lit(r"(?ms)^\[(?:[\w.'-]*\.)?(?:dev-|build-)?dependencies\](.*?)(?=^\[|\z)"), F.lit(1)), "\n")
        found = F.regexp_extract_all(text, F.lit(f"(?m)({pattern})"), F.lit(1))
        rows = docs.where(F.col("file").rlike(f"(^|/){ending}")).select("file", F.explode(found).alias("_l"))
        parts.append(rows.select("file", F.regexp_extract("_l", pattern, 1).alias("package"), F.regexp_extract("_l", pattern, 2).alias("version"), F.lit(scope).alias("scope"), F.lit(kind).alias("ecosystem")).where("package <> ''"))
    return reduce(DataFrame.unionByName, parts)


def _ignored(root: str, rules: list[str]) -> Column:
    """Whether a path below ``root`` is ignored by rules in the manner of gitignore; later rules win, ``!`` takes back."""
    below = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(root.rstrip("/")) + "/", "")
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        body = glob_to_regex(rule.strip("/"))[1:-1]
        anchored = "/" in rule.strip("/") or rule.startswith("/")
        out = F.when(below.rlike(("^" if anchored else "(^|/)") + body + ("/" if rule.endswith("/") else "(/|$)")), not keep).otherwise(out)
    return out


def source_files(
    spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 1 << 20, *, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = ()
) -> DataFrame:
    """(path, length, hash, content_hash, text) of files up to a size, found recursively.

    ``include`` and ``exclude`` are globs over the path below ``path``, ``ignore`` the lines of an
    ignore file. ``hash`` tells changes, ``content_hash`` (the start of a SHA-1) contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).where(F.col("length") <= most_bytes)
    below = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(path.rstrip("/")) + "/", "")
    any_of = lambda globs: reduce(lambda a, b: a | b, (below.rlike(glob_to_regex(g)) for g in globs), F.lit(False))
    if include:
        files = files.where(any_of(include))
    files = files.where(~any_of(exclude) & ~_ignored(path, list(ignore)))
    return files.select("path", "length", F.xxhash64("content").alias("hash"), F.substring(F.sha1("content"), 1, 16).alias("content_hash"), F.col("content").cast("string").alias("text"))


def sqlite_rows(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files that all executors see, a task for each file, ``file`` in front."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf["file"]:
                with contextlib.closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as base:
                    cursor = base.execute(query)
                    names = [c[0] for c in cursor.description]
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names).assign(file=file)[["file", *names]]

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(len(paths), 1))
    return files.mapInPandas(read, f"file string, {schema}")


def with_bundles(own: DataFrame, bundles: dict[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """A table and those of installed bundles, each bundle's keys behind its name, with where a row is from."""
    out = own.withColumn("bundle", F.lit(None).cast("string"))
    for name, df in sorted(bundles.items()):
        marked = df.withColumns({k: F.concat(F.lit(f"{name}:"), F.col(k).cast("string")) for k in keys})
        out = out.withColumns({k: F.col(k).cast("string") for k in keys}).unionByName(marked.withColumn("bundle", F.lit(name)), allowMissingColumns=True)
    return out


def after_cursor(rows: DataFrame, at: str, key: str, cursor: tuple | None) -> tuple[DataFrame, tuple | None]:
    """Rows behind a cursor (time, key) and the cursor behind them; where nothing reaches the cursor the source was replaced and is read whole."""
    place = F.struct(F.col(at), F.col(key))
    last = rows.agg(F.max(place)).first()[0]
    if last is None:
        return rows.limit(0), cursor
    last = tuple(last)
    if cursor is None or last < cursor:
        return rows, last
    return rows.where(place > F.struct(F.lit(cursor[0]), F.lit(cursor[1]))), last


def reindex_plan(changed: DataFrame, most: int = 200) -> DataFrame:
    """(mode, n): whether that many changed files are read again one by one, or everything is."""
    return changed.agg(F.when(F.count("*") > most, "full").when(F.count("*") > 0, "changed").otherwise("none").alias("mode"), F.count("*").alias("n"))


def new_session_logs(spark: SparkSession, path: str, seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, calls, states) of the log files whose (path, modified) is not in ``seen``; the states are to be added to it.

    The list of new files is kept on the driver: a run's files, not their rows.
    """
    states = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"))
    new = states.join(seen.select("path", "modified").distinct(), ["path", "modified"], "left_anti")
    paths = [r.path for r in new.select("path").collect()]
    if not paths:
        return *_logs_of(spark.createDataFrame([], _LOG)), new
    return *_logs_of(spark.read.schema(_LOG).option("mode", "DROPMALFORMED").json(paths)), new


def diff_hunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, from_line, to_line) of the changed ranges, in the new version, of unified diffs."""
    parts = spark.read.option("lineSep", "diff --git ").text(path).select(F.regexp_extract("value", r"(?m)^\+\+\+ (?:b/)?(\S+)", 1).alias("file"), F.regexp_extract_all("value", F.lit(r"(?m)^@@ -[0-9,]+ \+([0-9,]+) @@"), F.lit(1)).alias("_h"))
    rows = parts.where("file not in ('', '/dev/null')").select("file", F.explode("_h").alias("_h")).select("file", F.split("_h", ",").alias("_p"))
    start, n = F.col("_p")[0].cast("long"), F.coalesce(F.get("_p", 1).cast("long"), F.lit(1))
    return rows.select("file", start.alias("from_line"), (start + F.greatest(n, F.lit(1)) - 1).alias("to_line"))


def blame_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, commit_id, author, ts) out of ``git blame --line-porcelain`` listings, one listing a file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(?ms)^([0-9a-f]{40} [0-9]+ [0-9]+.*?^\t)"), F.lit(1))).alias("e"))
    field = lambda name: F.regexp_extract("e", rf"(?m)^{name} (.*)$", 1)
    return whole.select(
        "file", F.regexp_extract("e", r"^[0-9a-f]{40} [0-9]+ ([0-9]+)", 1).cast("long").alias("line"), F.substring("e", 1, 40).alias("commit_id"), field("author").alias("author"), F.timestamp_seconds(field("author-time").cast("long")).alias("ts")
    )


def changed_files(seen: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose (path, hash) was not seen before."""
    return now.join(seen.select("path", "hash").distinct(), ["path", "hash"], "left_anti")

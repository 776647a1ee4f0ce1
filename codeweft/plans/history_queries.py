"""Change-history and search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import module_of, round_half_up
from codeweft.operators import graph, graph_local, history, search
from codeweft.plans import bindings as b
from codeweft.runtime import materialise
from codeweft.sources.tables import table

QUERY = "ScopeSweeper"


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return b.commit_files(spark, folder).join(b.commits(spark, folder), "commit_id")


def _modules(spark: SparkSession, folder: str) -> DataFrame:
    return b.code_files(spark, folder).select("file_id", module_of(F.col("path"), 2).alias("module"))


def m1_churn(spark: SparkSession, folder: str) -> DataFrame:
    return history.churn(_changes(spark, folder))


def m2_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return history.hotspots(b.code_files(spark, folder), history.churn(_changes(spark, folder)))


def m3_bug_scores(spark: SparkSession, folder: str) -> DataFrame:
    changes = _changes(spark, folder)
    churned = graph.percent_position(history.churn(changes).select("file_id", "commits", "authors"), "commits", "file_id", "churn_position")
    fixes = changes.where("is_fix").groupBy("file_id").agg(F.count("*").alias("fixes"))
    edges = materialise(b.imports(spark, folder))
    ranks = graph_local.ranks(edges, iterations=20).withColumn("rank", F.round("rank", 9))
    return history.bug_scores(churned, fixes, b.code_files(spark, folder), graph.coupling(edges), graph.percent_position(ranks, "rank", "node", "rank_position"))


def m4_drift(spark: SparkSession, folder: str) -> DataFrame:
    return history.cross_module_anomalies(history.co_changes(b.commit_files(spark, folder)), _modules(spark, folder), 0.05)


def m5_shotgun(spark: SparkSession, folder: str) -> DataFrame:
    return history.shotgun(b.commit_files(spark, folder), _modules(spark, folder))


def m8_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly mean order value per customer segment as a health history."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    points = orders.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.avg("o_totalprice") / 1000).alias("value"))
    return history.trend(points, "c_mktsegment", "month", "value")


def m9_co_changes(spark: SparkSession, folder: str) -> DataFrame:
    return history.co_changes(b.commit_files(spark, folder))


def m10_sampled_history(spark: SparkSession, folder: str) -> DataFrame:
    n = _changes(spark, folder).groupBy("author", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_files"))
    return history.sampled_evenly(n, "author", "month", 10)


def m11_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return history.share_of_total(_changes(spark, folder), ["file_id"], ["author"])


def m12_changed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that overlap lines 40 to 60 or 200 to 220 of their file."""
    symbols = b.latest(spark, folder, "symbols", "file_id", "name", "line_start", "line_end").select("id", "file_id", "name", F.col("line_start").alias("lo"), F.col("line_end").alias("hi"))
    ends = F.explode(F.array(F.struct(F.lit(40).alias("from_line"), F.lit(60).alias("to_line")), F.struct(F.lit(200).alias("from_line"), F.lit(220).alias("to_line"))))
    hunks = symbols.select("file_id").distinct().select("file_id", ends.alias("h")).select("file_id", "h.*")
    return history.overlapping(symbols, hunks, "file_id").select("id", "name", "from_line")


def e1_percent_position(spark: SparkSession, folder: str) -> DataFrame:
    placed = graph.percent_position(b.code_files(spark, folder).select("file_id", "max_cyclomatic"), "max_cyclomatic", "file_id", "position")
    return placed.select("file_id", round_half_up(F.col("position"), 6).alias("position"))


def l1_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25(b.latest(spark, folder, "decisions", "title", "content"), "id", {"title": 5.0, "content": 1.0}, "cursor AND keeper")


def l2_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return search.fuzzy(b.latest(spark, folder, "symbols", "name"), "id", "name", QUERY, edits=6)


def l3_vector_top(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    probe = F.array(*[F.lit(float(i % 7 - 3)) for i in range(64)])
    return search.vector_top(vectors, "vec_id", "embedding", probe, 20)


def l4_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    lexical = search.ranked(l1_bm25(spark, folder), "score", "id", top=60).select("id", "rank")
    titles = b.latest(spark, folder, "decisions", "title").where("title is not null")
    near = search.fuzzy(titles, "id", "title", "cursor keeper", least=0.05, edits=1000)
    semantic = search.ranked(near, "similarity", "id", top=60).select("id", "rank")
    return search.fuse({"lexical": (lexical, 0.5), "semantic": (semantic, 0.5)}, "id")


def l7_identity(spark: SparkSession, folder: str) -> DataFrame:
    return search.identity_channel(b.latest(spark, folder, "symbols", "name", "fqn"), "id", "name", "fqn", "Repository")


def l8_grep(spark: SparkSession, folder: str) -> DataFrame:
    return search.grep(table(spark, folder, "documents"), "doc_id", "text", r"^## ", context=1).select("doc_id", "line_no", "line")


def l3_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest of every hundredth vector among all others."""
    vectors = table(spark, folder, "embeddings")
    return search.vector_search(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 20)


def l10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vector as a query: are the twenty nearest to it of its label?"""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    asked = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    relevant = labels.join(asked, "label").where("vec_id <> query").select("query", "vec_id")
    return search.retrieval_quality(l3_vector_search(spark, folder), relevant, "query", "vec_id", 20)


def e7_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's documents, newest first, within 20,000 characters."""
    docs = table(spark, folder, "documents").select("source", "doc_id", "created_at", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return search.greedy_budget(docs, "source", [-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("doc_id")], "n_chars", 20_000).select("source", "doc_id", "n_chars")


QUERIES = {f.__name__: f for f in (
    m1_churn, m2_hotspots, m3_bug_scores, m4_drift, m5_shotgun, m8_trends, m9_co_changes, m10_sampled_history, m11_ownership, m12_changed_symbols, e1_percent_position,
    l1_bm25, l2_fuzzy, l3_vector_top, l3_vector_search, l4_hybrid, l7_identity, l8_grep, l10_quality, e7_budget,
)}

_CHURN = """, ch AS (SELECT file_id, count(*) AS commits, count(DISTINCT author) AS authors, min(ts) AS first_seen, max(ts) AS last_seen FROM cf JOIN commits USING (commit_id) GROUP BY 1)"""
_MODULE = "mo AS (SELECT file_id, regexp_extract(path, '^[^/]+/[^/]+') AS module FROM fl)"
_PAIRS = """, kept AS (SELECT * FROM cf WHERE commit_id IN (SELECT commit_id FROM cf GROUP BY 1 HAVING count(*) <= 50)), own AS (SELECT file_id, count(*) AS n FROM kept GROUP BY 1),
  pr AS (SELECT a.file_id AS file_a, z.file_id AS file_b, count(*) AS together FROM kept a JOIN kept z ON a.commit_id = z.commit_id AND a.file_id < z.file_id GROUP BY 1, 2 HAVING count(*) >= 2),
  co AS (SELECT file_a, file_b, together, x.n AS n_a, y.n AS n_b, floor(together::DOUBLE / x.n * 1000 + 0.5) / 1000 AS confidence, floor(together::DOUBLE / (x.n + y.n - together) * 1000 + 0.5) / 1000 AS similarity
         FROM pr JOIN own x ON x.file_id = file_a JOIN own y ON y.file_id = file_b)"""
_WEEK = "floor(commits / greatest(date_diff('day', first_seen, last_seen) / 7.0, 1.0)::DOUBLE * 100 + 0.5) / 100"
_WORDS = "regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def _bm25_sql(source: str, fields: dict[str, float], terms: list[str], mark: str = "") -> str:
    """Views that score ``source`` (id and the fields); the last is called bm behind the mark."""
    tf = lambda t: " + ".join(f"{w} * len(list_filter({_WORDS.format(f=f)}, lambda t: t = '{t}'))" for f, w in fields.items())
    n_words = " + ".join(f"len({_WORDS.format(f=f)})" for f in fields)
    part = lambda i: f"ln((n - df_{i} + 0.5) / (df_{i} + 0.5) + 1) * tf_{i} * 2.2::DOUBLE / (tf_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))"
    all_ = range(len(terms))
    return f"""{mark}r AS (SELECT id, {n_words} AS length, {', '.join(f'({tf(t)})::DOUBLE AS tf_{i}' for i, t in enumerate(terms))} FROM {source}),
      {mark}s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, {', '.join(f'count(*) FILTER (tf_{i} > 0) AS df_{i}' for i in all_)} FROM {mark}r),
      {mark}bm AS (SELECT id, floor(({' + '.join(map(part, all_))}) * 1e6 + 0.5) / 1e6 AS score FROM {mark}r, {mark}s WHERE {' AND '.join(f'tf_{i} > 0' for i in all_)})"""


def _bm25() -> str:
    return f"d AS {b.latest_sql('decisions', 'title', 'content')}, " + _bm25_sql("d", {"title": 5.0, "content": 1.0}, ["cursor", "keeper"])


_SEGMENTS = "list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\-.:/]+'), lambda s: s <> '')"


def _identity(q: str) -> str:
    q = q.lower()
    return f"""CASE WHEN lower(name) = '{q}' OR lower(fqn) = '{q}' THEN 1.0 WHEN coalesce(ends_with(lower(fqn), '{q}'), false) THEN 0.9 WHEN starts_with(lower(name), '{q}') THEN 0.8
      WHEN list_contains({_SEGMENTS}, '{q}') THEN 0.7 WHEN list_contains(regexp_split_to_array(coalesce(lower(fqn), ''), '[:#./-]+'), '{q}') THEN 0.6
      WHEN len(list_filter({_SEGMENTS}, lambda s: starts_with(s, '{q}'))) > 0 THEN 0.5 WHEN contains(lower(name), '{q}') THEN 0.3 WHEN coalesce(contains(lower(fqn), '{q}'), false) THEN 0.2 ELSE 0.0 END"""


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) < 3 THEN [lower({x})] ELSE list_distinct(list_transform(range(1, CAST(length({x}) AS INTEGER) - 1), lambda i: substr(lower({x}), i, 3))) END"


def _similar(x: str, q: str) -> str:
    return f"floor(len(list_intersect({_grams(x)}, {_grams(q)}))::DOUBLE / len(list_distinct(list_concat({_grams(x)}, {_grams(q)}))) * 1e6 + 0.5) / 1e6"


_SHARE = "floor(({0}) * 1000 + 0.5) / 1000"
_UNIT = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce({0}, 0.0::DOUBLE)))"
_SIGNALS = {"churn_position": 0.2, "fixes::DOUBLE / commits": 0.2, "max_cyclomatic / 20.0::DOUBLE": 0.2, "instability": 0.15, "rank_position": 0.1, "authors / 10.0::DOUBLE": 0.15}


def _bugs_sql() -> str:
    from codeweft.plans.graph_queries import _RANK, _rank_rounds

    rounds = _rank_rounds(20).rpartition(" SELECT node,")[0]
    place = "(row_number() OVER (ORDER BY {0}, {1}) - 1)::DOUBLE / (count(*) OVER () - 1)"
    return b.with_views("commits", "cf", "fl", "im") + _CHURN + _RANK + rounds + f""", pr AS (SELECT node AS file_id, {place.format('round(rank, 9)', 'node')} AS rank_position FROM r20), cp AS (SELECT *, {place.format('commits', 'file_id')} AS churn_position FROM ch),
      fx AS (SELECT file_id, count(*) AS fixes FROM cf JOIN commits USING (commit_id) WHERE is_fix GROUP BY 1), ii AS (SELECT node AS file_id, {_SHARE.format('sum(o)::DOUBLE / count(*)')} AS instability FROM (SELECT src AS node, 1 AS o FROM im UNION ALL SELECT dst, 0 FROM im) GROUP BY 1),
      al AS (SELECT fl.file_id, {', '.join(f'{_UNIT.format(x)} AS s{i}' for i, x in enumerate(_SIGNALS))} FROM fl JOIN cp USING (file_id) LEFT JOIN fx USING (file_id) LEFT JOIN ii USING (file_id) LEFT JOIN pr USING (file_id))
      SELECT file_id, {_SHARE.format(' + '.join(f's{i} * {w}::DOUBLE' for i, w in enumerate(_SIGNALS.values())))} AS score, CAST({' + '.join(f'(s{i} > 0.5)::INT' for i in range(len(_SIGNALS)))} AS BIGINT) AS signals FROM al"""


_NEAREST = "nv AS (SELECT q.vec_id AS query, v.vec_id, floor(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id), ns AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM nv QUALIFY rank <= 20)"

ORACLES = {
    "m3_bug_scores": _bugs_sql(),
    "m8_trends": """WITH p AS (SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) / 1000 AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY month) AS f, row_number() OVER (PARTITION BY c_mktsegment ORDER BY month DESC) AS l FROM p),
      g AS (SELECT c_mktsegment, count(*) AS n_points, floor((avg(value) FILTER (l <= 3) - avg(value) FILTER (f <= 3)) * 1e4 + 0.5) / 1e4 AS delta FROM r GROUP BY 1) SELECT *, CASE WHEN delta > 0.05 THEN 'rising' WHEN delta < -0.05 THEN 'falling' ELSE 'steady' END AS direction FROM g""",
    "l3_vector_search": f"WITH {_NEAREST} SELECT query, vec_id, similarity, rank FROM ns",
    "l10_quality": f"""WITH {_NEAREST}, h AS (SELECT ns.query, ns.rank, (z.label = q.label)::INT AS hit FROM ns JOIN embeddings q ON q.vec_id = ns.query JOIN embeddings z ON z.vec_id = ns.vec_id), w AS (SELECT q.vec_id AS query, count(*) AS n FROM embeddings q JOIN embeddings z ON z.label = q.label AND z.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1),
      g AS (SELECT query, sum(hit / log2(rank + 1)) AS dcg, sum(hit) AS hits, min(rank) FILTER (hit = 1) AS first FROM h GROUP BY 1), i AS (SELECT k, sum(1.0::DOUBLE / log2(j + 1)) AS ideal FROM range(1, 21) a(k), range(1, 21) c(j) WHERE j <= k GROUP BY 1)
      SELECT g.query, CASE WHEN n IS NULL THEN 1.0 ELSE floor(dcg / ideal * 1e6 + 0.5) / 1e6 END::DOUBLE AS ndcg, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(floor(1.0::DOUBLE / first * 1e6 + 0.5) / 1e6, 0.0) END::DOUBLE AS mrr,
        CASE WHEN n IS NULL THEN 1.0 ELSE floor(hits::DOUBLE / n * 1e6 + 0.5) / 1e6 END::DOUBLE AS recall, CASE WHEN n IS NULL THEN 1.0 ELSE floor(hits / 20.0::DOUBLE * 1e6 + 0.5) / 1e6 END::DOUBLE AS precision FROM g LEFT JOIN w USING (query) LEFT JOIN i ON i.k = least(n, 20)""",
    "l7_identity": f"WITH s AS {b.latest_sql('symbols', 'name', 'fqn')}, r AS (SELECT id, {_identity('Repository')}::DOUBLE AS score FROM s) SELECT * FROM r WHERE score > 0",
    "e7_budget": """WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY created_at DESC NULLS FIRST, doc_id) AS n FROM documents), g(source, n, used, took) AS (SELECT DISTINCT source, 0::BIGINT, 0::BIGINT, false FROM d
      UNION ALL SELECT d.source, d.n, CASE WHEN g.used + d.n_chars <= 20000 THEN g.used + d.n_chars ELSE g.used END, g.used + d.n_chars <= 20000 FROM g JOIN d ON d.source = g.source AND d.n = g.n + 1) SELECT source, doc_id, n_chars FROM g JOIN d USING (source, n) WHERE took""",
    "m1_churn": b.with_views("commits", "cf") + _CHURN + f""" SELECT *, {_WEEK} AS per_week, CASE WHEN {_WEEK} <= 1 THEN 'stable' WHEN {_WEEK} <= 3 THEN 'active' ELSE 'volatile' END AS assessment FROM ch""",
    "m2_hotspots": b.with_views("commits", "cf", "fl") + _CHURN + """, h AS (SELECT file_id, floor(max_cyclomatic * ln(1 + commits) * 100 + 0.5) / 100 AS score FROM fl JOIN ch USING (file_id) WHERE max_cyclomatic >= 3)
      SELECT file_id, score, CASE WHEN score <= 3 THEN 'low' WHEN score <= 10 THEN 'medium' ELSE 'high' END AS risk FROM h WHERE score > 0""",
    "m4_drift": b.with_views("cf", "fl") + _PAIRS + f", {_MODULE} SELECT file_a, file_b, x.module AS module_a, y.module AS module_b, similarity FROM co JOIN mo x ON x.file_id = file_a JOIN mo y ON y.file_id = file_b WHERE similarity >= 0.05 AND x.module <> y.module",
    "m5_shotgun": b.with_views("cf", "fl") + f""", {_MODULE}, t AS (SELECT DISTINCT commit_id, module FROM cf JOIN mo USING (file_id)), w AS (SELECT commit_id, count(*) >= 3 AS wide FROM t GROUP BY 1)
      SELECT module, count(*) AS commits, count(*) FILTER (wide) AS wide_commits, floor(count(*) FILTER (wide)::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS ratio FROM t JOIN w USING (commit_id) GROUP BY 1""",
    "m9_co_changes": b.with_views("cf") + _PAIRS + " SELECT * FROM co",
    "m10_sampled_history": b.with_views("commits", "cf") + """, n AS (SELECT author, strftime(ts, '%Y-%m') AS month, count(*) AS n_files FROM cf JOIN commits USING (commit_id) GROUP BY 1, 2),
      i AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY month DESC) - 1 AS i, count(*) OVER (PARTITION BY author) AS c FROM n) SELECT author, month, n_files FROM i WHERE i % greatest(CAST(ceil(c / 10.0) AS BIGINT), 1) = 0""",
    "m11_ownership": b.with_views("commits", "cf") + """, n AS (SELECT file_id, author, count(*) AS n FROM cf JOIN commits USING (commit_id) GROUP BY 1, 2)
      SELECT file_id, author, n, floor(n::DOUBLE / sum(n) OVER (PARTITION BY file_id) * 1000 + 0.5) / 1000 AS share FROM n""",
    "m12_changed_symbols": f"WITH s AS {b.latest_sql('symbols', 'file_id', 'name', 'line_start', 'line_end')}, h(from_line, to_line) AS (VALUES (40, 60), (200, 220)) SELECT id, name, from_line FROM s, h WHERE file_id IS NOT NULL AND line_start <= to_line AND line_end >= from_line",
    "e1_percent_position": b.with_views("fl") + " SELECT file_id, floor((row_number() OVER (ORDER BY max_cyclomatic, file_id) - 1)::DOUBLE / (count(*) OVER () - 1) * 1e6 + 0.5) / 1e6 AS position FROM fl",
    "l1_bm25": f"WITH {_bm25()} SELECT * FROM bm",
    "l2_fuzzy": f"""WITH s AS {b.latest_sql('symbols', 'name')}, r AS (SELECT id, name, {_similar('name', "'ScopeSweeper'")} AS similarity, levenshtein(lower(name), 'scopesweeper') AS edits FROM s) SELECT * FROM r WHERE similarity >= 0.3 AND edits <= 6""",
    "l3_vector_top": """WITH q AS (SELECT list_transform(range(0, 64), lambda i: CAST(i % 7 - 3 AS DOUBLE)) AS v), r AS (SELECT vec_id, floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) * 1e6 + 0.5) / 1e6 AS similarity FROM embeddings, q)
      SELECT * FROM r ORDER BY similarity DESC, vec_id LIMIT 20""",
    "l4_hybrid": f"""WITH {_bm25()}, lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm QUALIFY rank < 60),
      tt AS {b.latest_sql('decisions', 'title')}, f AS (SELECT id, {_similar('title', "'cursor keeper'")} AS similarity FROM tt WHERE title IS NOT NULL),
      se AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS rank FROM f WHERE similarity >= 0.05 QUALIFY rank < 60)
      SELECT id, floor(sum(0.5 / (60 + rank)) * 1e8 + 0.5) / 1e8 AS score FROM (SELECT * FROM lx UNION ALL SELECT * FROM se) GROUP BY 1""",
    "l8_grep": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM l WHERE starts_with(line, '## ')""",
}

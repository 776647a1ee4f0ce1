"""Queries of questions, ranked channels and contexts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import questions
from codeweft.functions.exprs import round_half_up, token_estimate
from codeweft.operators import retrieval, search
from codeweft.plans import bindings as b
from codeweft.plans.history_queries import QUERY, _bm25_sql, _identity, _similar
from codeweft.sources.tables import table

SYMBOL_FIELDS = {"name": 4.0, "fqn": 2.0, "signature": 1.0}
ASKED = "UpdateRepository"


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with a rank in 0..1 (complexity over the largest) and no recency."""
    rows = b.latest(spark, folder, "symbols", "name", "kind", "fqn", "signature", "cyclomatic", "byte_start", "byte_end")
    most = rows.agg(F.max("cyclomatic").alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("rank", F.coalesce(F.col("cyclomatic") / F.col("_most"), F.lit(0.0))).withColumn("recency", F.lit(0.0)).drop("_most")


def l5_fused(spark: SparkSession, folder: str) -> DataFrame:
    """Four channels over the symbols, fused."""
    rows = _symbols(spark, folder)
    channels = {
        "lexical": search.bm25(rows, "id", SYMBOL_FIELDS, QUERY),
        "structural": rows.where("cyclomatic is not null").select("id", F.col("cyclomatic").alias("score")),
        "similarity": search.fuzzy(rows.where("name is not null"), "id", "name", QUERY, least=0.3, edits=20).select("id", F.col("similarity").alias("score")),
        "identity": search.identity_channel(rows, "id", "name", "fqn", QUERY),
    }
    return retrieval.fused(channels, "id", top=100)


def l6_classic(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.classic(_symbols(spark, folder), ASKED, fields=SYMBOL_FIELDS)


def l6_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A misspelt name finds nothing in the full text, but near names."""
    return retrieval.classic(_symbols(spark, folder), "UpdateRepositry", fields=SYMBOL_FIELDS)


def l14_exact(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.exact(_symbols(spark, folder), "updaterepository").select("id", "name", "kind")


def l12_completed(spark: SparkSession, folder: str) -> DataFrame:
    """Found symbols and what stands next to them in the tree."""
    links = b.latest(spark, folder, "symbols", "parent_id").where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    return retrieval.complete(l6_classic(spark, folder), links, "id")


def l15_context(spark: SparkSession, folder: str) -> DataFrame:
    """The best symbols of the fused ranking within 2,000 tokens of source."""
    rows = _symbols(spark, folder).select("id", F.greatest(F.ceil(F.coalesce(F.col("byte_end") - F.col("byte_start"), F.lit(0)) / 3.5), F.lit(1)).cast("long").alias("tokens"))
    return retrieval.context(l5_fused(spark, folder).join(rows, "id"), "id", "score", "tokens", 2_000, top=200).select("id", "tokens")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """What searches and commands say, one row a call."""
    calls = b.latest(spark, folder, "tool_calls", "tool_short_name", "input_snippet").where("input_snippet is not null")
    return calls.select("id", F.when(F.col("tool_short_name") == "search", F.get_json_object("input_snippet", "$.query")).otherwise(F.col("input_snippet")).alias("q")).where("q is not null")


def h33_intents(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).groupBy(questions.intent_of(F.col("q")).alias("intent")).agg(F.count("*").alias("n"))


def h34_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected as statements of a database: searches, commands, and notes."""
    notes = b.latest(spark, folder, "decisions", "content").select(F.col("id").cast("string").alias("id"), F.col("content").alias("q")).where("q is not null")
    return _asked(spark, folder).unionByName(notes).where(questions.is_sql(F.col("q"))).select("id")


def l13_modes(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).groupBy(questions.mode_of(F.col("q")).alias("mode")).agg(F.count("*").alias("n"))


def h35_worth(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.latest(spark, folder, "symbols", "kind")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.max(questions.kind_worth(F.col("kind"))).alias("worth"))


def f6_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """The calls with the largest outputs of each session, in tiers of 3, 7 and 15."""
    calls = b.latest(spark, folder, "tool_calls", "session_id", "output_tokens_estimate").where("session_id <> '' and output_tokens_estimate is not null")
    return retrieval.tiers(calls, "session_id", "output_tokens_estimate", "id").select("session_id", "id", "tier", "place")


def f9_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Two hundred documents drawn by a seeded hash of their ids."""
    return search.seeded_sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 200, seed="42")


def l8_context(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with the line before and after."""
    return search.grep(table(spark, folder, "documents"), "doc_id", "text", r"^## ", context=1)


def l9_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """How sure the fused ranking of each asked name is of its first answer."""
    from codeweft.operators import code

    rows = _symbols(spark, folder)
    results = [retrieval.classic(rows, q, fields=SYMBOL_FIELDS).withColumn("query", F.lit(q)) for q in (ASKED, QUERY)]
    both = results[0].unionByName(results[1])
    return code.retrieval_confidence(both, "query", "score", F.lit(0.0), F.lit(0.0))


def l19_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols per kind without a vector, or loaded again since it was made."""
    symbols = table(spark, folder, "symbols").groupBy("id").agg(F.max("loaded_at").alias("loaded_at"), F.max("kind").alias("kind"))
    made = table(spark, folder, "symbol_embeddings").where("embedding is not null").groupBy(F.col("symbol_id").alias("id")).agg(F.max("loaded_at").alias("made_at"))
    rows = symbols.join(made, "id", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("made_at").isNull()).alias("missing"), F.count_if(F.col("made_at") < F.col("loaded_at")).alias("stale"))


def h10_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy(F.lower("lang").alias("lang")).agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))


def i14_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as first and as last loaded: how far they moved."""
    sound = (F.size("embedding") == 96) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = table(spark, folder, "symbol_embeddings").where("symbol_id is not null").where(sound).select("symbol_id", "loaded_at", "embedding")
    ends = rows.groupBy("symbol_id").agg(F.min(F.struct("loaded_at", "embedding"))["embedding"].alias("pinned"), F.max(F.struct("loaded_at", "embedding"))["embedding"].alias("now"))
    return search.vector_drift(ends, "pinned", "now")


QUERIES = {f.__name__: f for f in (
    l5_fused, l6_classic, l6_fallback, l14_exact, l12_completed, l15_context, h33_intents, h34_statements, l13_modes, h35_worth, f6_tiers, f9_sample, l8_context, l9_confidence, l19_backlog,
    h10_by_lang, i14_drift,
)}

_S = f"sy AS (SELECT *, coalesce(cyclomatic::DOUBLE / (max(cyclomatic) OVER ()), 0) AS rank FROM {b.latest_sql('symbols', 'name', 'kind', 'fqn', 'signature', 'cyclomatic', 'byte_start', 'byte_end')})"
_R6 = "floor(({0}) * 1e6 + 0.5) / 1e6"


def _worth() -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in questions.KIND_WORTH.items()) + " ELSE 0.1 END"


def _ranks(name: str, score: str, source: str, weight: float, where: str) -> str:
    return f"{name} AS (SELECT id, {weight} AS w, row_number() OVER (ORDER BY {score} DESC, id) - 1 AS r FROM {source} WHERE {where} QUALIFY r < 100)"


def _fused_sql() -> str:
    return f"""{_S}, {_bm25_sql('sy', SYMBOL_FIELDS, [QUERY.lower()], 'b_')}, {_ranks('c1', 'score', 'b_bm', 0.4, 'true')}, {_ranks('c2', 'cyclomatic', 'sy', 0.25, 'cyclomatic IS NOT NULL')},
      sm AS (SELECT id, {_similar('name', repr(QUERY))} AS s FROM sy WHERE name IS NOT NULL AND levenshtein(lower(name), '{QUERY.lower()}') <= 20), {_ranks('c3', 's', 'sm', 0.2, 's >= 0.3')},
      idn AS (SELECT id, {_identity(QUERY)} AS s FROM sy), {_ranks('c4', 's', 'idn', 0.15, 's > 0')}, al AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4),
      tw AS (SELECT sum(w) AS t FROM (SELECT DISTINCT w FROM al)), fu AS (SELECT id, floor(sum(w::DOUBLE / (60 + r)) / (SELECT t::DOUBLE FROM tw) * 1e8 + 0.5) / 1e8 AS score FROM al GROUP BY 1)"""


def _classic_sql(q: str, found: str) -> str:
    near = f"SELECT id, {_similar('name', repr(q))} AS rel FROM sy WHERE levenshtein(lower(name), '{q.lower()}') <= 3 AND {_similar('name', repr(q))} >= 0.2"
    text = "SELECT id, CASE WHEN (max(score) OVER ()) > (min(score) OVER ()) THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS rel FROM b_bm"
    rel = text if found == "text" else near
    score = "CASE WHEN i > 0 THEN 0.4::DOUBLE * i + 0.3::DOUBLE * rel + 0.15::DOUBLE * rank + 0.05::DOUBLE * w ELSE 0.5::DOUBLE * rel + 0.25::DOUBLE * rank + 0.1::DOUBLE * w END"
    return f"{_S}, {_bm25_sql('sy', SYMBOL_FIELDS, [q.lower()], 'b_')}, rl AS ({rel}), sg AS (SELECT id, rel, rank, {_identity(q)}::DOUBLE AS i, {_worth()}::DOUBLE AS w FROM sy JOIN rl USING (id)), cl AS (SELECT id, {_R6.format(score)} AS score, '{found}' AS found_by FROM sg)"


_ASKED = f"aq AS (SELECT id, CASE WHEN tool_short_name = 'search' THEN json_extract_string(input_snippet, '$.query') ELSE input_snippet END AS q FROM {b.latest_sql('tool_calls', 'tool_short_name', 'input_snippet')} WHERE input_snippet IS NOT NULL), qs AS (SELECT * FROM aq WHERE q IS NOT NULL)"
_TELLING = "len(list_filter(regexp_split_to_array(regexp_replace(q, '[?!.,;:''\"]', '', 'g'), '\\s+'), lambda w: length(w) > 2 AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in questions.SMALL_WORDS) + ")))"
_IS_SQL = f"(regexp_matches(q, '{questions.SURE_SQL}', 'i') OR (" + " + ".join(f"regexp_matches(q, '\\b{w}\\b', 'i')::INT" for w in questions.SQL_WORDS) + f") >= 2 AND NOT regexp_matches(q, '{questions.GRAPH_WORDS}', 'i'))"

def _confidence_sql(*asked: str) -> str:
    """The two best scores of each asked name: those of the full text, or of near names where it finds nothing."""
    found = []
    for q in asked:
        text, near = (f"(WITH {_classic_sql(q, way)} SELECT score FROM cl)" for way in ("text", "near"))
        found.append(f"SELECT '{q}' AS query, score FROM {text} UNION ALL SELECT '{q}', score FROM {near} WHERE (SELECT count(*) FROM {text}) = 0")
    return f"""WITH r AS ({' UNION ALL '.join(found)}), o AS (SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY score DESC) AS n FROM r), g AS (SELECT query, max(score) FILTER (n = 1) AS a, max(score) FILTER (n = 2) AS z FROM o GROUP BY 1),
      v AS (SELECT query, floor((least(1.0::DOUBLE, a) * 0.4::DOUBLE + CASE WHEN a > 0 THEN (a - coalesce(z, 0)) / a ELSE 0 END * 0.25::DOUBLE) * 1e4 + 0.5) / 1e4 AS confidence FROM g) SELECT *, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM v"""


ORACLES = {
    "l9_confidence": _confidence_sql(ASKED, QUERY),
    "l5_fused": f"WITH {_fused_sql()} SELECT * FROM fu",
    "l6_classic": f"WITH {_classic_sql(ASKED, 'text')} SELECT * FROM cl",
    "l6_fallback": f"WITH {_classic_sql('UpdateRepositry', 'near')} SELECT * FROM cl",
    "l14_exact": f"WITH {_S} SELECT id, name, kind FROM sy WHERE lower(name) = 'updaterepository' OR lower(fqn) = 'updaterepository'",
    "l12_completed": f"""WITH {_classic_sql(ASKED, 'text')}, e AS (SELECT id AS a, parent_id AS z FROM {b.latest_sql('symbols', 'parent_id')} WHERE parent_id IS NOT NULL), u AS (SELECT a, z FROM e UNION ALL SELECT z, a FROM e)
      SELECT id, floor(max(score) * 1e6 + 0.5) / 1e6 AS score FROM (SELECT id, score FROM cl UNION ALL SELECT u.z, cl.score * 0.5 FROM cl JOIN u ON u.a = cl.id) GROUP BY 1""",
    "l15_context": f"""WITH RECURSIVE {_fused_sql()}, tk AS (SELECT fu.id, greatest(ceil(coalesce(byte_end - byte_start, 0) / 3.5::DOUBLE), 1)::BIGINT AS tokens, row_number() OVER (ORDER BY fu.score DESC, fu.id) AS n FROM fu JOIN sy USING (id)),
      g(n, used, took) AS (SELECT 0, 0::BIGINT, false UNION ALL SELECT tk.n, CASE WHEN g.used + tk.tokens <= 2000 THEN g.used + tk.tokens ELSE g.used END, g.used + tk.tokens <= 2000 FROM g JOIN tk ON tk.n = g.n + 1 WHERE tk.n <= 200)
      SELECT id, tokens FROM g JOIN tk USING (n) WHERE took""",
    "h33_intents": f"WITH {_ASKED} SELECT CASE " + " ".join("WHEN regexp_matches(q, '{}', 'i') THEN '{}'".format(s.replace("'", "''"), n) for n, s in questions.INTENTS) + f" WHEN {_TELLING} >= 2 THEN 'path' ELSE 'flow' END AS intent, count(*) AS n FROM qs GROUP BY 1",
    "h34_statements": f"WITH {_ASKED}, al AS (SELECT id, q FROM qs UNION ALL SELECT CAST(id AS VARCHAR), content FROM {b.latest_sql('decisions', 'content')} WHERE content IS NOT NULL) SELECT id FROM al WHERE {_IS_SQL}",
    "l13_modes": f"WITH {_ASKED} SELECT CASE WHEN regexp_matches(q, '{questions.PATH_SHAPE}') THEN 'get' ELSE 'single' END AS mode, count(*) AS n FROM qs GROUP BY 1",
    "h35_worth": f"SELECT kind, count(*) AS n, max({_worth()})::DOUBLE AS worth FROM {b.latest_sql('symbols', 'kind')} GROUP BY 1",
    "f6_tiers": f"WITH c AS {b.latest_sql('tool_calls', 'session_id', 'output_tokens_estimate')}, r AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY output_tokens_estimate DESC, id) AS place FROM c WHERE session_id <> '' AND output_tokens_estimate IS NOT NULL) SELECT session_id, id, CASE WHEN place <= 3 THEN 'high' WHEN place <= 10 THEN 'medium' ELSE 'low' END AS tier, place FROM r WHERE place <= 25",
    "f9_sample": "SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 200",
    "l8_context": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(i AS BIGINT) AS line_no, a[i] AS line, CASE WHEN i > 1 THEN a[i - 1] ELSE '' END AS before, CASE WHEN i < len(a) THEN a[i + 1] ELSE '' END AS after FROM l WHERE starts_with(a[i], '## ')""",
    "l19_backlog": """WITH s AS (SELECT id, max(loaded_at) AS l, max(kind) AS kind FROM symbols GROUP BY 1), m AS (SELECT symbol_id AS id, max(loaded_at) AS made FROM symbol_embeddings WHERE embedding IS NOT NULL GROUP BY 1)
      SELECT kind, count(*) AS n, count(*) FILTER (made IS NULL) AS missing, count(*) FILTER (made < l) AS stale FROM s LEFT JOIN m USING (id) GROUP BY 1""",
    "h10_by_lang": "SELECT lower(lang) AS lang, CAST(sum(CAST(ceil(length(text)::DOUBLE / 4 * 1.15::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "i14_drift": """WITH s AS (SELECT symbol_id, loaded_at, embedding FROM symbol_embeddings WHERE symbol_id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      e AS (SELECT symbol_id, first(embedding ORDER BY loaded_at, embedding) AS a, first(embedding ORDER BY loaded_at DESC, embedding DESC) AS z FROM s GROUP BY 1), c AS (SELECT floor(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(z AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS s FROM e)
      SELECT count(*) AS n, floor(avg(s) * 1e4 + 0.5) / 1e4 AS mean, min(s) AS least, count(*) FILTER (s < 0.99) AS drifted FROM c""",
}

"""Queries of the language-model data problems, over the tables as they stand, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import bpe, near_duplicates, neighbours, packing, personal_data, source_files, text_quality
from codeweft.sources.tables import table

CONTAINER = 2048


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest(table(spark, folder, "symbol_embeddings"), "symbol_id", "embedding", length=96, k=5, floor=0.8)
    pair = F.least("symbol_id", "neighbour").alias("symbol_a"), F.greatest("symbol_id", "neighbour").alias("symbol_b")
    return near.select(*pair).distinct()


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The free texts of both tables, one row per record; reloads of a record repeat its text."""

    def records(name: str, column: str) -> DataFrame:
        rows = table(spark, folder, name).where(F.col(column) != "").groupBy(F.col("id").cast("string").alias("record_key"))
        return rows.agg(F.min(column).alias("text")).select(F.lit(name).alias("record_table"), "record_key", "text")

    return records("decisions", "content").unionByName(records("tool_calls", "input_snippet"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = personal_data.find_personal_data(_texts(spark, folder), table(spark, folder, "name_parts"))
    return spans.select("record_table", "record_key", "pii_type", "pii_value").distinct()


def p3_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return personal_data.sanitise(texts, personal_data.find_personal_data(texts, table(spark, folder, "name_parts")))


def _near_decisions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    decisions = table(spark, folder, "decisions").select("id", "title", "content")
    return decisions, *near_duplicates.near_duplicates(decisions, "id", "title", "content", shingle=3, threshold=0.5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    decisions, members, links = _near_decisions(spark, folder)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    shingled = F.size(near_duplicates.words_of(text)) >= 3
    pairs = near_duplicates.pairs_of_records(decisions, "id", members, links, shingled)
    return pairs.select(F.col("record_a").alias("decision_a"), F.col("record_b").alias("decision_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    _, members, links = _near_decisions(spark, folder)
    return near_duplicates.groups_of_records("id", members, links)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return source_files.judge_files(table(spark, folder, "files")).where("not_written").select("file_id")


def p6_validation(spark: SparkSession, folder: str) -> DataFrame:
    return source_files.validate_by_repository(table(spark, folder, "files"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = bpe.count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER)


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.text_quality(table(spark, folder, "documents"), table(spark, folder, "common_words"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_statistics(spark, folder).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_sanitised": p3_sanitised, "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p6_validation": p6_validation, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_statistics": p9_statistics}
_CLASSES = """WITH d AS (SELECT id, min(coalesce(title, '') || ' ' || coalesce(content, '')) AS t FROM decisions WHERE id IS NOT NULL GROUP BY 1), w AS (SELECT id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM d),
  s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3), x AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
  p AS (SELECT a.id AS decision_a, b.id AS decision_b FROM x a JOIN x b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*))"""

_GROUPS = _CLASSES.replace("WITH d", "WITH RECURSIVE d", 1).replace("s AS (SELECT id,", "cl AS (SELECT w, min(id) AS class_id FROM w GROUP BY 1), m AS (SELECT w.id, cl.class_id FROM w JOIN cl ON cl.w = w.w), s AS (SELECT id,", 1).replace("len(w) >= 3)", "len(w) >= 3 AND id IN (SELECT class_id FROM cl))", 1)

#: Exact answers where SQL finds them on whole tables.
ORACLES: dict[str, str] = {
    "p2_found": """WITH v AS (SELECT symbol_id AS s, min(CAST(embedding AS DOUBLE[])) AS e FROM symbol_embeddings WHERE symbol_id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
      p AS (SELECT a.s AS a, b.s AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.s <> b.s), k AS (SELECT a, b FROM p WHERE sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5)
      SELECT DISTINCT least(a, b) AS symbol_a, greatest(a, b) AS symbol_b FROM k""",
    "p4_found": f"{_CLASSES} SELECT decision_a, decision_b FROM p",
    "p4_groups": f"""{_GROUPS}, u AS (SELECT decision_a AS a, decision_b AS b FROM p UNION ALL SELECT decision_b, decision_a FROM p), n AS (SELECT a AS class_id, count(*) AS n_links FROM u GROUP BY 1), h(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, h.root FROM h JOIN u ON u.a = h.node WHERE h.root < u.b),
      g AS (SELECT node AS class_id, min(root) AS group_id FROM h GROUP BY 1) SELECT m.id, m.class_id, coalesce(n_links, 0) AS n_links, coalesce(group_id, m.class_id) AS group_id FROM m LEFT JOIN n USING (class_id) LEFT JOIN g USING (class_id)""",
}

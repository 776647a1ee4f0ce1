"""Queries of the general training-data problems, over the tables as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.packed_fields import split_packed
from codeweft.operators.references import ForeignKey, orphan_cascade
from codeweft.sources.tables import table

REFERENCES = [
    ForeignKey("tool_calls", "session_id", "sessions", "id"),
    ForeignKey("symbol_embeddings", "symbol_id", "symbols", "id", key="symbol_id"),
    ForeignKey("api_endpoints", "contract_id", "api_contracts", "id"),
    ForeignKey("decisions", "symbol_id", "symbols", "symbol_id"),
]
#: Further edges of the foreign-key graph, along which orphans are inherited.
STRUCTURE = [
    ForeignKey("symbols", "file_id", "files", "id"),
    ForeignKey("symbols", "parent_id", "symbols", "id"),
]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_packed(table(spark, folder, "decisions"), "id", "tags", key_as="decision_id", pos_as="tag_pos", value_as="tag")


def _cascade(spark: SparkSession, folder: str) -> DataFrame:
    keys = REFERENCES + STRUCTURE
    tables = {n: table(spark, folder, n) for n in {fk.table for fk in keys} | {fk.target for fk in keys}}
    return orphan_cascade(tables, keys, table(spark, folder, "deleted_records"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.struct("ref_table", "ref_column").isin([F.struct(F.lit(fk.table), F.lit(fk.column)) for fk in REFERENCES])
    rows = _cascade(spark, folder).where((F.col("origin") == "direct") & asked)
    return rows.select("ref_table", "ref_column", "record_key", "target_key", "reason", "ref_month")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of direct and inherited orphans per table, column, reason and month."""
    rows = _cascade(spark, folder)
    return rows.groupBy("ref_table", "ref_column", "origin", "reason", "ref_month").agg(F.count("*").alias("n_refs"), F.countDistinct("target_key").alias("n_targets"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_report": p5_report}


def _sql_direct(fk: ForeignKey) -> str:
    return f"""
    SELECT '{fk.table}' AS ref_table, '{fk.column}' AS ref_column, r.record_key, r.target_key,
           CASE WHEN t.k IS NULL THEN CASE WHEN d.record_key IS NULL THEN 'missing' ELSE 'deleted' END ELSE 'late' END AS reason,
           strftime(r.record_at, '%Y-%m') AS ref_month
    FROM (SELECT CAST({fk.key} AS VARCHAR) AS record_key, CAST({fk.column} AS VARCHAR) AS target_key, min(loaded_at) AS record_at
          FROM {fk.table} WHERE {fk.column} IS NOT NULL AND CAST({fk.column} AS VARCHAR) <> '' GROUP BY 1, 2) r
    LEFT JOIN (SELECT CAST({fk.field} AS VARCHAR) AS k, min(loaded_at) AS target_at FROM {fk.target} GROUP BY 1) t ON t.k = r.target_key
    LEFT JOIN (SELECT DISTINCT record_key FROM deleted_records WHERE table_name = '{fk.target}' AND key_field = '{fk.field}') d ON d.record_key = r.target_key
    WHERE t.k IS NULL OR t.target_at > r.record_at"""


def _sql_resolved(fk: ForeignKey) -> str:
    """Every reference of a foreign key with its target's record, one row a record."""
    ref, key = f"CAST({fk.column} AS VARCHAR)", f"CAST({fk.key} AS VARCHAR)"
    return f"""
    SELECT '{fk.table}' AS ref_table, '{fk.column}' AS ref_column, r.record_key, r.target_key, r.record_at, '{fk.target}' AS target_table, t.target_record, t.target_at, d.record_key IS NOT NULL AS gone
    FROM (SELECT {key} AS record_key, first({ref} ORDER BY loaded_at NULLS LAST, {fk.column}) FILTER ({ref} <> '') AS target_key, min(loaded_at) AS record_at FROM {fk.table} GROUP BY 1) r
    LEFT JOIN (SELECT CAST({fk.field} AS VARCHAR) AS k, min(CAST({fk.target_key} AS VARCHAR)) AS target_record, min(loaded_at) AS target_at FROM {fk.target} WHERE {fk.field} IS NOT NULL GROUP BY 1) t ON t.k = r.target_key
    LEFT JOIN (SELECT DISTINCT record_key FROM deleted_records WHERE table_name = '{fk.target}' AND key_field = '{fk.field}') d ON d.record_key = r.target_key
    WHERE r.target_key IS NOT NULL"""


_REPORT = f"""WITH RECURSIVE refs AS ({" UNION ALL ".join(map(_sql_resolved, REFERENCES + STRUCTURE))}),
  lost(t, k) AS (SELECT ref_table, record_key FROM refs WHERE target_record IS NULL UNION SELECT e.ref_table, e.record_key FROM lost JOIN refs e ON e.target_table = lost.t AND e.target_record = lost.k),
  told AS (SELECT *, 'direct' AS origin, CASE WHEN target_record IS NULL THEN CASE WHEN gone THEN 'deleted' ELSE 'missing' END ELSE 'late' END AS reason FROM refs WHERE target_record IS NULL OR target_at > record_at
    UNION ALL SELECT *, 'inherited', 'orphaned' FROM refs e WHERE EXISTS (SELECT 1 FROM lost WHERE lost.t = e.target_table AND lost.k = e.target_record))
  SELECT ref_table, ref_column, origin, reason, strftime(record_at, '%Y-%m') AS ref_month, count(*) AS n_refs, count(DISTINCT target_key) AS n_targets FROM told GROUP BY 1, 2, 3, 4, 5"""

ORACLES = {"p5_found": " UNION ALL ".join(map(_sql_direct, REFERENCES)), "p5_report": _REPORT}

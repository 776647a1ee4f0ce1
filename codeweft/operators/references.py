"""References to records that do not exist: direct orphans and the fixpoint cascade below them.

All foreign keys are resolved once into a table of references (record, target, times). Rows
without a target are *direct* orphans. Children of orphaned records are *inherited* orphans,
found by iterating semi-joins from the newly orphaned records down the foreign-key graph until
no record is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import materialise


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``target.field``; ``key`` and ``target_key`` identify the records."""

    table: str
    column: str
    target: str
    field: str
    key: str = "id"
    target_key: str = "id"


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _first_of_records(df: DataFrame, fk: ForeignKey, at: str) -> DataFrame:
    """One row per record: its reference and when it was first loaded, over all its versions."""
    ref = F.when(_text(fk.column) != "", F.col(fk.column))
    rows = df.select(F.col(fk.key).alias("_id"), ref.alias("_ref"), F.col(at).alias("_at"))
    if fk.key == fk.column:
        return rows.where(F.col("_ref").isNotNull()).groupBy("_id").agg(F.min("_ref").alias("_ref"), F.min("_at").alias("_at"))
    version = F.when(F.col("_ref").isNotNull(), F.struct(F.col("_at").isNull(), "_at", "_ref"))
    grouped = rows.groupBy("_id").agg(F.min("_at").alias("_at"), F.min(version).alias("_v"))
    return grouped.select("_id", F.col("_v._ref").alias("_ref"), "_at").where(F.col("_ref").isNotNull())


def _resolve(tables: dict[str, DataFrame], fk: ForeignKey, deleted: DataFrame, at: str) -> DataFrame:
    refs = _first_of_records(tables[fk.table], fk, at)
    parent = tables[fk.target].where(F.col(fk.field).isNotNull())
    parent = parent.groupBy(F.col(fk.field).alias("_ref")).agg(F.min(at).alias("_target_at"), F.min(_text(fk.target_key)).alias("_target"))
    gone = deleted.where((F.col("table_name") == fk.target) & (F.col("key_field") == fk.field))
    gone = gone.select(F.col("record_key").alias("target_key"), F.lit(True).alias("_gone")).distinct()
    joined = refs.join(parent, "_ref", "left").select(
        F.lit(fk.table).alias("ref_table"),
        F.lit(fk.column).alias("ref_column"),
        _text("_id").alias("record_key"),
        _text("_ref").alias("target_key"),
        F.col("_at").alias("record_at"),
        F.lit(fk.target).alias("target_table"),
        F.col("_target").alias("target_record"),
        F.col("_target_at").alias("target_at"),
    )
    # Only references without a target need the deletions, so most rows never reach this join.
    found = joined.where(F.col("target_record").isNotNull()).withColumn("_gone", F.lit(False))
    lost = joined.where(F.col("target_record").isNull()).join(gone, "target_key", "left")
    return found.unionByName(lost)


def resolve_references(tables: dict[str, DataFrame], keys: list[ForeignKey], deleted: DataFrame, at: str = "loaded_at") -> DataFrame:
    """Every non-empty reference with its target's record and the reason why it dangles, if it does.

    ``reason``: ``deleted`` (no target, listed as deleted), ``missing`` (no target, not listed),
    ``late`` (the target was first loaded after the record), else null.
    """
    rows = reduce(DataFrame.unionByName, (_resolve(tables, fk, deleted, at) for fk in keys))
    reason = (
        F.when(F.col("target_record").isNull(), F.when(F.coalesce("_gone", F.lit(False)), "deleted").otherwise("missing"))
        .when(F.col("target_at") > F.col("record_at"), "late")
    )
    return rows.withColumn("reason", reason).drop("_gone")


def orphan_cascade(
    tables: dict[str, DataFrame], keys: list[ForeignKey], deleted: DataFrame, at: str = "loaded_at", max_depth: int | None = None
) -> DataFrame:
    """Dangling references, direct and inherited, per referring record.

    Columns: ref_table, ref_column, record_key, target_key, reason, ref_month, origin
    (``direct``/``inherited``) and depth (0 for direct). An inherited row is a reference to a
    record that exists but hangs, at any distance, below a missing or deleted one; its reason is
    ``orphaned``. Late targets orphan nothing.

    Defined cases: null and empty references are none; exact repeats and reloads of a record
    count once, at their first load; a null load time is never late and has a null month; cycles
    end, since a record is orphaned once; extra columns are ignored; empty tables give no rows.
    A hot target is one row on the target's side, so AQE may split its partition of the records.
    """
    references = materialise(resolve_references(tables, keys, deleted, at))
    month = F.date_format("record_at", "yyyy-MM")
    columns = ["ref_table", "ref_column", "record_key", "target_key", "reason", month.alias("ref_month")]
    direct = references.where(F.col("reason").isNotNull()).select(*columns, F.lit("direct").alias("origin"), F.lit(0).alias("depth"))

    edges = references.where(F.col("target_record").isNotNull())
    record = ["ref_table", "record_key"]
    frontier = materialise(references.where(F.col("target_record").isNull()).select(*record).distinct())
    orphaned, inherited, depth = frontier, [], 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        parent = frontier.select(F.col("ref_table").alias("target_table"), F.col("record_key").alias("target_record"))
        below = materialise(edges.join(parent, ["target_table", "target_record"], "left_semi"))
        inherited.append(below.select(*columns[:4], F.lit("orphaned").alias("reason"), columns[5], F.lit("inherited").alias("origin"), F.lit(depth).alias("depth")))
        frontier = materialise(below.select(*record).distinct().join(orphaned, record, "left_anti"))
        orphaned = orphaned.unionByName(frontier)
    return reduce(DataFrame.unionByName, inherited, direct)

"""Packages, dependents and bills of materials; differences of schemas and contracts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import round_half_up


def dependents(uses: DataFrame, package: str, project: str) -> DataFrame:
    """(package, projects, uses): how many projects depend on each package."""
    return uses.groupBy(package).agg(F.countDistinct(project).alias("projects"), F.count("*").alias("uses"))


def batch_impact(uses: DataFrame, changed: DataFrame, package: str, project: str) -> DataFrame:
    """(project, packages): projects that a change of several packages reaches, and by how many of them."""
    return uses.select(package, project).distinct().join(changed.select(package).distinct(), package, "left_semi").groupBy(project).agg(F.count("*").alias("packages"))


def bill_of_materials(uses: DataFrame, project: str, package: str, version: str, at: str) -> DataFrame:
    """The last version of each package in each project, and how many versions it had (ties: the larger version)."""
    g = uses.groupBy(project, package).agg(F.max(F.struct(F.col(at).alias("a"), F.col(version).alias("v")))["v"].alias(version), F.countDistinct(version).alias("versions"))
    return g.select(project, package, version, "versions")


def project_graph(links: DataFrame, source: str, target: str) -> DataFrame:
    """Weighted edges between projects, and each edge's share of what leaves its source."""
    n = links.where(F.col(source) != F.col(target)).groupBy(source, target).agg(F.count("*").alias("n"))
    return n.withColumn("share", round_half_up(F.col("n") / F.sum("n").over(Window.partitionBy(source)), 4))


def _fields(schema: object, place: str = "") -> Iterator[tuple[str, str, bool]]:
    """(path, type, required) of all fields of a JSON schema, nested objects and array items included."""
    if not isinstance(schema, dict):
        return
    required = schema.get("required") if isinstance(schema.get("required"), list) else []
    properties = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    for name, field in properties.items():
        kind = field.get("type", "unknown") if isinstance(field, dict) else "unknown"
        path = f"{place}.{name}" if place else name
        yield path, kind if isinstance(kind, str) else json.dumps(kind), name in required
        if kind == "object":
            yield from _fields(field, path)
        elif kind == "array":
            yield from _fields(field.get("items"), f"{path}[]")


def schema_fields(schemas: DataFrame, key: str, schema: str) -> DataFrame:
    """(key, path, type, required) of JSON schemas; null and broken ones have no fields."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["_k"], pdf["_s"], strict=True):
                try:
                    out += [(k, *f) for f in _fields(json.loads(text))]
                except (ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["key", "path", "type", "required"])

    rows = schemas.where(F.col(schema).isNotNull()).select(F.col(key).alias("_k"), F.col(schema).alias("_s"))
    return rows.mapInPandas(read, f"key {schemas.schema[key].dataType.simpleString()}, path string, type string, required boolean").withColumnRenamed("key", key)


def schema_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, path, old_value, new_value, breaking, confidence) between fields of ``schema_fields``.

    A removed and an added field of one place and type whose names differ by less than 0.6 of the
    longer one's length are a rename; each takes the nearest free partner, mutual first choices
    only. Fields below a removed or added field are not listed again.
    """
    a = old.select(key, "path", F.col("type").alias("_ta"), F.col("required").alias("_ra"))
    z = new.select(key, "path", F.col("type").alias("_tz"), F.col("required").alias("_rz"))
    both = a.join(z, [key, "path"], "full")
    place, name = F.regexp_extract("path", r"^(.*?)\.?[^.]*$", 1), F.regexp_extract("path", r"([^.]*)$", 1)
    gone = both.where("_tz is null").select(key, F.col("path").alias("_pa"), place.alias("_at"), name.alias("_na"), F.col("_ta").alias("_t"))
    came = both.where("_ta is null").select(key, F.col("path").alias("_pz"), place.alias("_at"), name.alias("_nz"), F.col("_tz").alias("_t"))
    longest = F.greatest(F.length("_na"), F.length("_nz"))
    near = gone.join(came, [key, "_at", "_t"]).withColumn("_d", F.levenshtein("_na", "_nz")).where(F.col("_d") < longest * 0.6).withColumn("_c", round_half_up(1 - F.col("_d") / longest, 2))
    of_a, of_z = Window.partitionBy(key, "_pa").orderBy("_d", "_pz"), Window.partitionBy(key, "_pz").orderBy("_d", "_pa")
    renames = near.withColumn("_i", F.row_number().over(of_a)).withColumn("_j", F.row_number().over(of_z)).where("_i = 1 and _j = 1").select(key, "_pa", "_pz", "_c")
    renamed = renames.select(key, F.lit("renamed").alias("change"), F.col("_pa").alias("path"), F.col("_pa").alias("old_value"), F.col("_pz").alias("new_value"), F.lit(True).alias("breaking"), F.col("_c").alias("confidence"))
    known = renames.select(key, F.explode(F.array("_pa", "_pz")).alias("path"))
    rest = both.join(known, [key, "path"], "left_anti")
    change = F.when(F.col("_tz").isNull(), "field_removed").when(F.col("_ta").isNull() & F.col("_rz"), "required_added").when(F.col("_ta").isNull(), "field_added").when(F.col("_ta") != F.col("_tz"), "type_changed").when(~F.col("_ra") & F.col("_rz"), "required_added")
    told = rest.withColumn("change", change).where("change is not null").select(key, "change", "path", F.col("_ta").alias("old_value"), F.col("_tz").alias("new_value"), (F.col("change") != "field_added").alias("breaking"), F.lit(1.0).alias("confidence"))
    # A field below one that came, went or was renamed as a whole says nothing of its own.
    whole = told.where(F.col("change").isin("field_removed", "field_added") | (F.col("change") == "required_added") & F.col("old_value").isNull()).select(key, F.col("path").alias("_top")).unionByName(known.withColumnRenamed("path", "_top"))
    above = F.transform(F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: (F.col("path").substr(i, F.lit(1)) == ".") | (F.col("path").substr(i, F.lit(1)) == "[")), lambda i: F.col("path").substr(F.lit(1), i - 1))
    below = told.select(key, "path", F.explode(above).alias("_top")).join(whole, [key, "_top"], "left_semi").select(key, "path").distinct()
    return told.join(below, [key, "path"], "left_anti").unionByName(renamed)

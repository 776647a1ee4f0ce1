"""Class hierarchies: overriding methods, implementations, and graphs that respect both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import materialise


def closure(heritage: DataFrame, max_depth: int = 10) -> DataFrame:
    """(sub, sup, depth): every class with all classes above it, at its least distance; cycles end.

    Classes are a few steps deep, so a round joins only the pairs that are new.
    """
    direct = materialise(heritage.where("sub is not null and sup is not null and sub <> sup").select("sub", "sup").distinct())
    known = direct.withColumn("depth", F.lit(1))
    frontier = known
    for depth in range(2, max_depth + 1):
        step = frontier.select("sub", F.col("sup").alias("_via")).join(direct.select(F.col("sub").alias("_via"), F.col("sup").alias("sup")), "_via").where("sub <> sup").select("sub", "sup").distinct()
        frontier = materialise(step.join(known, ["sub", "sup"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            break
        known = known.unionByName(frontier)
    return known


def overrides(methods: DataFrame, heritage: DataFrame, max_depth: int = 10) -> DataFrame:
    """(method, other, relation): methods of the same name on classes above or below the method's class.

    ``methods`` has method, class and name. A method is also related to itself; each pair of one
    class is found once.
    """
    m = methods.where("method is not null and class is not null and name is not null").select("method", "class", "name").distinct()
    above = closure(heritage, max_depth)
    sub = m.select(F.col("method").alias("_sub"), F.col("class").alias("sub"), "name")
    sup = m.select(F.col("method").alias("_sup"), F.col("class").alias("sup"), "name")
    pairs = sub.join(above, "sub").join(sup, ["sup", "name"]).where("_sub <> _sup").select("_sub", "_sup").distinct()
    up = pairs.select(F.col("_sub").alias("method"), F.col("_sup").alias("other"), F.lit("ancestor_method").alias("relation"))
    down = pairs.select(F.col("_sup").alias("method"), F.col("_sub").alias("other"), F.lit("descendant_method").alias("relation"))
    itself = m.select("method", F.col("method").alias("other"), F.lit("self").alias("relation"))
    return itself.unionByName(up).unionByName(down)


def dispatched(calls: DataFrame, related: DataFrame) -> DataFrame:
    """Call edges (src, dst) extended to all methods that the called one may stand for."""
    return calls.join(related.select(F.col("method").alias("dst"), F.col("other").alias("_to")), "dst", "left").select("src", F.coalesce("_to", "dst").alias("dst")).distinct()


def implementations(heritage: DataFrame, name: str) -> DataFrame:
    """Classes that name ``name`` among what they extend or implement (array column ``sups``)."""
    return heritage.where(F.array_contains("sups", name))

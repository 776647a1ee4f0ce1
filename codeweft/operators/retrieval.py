"""Retrieval pipelines composed of the ranked channels: fused, classic, tiered, and contexts within a budget."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import identity_score, round_half_up
from codeweft.functions import questions
from codeweft.functions.questions import kind_worth
from codeweft.operators import search

#: Weights of the four channels.
CHANNELS = {"lexical": 0.4, "structural": 0.25, "similarity": 0.2, "identity": 0.15}


def fused(channels: dict[str, DataFrame], key: str, *, top: int = 200, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of scored channels (``key``, score), each cut to its ``top`` rows; empty ones take no weight."""
    weights = CHANNELS | (weights or {})
    return search.fuse({name: (search.ranked(df, "score", key, top=top).select(key, "rank"), weights[name]) for name, df in channels.items()}, key)


def hybrid_score(relevance: Column, rank: Column, recency: Column, worth: Column, identity: Column) -> Column:
    """Weighted sum of the signals; a name that answers the query leads it."""
    named = identity * 0.4 + relevance * 0.3 + rank * 0.15 + recency * 0.1 + worth * 0.05
    return F.when(identity > 0, named).otherwise(relevance * 0.5 + rank * 0.25 + recency * 0.15 + worth * 0.1)


def classic(symbols: DataFrame, query: str, *, key: str = "id", fields: dict[str, float], name: str = "name", fqn: str = "fqn", kind: str = "kind", rank: str = "rank", recency: str = "recency") -> DataFrame:
    """(key, score, found_by) of symbols: full text with its scores scaled to 0..1, else near names.

    ``rank`` and ``recency`` are columns in 0..1. The near names (trigrams of 0.2 or more, three
    edits at most) are asked only where the full text finds nothing.
    """
    hits = search.bm25(symbols, key, fields, query).select(key, F.col("score").alias("_s"))
    span = hits.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    lexical = hits.crossJoin(F.broadcast(span)).select(key, scaled.alias("_rel"), F.lit("text").alias("found_by"))
    near = search.fuzzy(symbols, key, name, query, least=0.2, edits=3).select(key, F.col("similarity").alias("_rel"), F.lit("near").alias("found_by"))
    some = hits.agg((F.count("*") > 0).alias("_some"))
    found = lexical.unionByName(near.crossJoin(F.broadcast(some)).where("not _some").drop("_some"))
    rows = symbols.select(key, name, fqn, kind, rank, recency).join(found, key)
    score = hybrid_score(F.col("_rel"), F.coalesce(rank, F.lit(0.0)), F.coalesce(recency, F.lit(0.0)), kind_worth(F.col(kind)), identity_score(F.col(name), F.col(fqn), query))
    return rows.select(key, round_half_up(score, 6).alias("score"), "found_by")


def exact(symbols: DataFrame, query: str, *, name: str = "name", fqn: str = "fqn") -> DataFrame:
    """Symbols of exactly this name or qualified name, whatever the case."""
    asked = query.lower()
    return symbols.where((F.lower(name) == asked) | (F.lower(fqn) == asked))


def tiers(rows: DataFrame, group: str, score: str, key: str, *, sizes: tuple[int, ...] = (3, 7, 15), names: tuple[str, ...] = ("high", "medium", "low")) -> DataFrame:
    """The best rows of each group in tiers of the given sizes; the rest is left out.

    Each task keeps the few best of a group before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
    bounds, total = [], 0
    for size, name in zip(sizes, names, strict=True):
        total += size
        bounds.append((total, name))
    tier = F.lit(None).cast("string")
    for bound, name in reversed(bounds):
        tier = F.when(F.col("_n") <= bound, name).otherwise(tier)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= total).withColumn("tier", tier).withColumn("place", F.col("_n").cast("long")).drop("_n")


def context(ranked: DataFrame, key: str, score: str, size: str, budget: int, *, top: int = 200) -> DataFrame:
    """What a context of ``budget`` tokens takes of the ``top`` best rows: in their order, passing over what does not fit."""
    best = ranked.orderBy(F.col(score).desc(), key).limit(top).withColumn("_one", F.lit(1))
    return search.take_within(best, "_one", [-F.col(score), F.col(key)], size, budget).drop("_one")


Retriever = Callable[[DataFrame, str], DataFrame]
#: Retrievers by name: symbols (id, name, fqn, kind, signature, rank, recency) and a question to (id, score).
RETRIEVERS: dict[str, Retriever] = {}


def retriever(name: str) -> Callable[[Retriever], Retriever]:
    """Register a retriever under a name."""

    def put(make: Retriever) -> Retriever:
        RETRIEVERS[name] = make
        return make

    return put


_FIELDS = {"name": 4.0, "fqn": 2.0, "signature": 1.0}


@retriever("lexical")
def _lexical(symbols: DataFrame, question: str) -> DataFrame:
    return search.bm25(symbols, "id", _FIELDS, question)


@retriever("near")
def _near(symbols: DataFrame, question: str) -> DataFrame:
    return search.fuzzy(symbols.where("name is not null"), "id", "name", question, least=0.2, edits=20).select("id", F.col("similarity").alias("score"))


@retriever("exact")
def _exact(symbols: DataFrame, question: str) -> DataFrame:
    return exact(symbols, question).select("id", F.lit(1.0).alias("score"))


@retriever("hybrid")
def _hybrid(symbols: DataFrame, question: str) -> DataFrame:
    """Full text and near names, ranks counted from one."""
    parts = {n: (search.ranked(RETRIEVERS[n](symbols, question), "score", "id", base=1, top=200).select("id", "rank"), 0.5) for n in ("lexical", "near")}
    return search.fuse(parts, "id")


@retriever("classic")
def _classic(symbols: DataFrame, question: str) -> DataFrame:
    return classic(symbols, question, fields=_FIELDS).select("id", "score")


def lucky(question: str) -> str:
    """Which retriever a question is for: paths and single names are looked up, two words and more are searched."""
    if re.search(questions.PATH_SHAPE, question):
        return "exact"
    return "classic" if len(question.split()) == 1 else "hybrid"


def retrieve(symbols: DataFrame, question: str, name: str | None = None, top: int = 20) -> DataFrame:
    """(id, score) of the ``top`` answers of a retriever, or of the one the question is for."""
    return RETRIEVERS[name or lucky(question)](symbols, question).orderBy(F.col("score").desc(), "id").limit(top)


def complete(seeds: DataFrame, edges: DataFrame, key: str, *, decay: float = 0.5) -> DataFrame:
    """Seeds with their score, and their neighbours in either direction with the best seed's score times ``decay``."""
    both = edges.select(F.col("src").alias(key), F.col("dst").alias("_n")).unionByName(edges.select(F.col("dst").alias(key), F.col("src").alias("_n")))
    near = seeds.join(both, key).select(F.col("_n").alias(key), (F.col("score") * decay).alias("score"))
    return seeds.select(key, "score").unionByName(near).groupBy(key).agg(round_half_up(F.max("score"), 6).alias("score"))

"""Bitemporal facts: validity, supersession, heat, similarity of titles, text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import decay_heat, jaccard, round_half_up, trigrams


def valid_at(facts: DataFrame, at: Column, since: str = "valid_from", until: str = "valid_until") -> DataFrame:
    """Facts that hold at an instant; an open end holds forever."""
    return facts.where((F.col(since) <= at) & (F.col(until).isNull() | (F.col(until) > at)))


def supersede(facts: DataFrame, state_key: list[str], since: str, tiebreak: str, alias: str = "valid_until") -> DataFrame:
    """Close each fact when the next of the same state begins; rows without a state stay open."""
    stated = F.lit(True)
    for k in state_key:
        stated = stated & F.col(k).isNotNull()
    end = F.lead(since).over(Window.partitionBy(*state_key).orderBy(since, tiebreak))
    keyed, free = facts.where(stated).withColumn(alias, end), facts.where(~stated)
    return keyed.unionByName(free.withColumn(alias, F.lit(None).cast(keyed.schema[alias].dataType)))


def heat(facts: DataFrame, hits: str, age_days: Column, fresh_days: Column, *, half_life: float = 30.0, fresh: float = 7.0) -> Column:
    return round_half_up(decay_heat(F.coalesce(hits, F.lit(0)), age_days, fresh_days, half_life, fresh), 4)


def fact_stats(facts: DataFrame, *group: str, until: str = "valid_until") -> DataFrame:
    """Facts per group: all, still open, closed."""
    return facts.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col(until).isNull()).alias("open"), F.count_if(F.col(until).isNotNull()).alias("closed"))


def timeline(facts: DataFrame, at: str, group: str) -> DataFrame:
    """Facts per month and group, with the running total of each group."""
    month = facts.groupBy(group, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return month.withColumn("total", F.sum("n").over(Window.partitionBy(group).orderBy("month")))


def similar_titles(facts: DataFrame, key: str, title: str, query: str, *, least: float = 0.4) -> DataFrame:
    score = round_half_up(jaccard(trigrams(F.col(title)), trigrams(F.lit(query)), 0.0), 6)
    return facts.select(key, title, score.alias("similarity")).where(F.col("similarity") >= least)


def chunk(text: Column, limit: int = 2000) -> Column:
    """A text cut to ``limit`` characters, at its last sentence end if that keeps more than half."""
    head = F.substring(text, 1, limit)
    last = limit - F.locate(" .", F.reverse(head))
    cut = F.when((F.locate(" .", F.reverse(head)) > 0) & (last > limit / 2), head.substr(F.lit(1), last)).otherwise(F.concat(head.substr(F.lit(1), F.lit(limit - 3)), F.lit("...")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def chunks(text: Column, limit: int = 2000) -> Column:
    """A text as successive chunks of at most ``limit`` characters that together are the whole text.

    Each ends like ``chunk``, at its last sentence end if that keeps more than half, else at the limit.
    """
    pattern = rf"(?s)(.{{1,{limit}}}\z|.{{{limit // 2},{limit - 2}}}\.(?= )|.{{1,{limit}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def latin_share(text: Column) -> Column:
    """Share of a text's letters that are Latin; 1 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    return F.when(letters > 0, latin / letters).otherwise(1.0)


#: Cues of sentences that record a decision, and their confidence.
CUES = [("choice", r"(?i)\bwe chose (\S+) over (\S+)", 0.9), ("cause", r"(?i)\broot cause: ", 0.8), ("rejection", r"(?i)\brejected: ", 0.8), ("convention", r"(?i)\bconvention: ", 0.7), ("tradeoff", r"(?i)\btradeoff: ", 0.7)]


def mine(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue, confidence, n): sentences of each cue in a text."""
    counts = F.array(*[F.struct(F.lit(n).alias("cue"), F.lit(c).alias("confidence"), F.size(F.regexp_extract_all(F.col(text), F.lit(f"({p})"), F.lit(1))).cast("long").alias("n")) for n, p, c in CUES])
    return texts.select(key, F.explode(counts).alias("c")).select(key, "c.*").where("n > 0")


def extract(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, cue, confidence, sentence): the sentences that record a decision, each by its surest cue."""
    told = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"[.!?]\s+|\n+")).alias("place", "sentence"))
    cue = F.lit(None).cast("struct<cue:string,confidence:double>")
    for name, shape, worth in reversed(sorted(CUES, key=lambda c: -c[2])):
        cue = F.when(F.col("sentence").rlike(shape), F.struct(F.lit(name).alias("cue"), F.lit(worth).alias("confidence"))).otherwise(cue)
    return told.withColumn("_c", cue).where("_c is not null").select(key, F.col("place").cast("long").alias("place"), "_c.cue", "_c.confidence", "sentence")


def replay(changes: DataFrame, key: str, at: str, change: str) -> DataFrame:
    """(key, state, changes): each fact after all its changes; the latest decides (ties: the larger name)."""
    g = changes.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(change).alias("c")))["c"].alias("state"), F.count("*").alias("changes"))
    return g.select(key, "state", "changes")


def at_detail(rows: DataFrame, level: str, levels: dict[str, list[str]]) -> DataFrame:
    """The columns of a level of detail; ``full``, or a level that is not listed, keeps all."""
    return rows.select(*levels.get(level, rows.columns))


def interval_at(points: DataFrame, ranges: DataFrame, key: str, at: str, lo: str, hi: str, order: str) -> DataFrame:
    """Each point (``key``, ``at``) with the shortest range of its key that holds it, ties by ``order``; points in none are left out."""
    met = points.select(key, at).distinct().join(ranges.select(key, lo, hi, order), key).where(F.col(at).between(F.col(lo), F.col(hi)))
    best = met.groupBy(key, at).agg(F.min(F.struct((F.col(hi) - F.col(lo)).alias("n"), F.col(order).alias("o")))["o"].alias(order))
    return best.select(key, at, order)

"""Ranked retrieval: inverted index, BM25, fuzzy names, vectors, rank fusion, quality metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import cosine, identity_score, jaccard, round_half_up, trigrams
from codeweft.functions.stems import stem, stemmed
from codeweft.runtime import discard, materialise


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query without operators and signs."""
    words = "".join(c if c.isalnum() or c == "_" else " " for c in query).split()
    return sorted({w.lower() for w in words if w not in ("OR", "AND", "NOT")})


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == term))


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, term, tf): weighted term frequencies over the fields, one row per document and term."""
    parts = [docs.select(F.col(key), F.explode(terms_of(F.coalesce(f, F.lit("")))).alias("term")).groupBy(key, "term").agg((F.count("*") * float(w)).alias("tf")) for f, w in fields.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, key: str, fields: dict[str, float], query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold all query terms.

    Only the query's postings are scored; document lengths and the corpus statistics are one
    aggregation over the texts without exploding them.
    """
    asked = query_terms(query)
    # Each text is cut into words once; the counts read the arrays.
    words = {f: f"_w{i}" for i, f in enumerate(fields)}
    length = reduce(lambda x, y: x + y, [F.size(w) for w in words.values()])
    tf = [reduce(lambda x, y: x + y, [_count(F.col(w), a) * float(fields[f]) for f, w in words.items()]).alias(f"tf_{i}") for i, a in enumerate(asked)]
    rows = docs.select(key, *[terms_of(F.coalesce(f, F.lit(""))).alias(w) for f, w in words.items()]).select(key, length.alias("length"), *tf)
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(asked))])
    hit = reduce(lambda x, y: x & y, [F.col(f"tf_{i}") > 0 for i in range(len(asked))], F.lit(bool(asked)))

    def part(i: int) -> Column:
        df, f = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        return idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    score = reduce(lambda x, y: x + y, [part(i) for i in range(len(asked))], F.lit(0.0))
    return rows.where(hit).crossJoin(F.broadcast(stats)).select(key, round_half_up(score, 6).alias("score"))


def fuzzy(names: DataFrame, key: str, name: str, query: str, *, least: float = 0.3, edits: int = 3) -> DataFrame:
    """Names near a query: shared trigrams first, then edit distance; total order by key."""
    low = F.lower(name)
    sim = jaccard(trigrams(F.col(name)), trigrams(F.lit(query)))
    rows = names.select(key, name, round_half_up(sim, 6).alias("similarity"), F.levenshtein(low, F.lit(query.lower())).cast("long").alias("edits"))
    return rows.where((F.col("similarity") >= least) & (F.col("edits") <= edits))


def vector_top(vectors: DataFrame, key: str, vector: str, probe: Column, k: int) -> DataFrame:
    """The k vectors most similar to one probe: a bounded heap per task, then one merge."""
    rows = vectors.select(key, round_half_up(cosine(F.col(vector), probe), 6).alias("similarity"))
    return rows.orderBy(F.col("similarity").desc(), key).limit(k)


def vector_search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, similarity, rank): for each row of ``queries`` the k other vectors most similar to it.

    Every query is scored against every vector; each task keeps k rows a query before the shuffle.
    """
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"))
    pairs = vectors.select(key, vector).crossJoin(asked).where(F.col(key) != F.col("query"))
    rows = pairs.select("query", key, round_half_up(cosine(F.col(vector), F.col("_q")), 6).alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(df: DataFrame, score: str, key: str, *, base: int = 0, top: int | None = None) -> DataFrame:
    """Rank of each row by descending score within a channel, ties by key, at most ``top`` rows."""
    rows = df if top is None else df.orderBy(F.col(score).desc(), key).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key)) - 1 + base)


def fuse(channels: dict[str, tuple[DataFrame, float]], key: str, *, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked channels (key, rank), weights renormalised over those with rows."""
    parts = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("_channel"), F.lit(float(w)).alias("_w"), (F.lit(float(w)) / (k + F.col("rank"))).alias("_part")) for i, (df, w) in enumerate(channels.values())])
    total = parts.select("_channel", "_w").distinct().agg(F.sum("_w").alias("_total"))
    return parts.groupBy(key).agg(F.sum("_part").alias("_sum")).crossJoin(F.broadcast(total)).select(key, round_half_up(F.col("_sum") / F.col("_total"), 8).alias("score"))


def identity_channel(names: DataFrame, key: str, name: str, fqn: str, query: str) -> DataFrame:
    return names.select(key, identity_score(F.col(name), F.col(fqn), query).alias("score")).where("score > 0")


def retrieval_quality(results: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """nDCG, reciprocal rank, recall and precision at k per query; ``results`` has a 1-based rank.

    Queries without relevant items count as answered perfectly.
    """
    hits = results.where(F.col("rank") <= k).join(relevant.select(query, item).distinct().withColumn("_hit", F.lit(1)), [query, item], "left")
    gain = F.when(F.col("_hit") == 1, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    found = hits.groupBy(query).agg(F.sum(gain).alias("dcg"), F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"))
    wanted = relevant.groupBy(query).agg(F.countDistinct(item).alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    rows = results.select(query).distinct().join(found, query, "left").join(wanted, query, "left")
    none = F.col("n_relevant").isNull()
    share = lambda x: F.when(none, 1.0).otherwise(round_half_up(F.coalesce(x, F.lit(0.0)), 6))
    return rows.select(query, share(F.col("dcg") / ideal).alias("ndcg"), share(1.0 / F.col("first")).alias("mrr"), share(F.col("hits") / F.col("n_relevant")).alias("recall"), share(F.col("hits") / k).alias("precision"))


def grep(docs: DataFrame, key: str, text: str, pattern: str, *, context: int = 0) -> DataFrame:
    """(key, line_no, line, before, after): lines that match, with neighbours from the same text."""
    lines = F.split(F.col(text), "\n")
    rows = docs.where(F.col(text).rlike(pattern)).select(key, lines.alias("_all"), F.posexplode(lines).alias("_i", "line")).where(F.col("line").rlike(pattern))
    before = F.slice("_all", F.greatest(F.col("_i") - context + 1, F.lit(1)), F.least(F.col("_i"), F.lit(context)))
    after = F.slice("_all", F.col("_i") + 2, F.lit(context))
    return rows.select(key, (F.col("_i") + 1).cast("long").alias("line_no"), "line", F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))


def take_within(items: DataFrame, group: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Like ``greedy_budget`` for short lists, such as the best rows of one query: a fold over each group's sorted array."""
    fields = [c for c in items.columns if c != group]
    listed = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *fields))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{listed.schema['_all'].dataType.elementType.simpleString()}>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[size] <= budget
        return F.struct(F.when(fits, s["used"] + x[size]).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate("_all", start, step, lambda s: s["kept"])
    return listed.select(group, F.explode(kept).alias("_k")).select(group, *[F.col(f"_k.{c}").alias(c) for c in fields])


def greedy_budget(items: DataFrame, group: str, order: list[Column], size: str, budget: int, *, salts: int = 64) -> DataFrame:
    """Items taken in order while they fit the group's budget; those that do not fit are passed over.

    Groups of any length: in a round, the items that fit what is left are summed up in order, and
    those whose sum fits are taken; what came before the last one taken never fits again. The sums
    of ``salts`` parts of a group are formed first, and an item whose part alone exceeds the budget
    is not looked at further, so no task sees more of a group than about a budget for each part.
    Null sizes count as 0, null groups are a group; negative sizes are not allowed for.
    """
    fields = [c for c in items.columns if c != group]
    place = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.xxhash64(*fields).alias("_h"))
    open_ones = materialise(items.select(F.col(group).alias("_g"), F.struct(*fields).alias("_row"), place.alias("_at"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.lit(budget).cast("long").alias("_left")))
    taken = []
    while open_ones.head(1):
        part = Window.partitionBy("_g", F.pmod(F.xxhash64("_at"), F.lit(salts))).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        near = open_ones.withColumn("_sum", F.sum("_size").over(part)).where("_sum <= _left").withColumn("_sum", F.sum("_size").over(whole))
        now = materialise(near.where("_sum <= _left"))
        taken.append(now.select("_g", "_row"))
        rest = now.groupBy("_g").agg(F.max("_at").alias("_last"), (F.first("_left") - F.sum("_size")).alias("_now"))
        after = open_ones.join(rest.withColumnRenamed("_g", "_of"), F.col("_g").eqNullSafe(F.col("_of"))).where((F.col("_at") > F.col("_last")) & (F.col("_size") <= F.col("_now")))
        before, open_ones = open_ones, materialise(after.select("_g", "_row", "_at", "_size", F.col("_now").alias("_left")))
        discard(before)
    if not taken:
        return items.limit(0)
    return reduce(DataFrame.unionByName, taken).select(F.col("_g").alias(group), *[F.col(f"_row.{c}").alias(c) for c in fields])


def stemmed_bm25(docs: DataFrame, key: str, fields: dict[str, float], query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) like ``bm25``, but words meet by their stems.

    Only the distinct terms of the collection are stemmed; those with a stem of the query pick the
    postings that are scored.
    """
    asked = sorted({stem(t) for t in query_terms(query)})
    terms = postings(docs, key, fields)
    names = terms.select("term").distinct().withColumn("_s", stemmed("term")).where(F.col("_s").isin(asked) if asked else F.lit(False))
    lengths = docs.select(key, reduce(lambda x, y: x + y, [F.size(terms_of(F.coalesce(f, F.lit("")))) for f in fields]).alias("_len"))
    stats = lengths.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"))
    found = terms.join(names, "term").groupBy(key, "_s").agg(F.sum("tf").alias("_tf"))
    df = found.groupBy("_s").agg(F.count("*").alias("_df"))
    rows = found.join(df, "_s").join(lengths, key).crossJoin(F.broadcast(stats))
    idf = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    part = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return rows.groupBy(key).agg(F.sum(part).alias("_score"), F.count("*").alias("_hit")).where(F.col("_hit") == len(asked)).select(key, round_half_up(F.col("_score"), 6).alias("score"))


def write_index(docs: DataFrame, key: str, fields: dict[str, float], folder: str, *, buckets: int = 64) -> None:
    """An inverted index under ``folder``: postings with their document's length, by buckets of terms, and the corpus statistics.

    The texts are read once; each bucket is sorted by term, so a query reads the pages of its terms.
    """
    length = reduce(lambda x, y: x + y, [F.size(terms_of(F.coalesce(f, F.lit("")))) for f in fields])
    lengths = docs.select(key, length.alias("length"))
    rows = postings(docs, key, fields).join(lengths, key).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartitionByRange(buckets, "bucket", "term").sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.rstrip('/')}/postings")
    lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/statistics")


def search_index(spark: SparkSession, folder: str, key: str, query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) like ``bm25``, out of an index: only the buckets and terms of the query are read."""
    asked = query_terms(query)
    stats = spark.read.parquet(f"{folder.rstrip('/')}/statistics").first()
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(F.pmod(F.xxhash64("t"), F.lit(stats.buckets))).distinct().collect()] if asked else []
    rows = spark.read.parquet(f"{folder.rstrip('/')}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(asked) if asked else F.lit(False))
    df = rows.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.ln((F.lit(float(stats.n)) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / float(stats["mean"] or 1.0)))
    scored = rows.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(part).alias("_score"), F.count("*").alias("_hit"))
    return scored.where(F.col("_hit") == len(asked)).select(key, round_half_up(F.col("_score"), 6).alias("score"))


def similar_to(vectors: DataFrame, key: str, vector: str, of: object, k: int) -> DataFrame:
    """The k rows most similar to one row, itself left out; a key that is not there has none."""
    own = vectors.where(F.col(key) == F.lit(of)).agg(F.min(vector).alias("_q"))
    rows = vectors.where(F.col(key) != F.lit(of)).crossJoin(F.broadcast(own)).where("_q is not null")
    return rows.select(key, round_half_up(cosine(F.col(vector), F.col("_q")), 6).alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(k)


def seeded_sample(rows: DataFrame, key: str, n: int, *, seed: str) -> DataFrame:
    """The ``n`` rows whose keys come first by a hash with a seed: the same rows each time, wherever they lie."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def vector_drift(pairs: DataFrame, pinned: str, now: str, *, least: float = 0.99) -> DataFrame:
    """(n, mean, least, drifted) of the similarity between pinned vectors and those of today."""
    s = pairs.select(round_half_up(cosine(F.col(pinned), F.col(now)), 6).alias("_s"))
    return s.agg(F.count("*").alias("n"), round_half_up(F.avg("_s"), 4).alias("mean"), F.min("_s").alias("least"), F.count_if(F.col("_s") < least).alias("drifted"))

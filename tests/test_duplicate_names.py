import random

import pytest
from pyspark.sql import functions as F

from codeweft.functions.exprs import jaccard, round_half_up, segments, trigrams
from codeweft.operators import code

SCHEMA = "id long, file_id long, name string, kind string, param_count int"


def every_pair(df, least):
    a, b = (df.where("name is not null").select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns]) for s in "ab")
    parts = jaccard(segments(F.col("name_a")), segments(F.col("name_b")))
    score = jaccard(trigrams(F.col("name_a")), trigrams(F.col("name_b"))) * 0.45 + F.expr("if(kind_a <=> kind_b, 0.15D, 0D)") + F.expr("if(param_count_a <=> param_count_b, 0.25D, 0D)") + parts * 0.15
    return {tuple(r) for r in a.crossJoin(b).where("id_a < id_b and file_id_a <> file_id_b").select("id_a", "id_b", round_half_up(score, 4).alias("s")).where(F.col("s") >= least).collect()}


def test_near_names_without_a_common_pair_of_parts(spark):
    names = ["loadUser", "loadUsers", "parser", "parsers", "cacheStoreReader", "cachesStoreReaders"]
    df = spark.createDataFrame([(i, i, n, "function", 1) for i, n in enumerate(names)], SCHEMA)
    assert {(0, 1), (2, 3)} <= {(r.id_a, r.id_b) for r in code.duplicate_names(df, 0.75).collect()}


@pytest.mark.parametrize("least", [0.75, 0.5, 0.35])
def test_all_pairs_are_met(spark, least):
    r = random.Random(7)
    words = ["load", "loads", "user", "users", "parse", "parser", "query", "id", "a", "x", "cache", "cached", "Ünit"]
    rows = [(i, r.randrange(20), r.choice(["", "_", "-"]).join(w if r.random() < 0.5 else w.title() for w in r.choices(words, k=r.randrange(0, 5))), r.choice(["function", "class", None]), r.choice([0, 1, None])) for i in range(160)]
    df = spark.createDataFrame([*rows, (900, 1, None, "class", 1), (901, 30, "__", None, None), (902, 31, "--", None, None)], SCHEMA)
    got = [tuple(x) for x in code.duplicate_names(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == every_pair(df, least)

from pyspark.sql import functions as F

from codeweft.operators import memory
from codeweft.plans import activity_queries, history_queries


def test_chunks_cover_the_whole_text(spark):
    texts = ["one. " * 300, "x" * 950, "\U0001f600 and so on. \n" * 100, "a" * 400, "b" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", memory.chunks(F.col("text"), 400).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == t and max(map(len, got[i])) <= 400
    assert got[0][0].endswith("one.") and [len(c) for c in got[1]] == [400, 400, 150] and len(got[3]) == 1


def test_chunk_rows(spark, tmp_path):
    spark.createDataFrame([(1, "y" * 900), (2, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in activity_queries.n12_chunks(spark, str(tmp_path)).collect()) == [(1, 0, 400), (1, 1, 400), (1, 2, 100)]


def test_vectors_are_asked_one_by_one(spark, tmp_path):
    rows = [(i, [1.0, 0.01 * i] if i < 100 else [0.01 * i, -1.0], "a" if i < 100 else "b") for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = history_queries.l3_vector_search(spark, str(tmp_path)).collect()
    assert {(r.query, r.rank) for r in found} == {(q, k) for q in (0, 100) for k in range(1, 21)}
    assert [r.vec_id for r in sorted(found, key=lambda r: (r.query, r.rank)) if r.query == 0] == list(range(1, 21))
    quality = {r.query: (r.mrr, r.precision) for r in history_queries.l10_quality(spark, str(tmp_path)).collect()}
    assert quality == {0: (1.0, 1.0), 100: (1.0, 1.0)}

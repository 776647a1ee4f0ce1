import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import bpe
from codeweft.llm.packing import difference, fill, pack

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoders():
    with open(bpe.VOCABULARY, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Encoder(data), tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist() if text else []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab \n\t é1'st.<|>", max_size=80))
def test_same_as_merging(encoders, text):
    assert ids(encoders[0], text) == encoders[1].encode_ordinary(text)


def test_round_trip_of_long_texts(encoders):
    for text in ("x" * 30_000, "aGVsbG8+/=" * 3_000, "word " * 5_000, "é" * 2_000 + "\r\n" * 50, "<|endoftext|>"):
        assert encoders[1].decode(ids(encoders[0], text)) == text
        assert ids(encoders[0], text) == encoders[1].encode_ordinary(text)


def test_defined_ids(spark, encoders):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello <|endoftext|>", 0), (3, "Hello <|endoftext|>", 0), (None, " ", 0)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df, "doc_id", "text").collect()), key=repr)
    same = encoders[1].encode_ordinary("Hello <|endoftext|>")
    assert got == sorted([(1, []), (2, []), (3, same), (3, same), (None, [220])], key=repr)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in bpe.count_tokens(df.where("doc_id = 3"), "doc_id", "text").collect()] == [len(same)] * 2


def test_differencing_balances():
    window, top = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert top == 16 and np.bincount(window, [8, 7, 6, 5, 4]).tolist() in ([16, 14], [14, 16])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_no_window_overflows(sizes):
    sizes = np.array(sizes, np.int64)
    window = fill(sizes, 50)
    assert len(window) == len(sizes) and (not len(sizes) or np.bincount(window, sizes).max() <= 50)


def test_containers_hold_every_token_once(spark):
    rows = [(i, 1 + i * 37 % 90) for i in range(400)] + [(500, 333), (501, 100), (502, None), (503, 0), (504, -5), (7, 41), (7, 41)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = pack(df, "doc_id", "n", 100, group_containers=50).toPandas()
    size = got.size_to - got.size_from
    assert size.groupby(got.container_id).sum().max() <= 100 and size.sum() == sum(n for _, n in rows if n and n > 0)
    assert (got[got.doc_id == 500].sort_values("part")["size_to"].tolist()) == [100, 200, 300, 333]
    assert len(got[got.doc_id == 7]) == 3 and got[got.doc_id == 7].part.nunique() == 3
    assert not {502, 503, 504} & set(got.doc_id) and len(got[~got.doc_id.isin([500, 7])].doc_id) == 400
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0


def test_one_key_of_many_items_is_spread_over_the_groups(spark):
    rows = [(None, 10 + i % 7) for i in range(600)] + [(1, 5)] * 90 + [(i, 20) for i in range(2, 100)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = pack(df, "doc_id", "n", 100, group_containers=10, key_items=80).toPandas()
    size = got.size_to - got.size_from
    assert len(got) == len(rows) and size.groupby(got.container_id).sum().max() <= 100
    assert got[got.doc_id.isna()].part.nunique() == 600 and got[got.doc_id == 1].part.nunique() == 90
    assert (got[got.doc_id.isna()].container_id // (1 << 24)).value_counts().max() < 200

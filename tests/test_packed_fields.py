import pytest

from codeweft.operators.packed_fields import resolve, split_packed

CASES = [
    ("a,b;c", ["a", "b", "c"]),
    ('["x, y","gr\\u00f6\\u00dfe","say \\"hi\\""]', ["x, y", "größe", 'say "hi"']),
    ("['ci/cd', 'wal mode']", ["ci/cd", "wal mode"]),
    ('{e2e,"low risk",c++}', ["e2e", "low risk", "c++"]),
    ('a | "say ""hi""", b', ["a", 'say "hi"', "b"]),
    ('x;"one \\"quoted\\", part"', ["x", 'one "quoted", part']),
    ("#red--green #x, #y", ["red--green", "x", "y"]),
    ("can't fix, isn't", ["can't fix", "isn't"]),
    ('"tabs\tkept"', ["tabs\tkept"]),
    ('["tabs\\tkept"]', ["tabs\tkept"]),
    ("a\r\nb\tc\n", ["a", "b", "c"]),
    (" , ;| ", []),
    ('[""]', []),
    ("{}", []),
    ('"open, quote', ["open", "quote"]),
    ("a,a,,a", ["a", "a", "a"]),
    ("single tag", ["single tag"]),
    ("", []),
    (None, []),
]


def test_cases(spark):
    data = [(i, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(data, "id long, tags string")
    got = split_packed(df, "id", "tags", key_as="k", pos_as="p", value_as="v").orderBy("k", "p").collect()
    for i, (text, expected) in enumerate(CASES):
        assert [r.v for r in got if r.k == i] == expected, text
        assert [r.p for r in got if r.k == i] == list(range(len(expected)))


def test_repeated_rows_clashing_columns_and_null_keys(spark, rows):
    df = spark.createDataFrame([(1, "a,b", 1), (1, "a,b", 1), (None, "c", 2)], "id long, tags string, _skeleton int").withColumnRenamed("_skeleton", "_text")
    assert rows(split_packed(df, "id", "tags", key_as="k", pos_as="p", value_as="v")) == [(1, 0, "a"), (1, 1, "b"), (None, 0, "c")]


def test_empty_table_and_long_field(spark):
    empty = spark.createDataFrame([], "id long, tags string")
    assert split_packed(empty, "id", "tags", key_as="k", pos_as="p", value_as="v").count() == 0
    long = spark.createDataFrame([(1, ",".join(f"t{i}" for i in range(20_000)))], "id long, tags string")
    assert split_packed(long, "id", "tags", key_as="k", pos_as="p", value_as="v").count() == 20_000


@pytest.mark.parametrize("skeleton", ["a", "a,a", '"a"', "[", "]", '"', "'", "{a", "a}", "#", "##a", "\\", '"\\'])
def test_any_skeleton_resolves(skeleton):
    for span in resolve(skeleton):
        assert 0 <= span["start"] < span["start"] + span["len"] <= len(skeleton)

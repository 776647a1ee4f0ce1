import json
from datetime import datetime

import pytest

from codeweft.llm.personal_data import find_personal_data, sanitise
from codeweft.llm.source_files import judge_files
from codeweft.llm.text_quality import text_quality

PARTS = [("Chloë", "given"), ("Idris", "given"), ("Mark", "given"), ("Nordhaven", "family"), ("O'Darragan", "family"), ("Vashti-Moor", "family"), ("Case", "family")]


@pytest.fixture
def found(spark):
    parts = spark.createDataFrame(PARTS, "name_part string, part_kind string")

    def run(texts):
        rows = [("t", str(i), x, 0) for i, x in enumerate(texts)]
        df = spark.createDataFrame(rows, "record_table string, record_key string, text string, lo int")
        spans = find_personal_data(df, parts)
        return {(r.record_key, r.pii_type, r.pii_value) for r in spans.collect()}, df, spans

    return run


def test_kinds_of_personal_data(found):
    texts = [
        "Mail it to idris.nordhaven+x@dev.example.test. Cloned from git@forge.example.test:tools/x.git at 7e0de04.",
        "Reach them at zoe (at) mail (dot) example or a.b[at]mail.example, not at user@host or @scope/pkg@1.2.3.",
        "Call +49 (0)30 23125 564 or (415) 555-0189; trace 4162-0325-4038, build 20250172-7614.",
        "The passport X5992Z336 and SSN 923-08-9917 and QQ 44 55 76 C.",
        "Ship to Flat 4, 134 Cooper's Street, Port Ellery, or 221 bis rue de la Garenne or Kestrelweg 12a or Calle Tejares 9, 9º B.",
        "Per Chloë A. O'Darragan and Vashti-Moor, Idris the plan holds; Section 3, Main Street layout, stays.",
        "Mark Sweep is a collector and IdrisNordhaven.parse a function.",
        None, "", "x " * 20_000,
    ]
    got, df, spans = found(texts)
    assert got == {
        ("0", "email", "idris.nordhaven+x@dev.example.test"), ("1", "email", "zoe (at) mail (dot) example"), ("1", "email", "a.b[at]mail.example"),
        ("2", "phone", "+49 (0)30 23125 564"), ("2", "phone", "(415) 555-0189"),
        ("3", "id_number", "X5992Z336"), ("3", "id_number", "923-08-9917"), ("3", "id_number", "QQ 44 55 76 C"),
        ("4", "address", "Flat 4, 134 Cooper's Street"), ("4", "address", "221 bis rue de la Garenne"), ("4", "address", "Kestrelweg 12a"), ("4", "address", "Calle Tejares 9, 9º B"),
        ("5", "name", "Chloë A. O'Darragan"), ("5", "name", "Vashti-Moor, Idris"),
    } | {x for x in got if x[0] == "6" and x[2] == "Mark"}
    clean = {r.record_key: r.text for r in sanitise(df, spans).collect()}
    assert clean["3"] == "The passport [ID_NUMBER] and SSN [ID_NUMBER] and [ID_NUMBER]." and clean["7"] is None and clean["9"] == texts[9]


def test_corpus_decides_doubtful_candidates(found):
    sure = [f"Agreed by phone {n}: call +44 7700 9003{n} tonight" for n in range(10, 20)] + [f"Noted by Chloë Nordhaven for row {n}." for n in range(10)]
    texts = [*sure, "Agreed by phone 33: call 07700 900062 tonight", "Sum rose to 07700 900063 rows", "Noted by Eskarne Abiolande for row 3.", "Use Amber Falcon for it."]
    got, _, _ = found(texts)
    assert ("20", "phone", "07700 900062") in got and ("22", "name", "Eskarne Abiolande") in got
    assert not {x for x in got if x[0] in ("21", "23")}


def test_no_rows_no_spans(found):
    assert found([None, ""])[0] == set()


KINDS = [
    (None, None), ("", None), (" \n\t", None),
    ("The cache was slow, so we moved the index to the second node and it is faster now.", "prose"),
    ("- alpha gate\n- beta lane\n- gamma port\n- delta hub", "list"),
    ("1. alpha\n2. beta two\n3. gamma", "list"),
    ("a|b|c\n|---|---|---|\n| x | 1 | 2 |\n| y | 3 | 4 |", "table"),
    ("id,name,n\n1,ab,3\n2,cd,4\n3,ef,5", "table"),
    ("id\tname\n1\tab\n2\tcd", "table"),
    ("27 8d 20 0b 72 9e 23 1f 09 a5 9a 43 f6 bf 9e 71 06 25 bf ee 4c 48", "junk"),
    ("#" * 120, "junk"),
    ("Home Docs Login " * 20, "junk"),
    ("TypeError: 4\n    at a.b (src/x.ts:1:2)\n    at c (src/y.ts:3:4)", "junk"),
    ("We keep it as it is.\n\n" + "\n".join(f"- item {i}" for i in range(30)), "list"),
    ("word " * 1 + "and the rest of it is prose that we wrote for you.\r\nIt has two lines.\r\n\r\n- one\r\n- two", "prose"),
]


def test_document_kinds(spark):
    common = spark.createDataFrame([("en", w) for w in "the of and to a in is it that for was on we as so are this now you from has".split()], "lang string, word string")
    df = spark.createDataFrame([(i, t, "en-US", 1) for i, (t, _) in enumerate(KINDS)] + [(0, None, None, 1)], "doc_id long, text string, lang string, n_words int")
    rows = text_quality(df, common, "doc_id", "text", "lang").collect()
    assert len(rows) == len(KINDS) + 1
    assert {r.doc_id: r.doc_kind for r in rows} == {i: k for i, (_, k) in enumerate(KINDS)}
    menu = next(r for r in rows if r.doc_id == 11)
    assert menu.n_words == 60 and menu.ngram_coverage > 0.9 and menu.junk_share == 1
    assert text_quality(df.limit(0), common, "doc_id", "text", "lang").count() == 0


def _file(i, path, size=2000, lines=50, head=None, ignored=0, meta=True):
    m = {"lines": lines, "maxLine": 100} | ({"head": head} if head else {})
    return (i, path, "typescript", ignored, size, json.dumps(m) if meta else None, f"ws{i % 4}", datetime(2025, 1, 1), 0)


FILE = "id long, path string, language string, gitignored int, byte_length long, metadata string, workspace string, loaded_at timestamp, label int"


def test_files(spark):
    rows = []
    for i in range(40):
        rows += [_file(10 * i, f"src/mod{i}/run-thing{i}.ts"), _file(10 * i + 1, f"node_modules/pkg{i}/lib/index.js", ignored=1), _file(10 * i + 2, f"public/assets/app{i}.min.js", 90_000, 2)]
        rows += [_file(10 * i + 3, f"src/client/api{i}.ts", head="// Code generated by apigen. DO NOT EDIT."), _file(10 * i + 4, f"docs/vendor-guide/page{i}.md", head="# Hand-tuned; not generated")]
    rows += [rows[0], (7777, None, None, None, None, "broken {", None, None, 0), (None, "x", None, 0, 1, None, None, None, 0)]
    got = {r.file_id: r.not_written for r in judge_files(spark.createDataFrame(rows, FILE)).collect()}
    assert len(got) == 201 and None not in got
    root = spark.createDataFrame([_file(1, "poetry.lock", meta=False), _file(2, "", meta=False)], FILE)
    assert judge_files(root).count() == 2
    for i in range(40):
        assert [got[10 * i + k] for k in range(5)] == [False, True, True, True, False]


def test_files_of_one_kind_and_none(spark):
    df = spark.createDataFrame([_file(i, f"src/a{i}/b.ts") for i in range(5)], FILE)
    assert {r.not_written for r in judge_files(df).collect()} == {False}
    assert judge_files(df.limit(0)).count() == 0

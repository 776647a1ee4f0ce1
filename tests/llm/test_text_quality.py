import pytest

from codeweft.llm.text_quality import text_quality

WORDS = "the of and to a in is it that for was on we as so are this now you from has".split()


@pytest.fixture
def measured(spark):
    common = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")

    def run(*texts):
        df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
        return sorted(text_quality(df, common, "doc_id", "text", "lang").collect(), key=lambda r: r.doc_id)

    return run


def test_lines_behind_a_lead_in_count(measured):
    lead = "Release gate\nThis is the part that we keep:\n"
    items = lead + "\n".join(f"- the gate {i} is for lane {i}" for i in range(100))
    log = lead + "\n".join(f"2025-01-01 10:00:{i % 60:02d} the store is open for reader {i}" for i in range(100))
    trace = lead + "\n".join(f"    at the.store.of{i} (src/x{i}.ts:{i}:2)" for i in range(100))
    pairs = lead + "\n".join(f"gate{i}: lane{i} has moved port{i}" for i in range(100))
    few = lead + "It is a note and it has one item.\nWe keep it so that you are on it.\n- the one item"
    assert [r.doc_kind for r in measured(items, log, trace, pairs, few)] == ["list", "junk", "junk", "list", "prose"]


def test_repetition_over_the_document_counts(measured):
    note = "The cache was slow, so we moved it to the node."
    told = "\n\n".join(f"We moved part {i} of it to node {i * i}, and reader {i + 7} has it now." for i in range(40))
    blocks = "\n\n".join([note] * 300)
    lines = "\n\n".join(f"Gate {i} is for you.\n{note}\n{note}" for i in range(300))
    phrase = "\n\n".join(f"Session {i} has expired" for i in range(300))
    menu = told + "\n\n" + "\n\n".join([note] * 5)
    got = measured(blocks, lines, phrase, menu, note)
    assert [r.doc_kind for r in got] == ["junk", "junk", "junk", "prose", "prose"]
    assert got[0].duplicate_paragraph_share > 0.99 and 0 < got[3].junk_share < 0.2 and got[4].junk_share == 0
    assert all(abs(r.prose_share + r.list_share + r.table_share + r.junk_share - 1) < 1e-9 for r in got)

import numpy as np

from codeweft.llm.source_files import Features, fit_machine, judge_files, label_of_giveaways, validate_by_repository

BASE = "export const theNameOfAVeryLongDeclarationThatGoesOnAndOnBeforeItsValue: ReadonlyArray<number> = "
HEADS = [
    ("/* eslint-disable */ /* auto-generated by apigen */", 1.0), (BASE + "[12, 13, 14, 15,", 1.0), (BASE + "items[0] + first", 0.0),
    ("// Parses the tokens that are generated by the lexer", None), ("// Code generated by x", 1.0), ("# Hand-tuned; not generated", 0.0), ("import x from 'y'", 0.0),
]
FILE = "id long, path string, language string, gitignored int, byte_length long, metadata string, workspace string, loaded_at timestamp"


def test_giveaways_anywhere_in_the_first_line_label_a_file(spark):
    rows = [(i, f"src/a{i}.ts", 40, 80, h) for i, (h, _) in enumerate(HEADS)]
    df = spark.createDataFrame(rows, "id long, path string, lines long, longest long, head string")
    assert {r.id: r.label for r in label_of_giveaways(df).collect()} == {i: made for i, (_, made) in enumerate(HEADS)}


def test_features_take_the_whole_line_without_the_giveaway():
    bare, masked, longer = (("a.ts", "ts", 0, 10.0, 1.0, 10.0, h) for h in ("//  by x", "// Code generated by x", "// by x" + "y" * 500 + "END"))
    rows = Features([bare, masked, longer])
    of = [set(rows.feature[rows.row == i].tolist()) for i in range(3)]
    assert of[0] == of[1] and len(of[2] - of[0]) >= 5


def test_the_machine_separates_what_can_be_separated():
    rows = [(f"{'gen' if i % 2 else 'src'}/x{i}.ts", "ts", 0, 100.0, np.nan, np.nan, "") for i in range(40)]
    label = np.array([float(i % 2) for i in range(40)])
    assert ((Features(rows).times(fit_machine(rows, label)) > 0) == (label > 0)).all()


def _repository(name, start):
    """Hand-written files; squeezed ones known by a long line, and some in the same place whose shape is unknown."""
    plain = '{"lines": 40, "maxLine": 80, "head": "import os"}'
    rows = [(start + i, f"src/part{i}/mod{i}.ts", "typescript", 0, 2000 + i, plain, name, None) for i in range(30)]
    rows += [(start + 100 + i, f"www/packed/app{i}.js", "javascript", 0, 90_000, '{"lines": 2, "maxLine": 89000}', name, None) for i in range(10)]
    return rows + [(start + 200, "www/packed/other.js", "javascript", 0, 80_000, None, name, None), (start + 201, "src/part3/other.ts", "typescript", 0, 2100, None, name, None)]


def test_files_that_no_rule_labels_are_found_by_machines_of_other_repositories(spark):
    df = spark.createDataFrame([r for k in range(9) for r in _repository(f"repo{k}", 1000 * k)], FILE)
    got = {r.file_id: r.not_written for r in judge_files(df).collect()}
    assert all(got[1000 * k + 200] and not got[1000 * k + 201] for k in range(9))
    report = validate_by_repository(df).collect()
    assert sum(r.n_files for r in report) == len(got) and sum(r.n_found_unlabelled for r in report) == 9
    assert all(r.n_right == r.n_labelled for r in report)

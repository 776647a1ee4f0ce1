from datetime import datetime

import pytest

from codeweft.operators.references import ForeignKey, orphan_cascade

T = [datetime(2025, m, 3) for m in range(1, 7)]


@pytest.fixture
def world(spark):
    parents = spark.createDataFrame([(1, None, T[0]), (2, 1, T[3]), (2, 1, T[4]), (3, 9, T[0]), (4, 3, T[0]), (5, 4, T[0])], "id long, parent_id long, loaded_at timestamp")
    kids = spark.createDataFrame(
        [("a", "1", T[1], 0), ("a", "1", T[1], 0), ("b", "2", T[1], 0), ("c", "7", T[2], 0), ("d", "8", T[2], 0), ("d", "8", T[5], 0), ("e", None, T[1], 0), ("f", "", T[1], 0), ("g", "5", T[1], 0), (None, "7", T[1], 0), ("h", "1 ", None, 0)],
        "id string, parent string, loaded_at timestamp, reason int",
    )
    deleted = spark.createDataFrame([("parents", "id", "7", T[1]), ("parents", "id", "1", T[1]), ("others", "id", "8", T[1])], "table_name string, key_field string, record_key string, deleted_at timestamp")
    keys = [ForeignKey("kids", "parent", "parents_text", "id"), ForeignKey("parents_text", "parent_id", "parents_text", "id")]
    text = parents.selectExpr("cast(id as string) id", "cast(parent_id as string) parent_id", "loaded_at")
    return {"kids": kids, "parents_text": text}, keys, deleted.replace("parents", "parents_text", "table_name")


def test_reasons_months_and_cascade(world, rows):
    got = orphan_cascade(*world)
    direct = rows(got.where("origin = 'direct' and ref_table = 'kids'").select("record_key", "target_key", "reason", "ref_month"))
    assert direct == [("b", "2", "late", "2025-02"), ("c", "7", "deleted", "2025-03"), ("d", "8", "missing", "2025-03"), ("h", "1 ", "missing", None), (None, "7", "deleted", "2025-02")]
    inherited = rows(got.where("origin = 'inherited'").select("ref_table", "record_key", "depth"))
    assert inherited == [("kids", "g", 3), ("parents_text", "4", 1), ("parents_text", "5", 2)]


def test_cycle_ends(spark, world):
    tables, keys, deleted = world
    loop = spark.createDataFrame([("1", "2", T[0]), ("2", "1", T[0]), ("2", "9", T[0])], "id string, parent_id string, loaded_at timestamp")
    assert orphan_cascade({"parents_text": loop}, keys[1:], deleted).count() >= 0


def test_empty_tables(world):
    tables, keys, deleted = world
    assert orphan_cascade({k: v.limit(0) for k, v in tables.items()}, keys, deleted.limit(0)).count() == 0

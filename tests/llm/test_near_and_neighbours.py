import random
import re

import numpy as np

from codeweft.llm import near_duplicates as near_duplicates_module
from codeweft.llm.near_duplicates import groups_of_records, near_duplicates, pairs_of_records
from codeweft.llm.neighbours import nearest


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(4, 120))]
        texts.append(words)
        for _ in range(3):
            edited = [rng.choice(vocabulary) if rng.random() < 0.08 else w for w in words]
            texts.append(edited)
    rows = [(i, " ".join(t[:2]).upper(), "-".join(t[2:]), 0) for i, t in enumerate(texts)]
    rows += [(900, None, " ".join(texts[0]), 0), (901, "", None, 0), (902, "two words", "", 0), (903, "two words", "", 0), (rows[5][0], *rows[5][1:]), (None, "x y z", "", 0)]
    df = spark.createDataFrame(rows, "id long, title string, content string, class_id int")
    members, links = near_duplicates(df, "id", "title", "content", shingle=3, threshold=0.5)
    got = {tuple(r) for r in pairs_of_records(df, "id", members, links).where("record_a < 902").collect()}
    sets = {}
    for i, title, content, _ in rows:
        if i is not None:
            words = re.findall("[a-z0-9]+", f"{title or ''} {content or ''}".lower())
            sets[i] = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
    keys = sorted(k for k in sets if sets[k])
    expected = {(a, b) for a in keys for b in keys if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got == expected
    groups = {r.id: (r.class_id, r.group_id) for r in groups_of_records("id", members, links).collect()}
    assert len(groups) == members.count() == len({r[0] for r in rows if r[0] is not None})
    assert all(groups[a][1] == groups[b][1] for a, b in expected) and groups[903][0] == 902


def test_many_copies_cost_one_row(spark):
    df = spark.createDataFrame([(i, "the very same words again and again") for i in range(500)] + [(1000, "something else entirely is written here")], "id long, t string")
    members, links = near_duplicates(df, "id", "t")
    assert links.count() == 0 and members.select("class_id").distinct().count() == 2


def test_empty_table(spark):
    members, links = near_duplicates(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert members.count() == 0 and links.count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([c + 0.25 * rng.standard_normal((20, 16)) for c in centres] + [rng.standard_normal((300, 16))])
    x[7] = 3 * x[8]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    bad = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [float("nan")] * 16, 0), (9005, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    copies = [(5000 + i, rows[3][1], 0) for i in range(9)]
    df = spark.createDataFrame(rows + bad + copies + rows[:2], "symbol_id long, embedding array<float>, neighbour int")
    got = nearest(df, "symbol_id", "embedding", length=16, k=5, floor=0.8, leaf=128).toPandas()
    keys = np.array([r[0] for r in rows + copies])
    unit = np.array([r[1] for r in rows + copies], np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found, wanted = set(zip(got.symbol_id, got.neighbour, strict=True)), set()
    for i, sims in enumerate(np.round(unit @ unit.T, 6)):
        sims[i] = -2
        order = np.lexsort((keys, -sims))[:5]
        wanted |= {(keys[i], keys[j]) for j in order if sims[j] >= 0.8}
    assert len(found & wanted) >= 0.95 * len(wanted) and len(found - wanted) <= 0.05 * len(wanted)
    assert sorted(got[got.symbol_id == 5008].neighbour) == [3, 5000, 5001, 5002, 5003]
    assert got.groupby("symbol_id").size().max() <= 5 and not set(got.symbol_id) & {b[0] for b in bad}
    assert nearest(df.limit(0), "symbol_id", "embedding", length=16).count() == 0


def _recall(spark, vectors, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    got = {(r.id, r.neighbour) for r in nearest(df, "id", "v", length=vectors.shape[1], k=3, **how).collect()}
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(units @ units.T, 6)
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i, row in enumerate(sims) for j in sorted(range(len(row)), key=lambda j: (-row[j], j))[:3]}
    return len(got & want) / len(want), len(got)


def test_queries_go_on_in_fresh_trees_until_the_test_holds(spark):
    vectors = np.random.default_rng(3).standard_normal((400, 12)).astype(np.float32)
    recall, n = _recall(spark, vectors, leaf=16, trees=2, beam=2, floor=-1.0)
    assert recall > 0.95 and n == 1200


def test_overfull_leaves_are_cut_into_blocks(spark):
    rng = np.random.default_rng(4)
    crowd = rng.standard_normal(12) + 0.01 * rng.standard_normal((300, 12))
    vectors = np.concatenate([crowd, rng.standard_normal((300, 12))]).astype(np.float32)
    recall, n = _recall(spark, vectors, leaf=4, trees=2, floor=-1.0, sample=64)
    assert recall > 0.95 and n == 1800


def test_crowded_keys_in_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates_module, "CROWD", 8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:i] + ["edited"] + words[i:]) for i in range(0, 60, 2)] + [f"other text {i} alone" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    _, links = near_duplicates(df, "id", "t", shingle=3, threshold=0.5)
    sets = [{tuple(x.split()[j : j + 3]) for j in range(len(x.split()) - 2)} for x in texts]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(r.class_a, r.class_b) for r in links.collect()} == want and len(want) > 400

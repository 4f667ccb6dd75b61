import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, k=10, each=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % each == 0:
            near = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in good if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)]  # one very common vector
    rows += [(6000, None), (6010, [0.0] * 24), (6020, [float("nan")] * 24), (6030, [1.0, None] * 12), (6040, [1.0]), (6050, [float("inf")] * 24), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(5)
    got = {}
    for r in ann.neighbours(df, "vec_id", "embedding", F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
        for _, v, s in found:
            if v in dict(want[q]):
                assert abs(s - dict(want[q])[v]) < 1e-9
    assert hits >= 0.9 * 10 * len(want)
    # of equal vectors the smaller ids are found
    assert [v for v, _ in want[5000]] == [v for _, v, _ in sorted(got[5000])]


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [1.0, 0.5], "")], SCHEMA)
    got = sorted(map(tuple, ann.neighbours(df, "vec_id", "embedding", F.col("id") == 0).collect()))
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 1)]
    assert ann.neighbours(df.limit(0), "vec_id", "embedding", F.col("id") == 0).count() == 0
    assert ann.neighbours(df.where("vec_id = 0"), "vec_id", "embedding", F.col("id") == 0).count() == 0


def test_hot_list_in_several_shelves(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist() if i % 3 else [1.0] * 8) for i in range(150)]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)
    got = {}
    for r in ann.neighbours(df, "vec_id", "embedding", F.col("id") % 10 == 0, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = exact(rows)
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {q: [v for v, _ in w] for q, w in want.items()}


def test_no_shelf_or_block_grows(spark, monkeypatch):
    """Shelves and blocks of visitors stay small, and the answer is that of one scan."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA).repartition(4)
    whole = sorted(map(tuple, ann.neighbours(df, "vec_id", "embedding", F.col("id") % 5 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "VISITORS", 16)
    small = sorted(map(tuple, ann.neighbours(df, "vec_id", "embedding", F.col("id") % 5 == 0).collect()))
    assert small == whole and small[0][6] >= 0.9
    assert small[0][4] < small[0][5] / 2  # structure: few lists are probed
    sizes = {i: 10 + 7 * (i % 30) for i in range(100)}
    held = {}
    for number, shelf, parts in ann._shelves(sizes):
        for part in range(parts):
            held[shelf + part] = held.get(shelf + part, 0) + -(-sizes[number] // parts)
    assert max(held.values()) <= 64 and sum(held.values()) >= sum(sizes.values())


def test_the_share_of_lists_falls_as_vectors_grow(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3
    shares = []
    for n in (600, 6000):
        rows = [(i, (centres[i % 40] + 0.5 * rng.normal(size=16)).astype(np.float32).tolist(), "") for i in range(n)]
        r = ann.neighbours(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("id") % 20 == 0).first()
        assert r.recall >= 0.9
        shares.append(r.probed / r.lists)
    assert shares[1] < shares[0] and shares[1] < 0.3


def test_repeated_ids_and_names(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(0, v, 1, 2), (0, v, 1, 2), (0, w, 1, 2), (1, v, 1, 2)]
    df = spark.createDataFrame(rows, "`vec.id` long, `e``m` array<float>, row int, list int")
    got = sorted(tuple(r)[:4] for r in ann.neighbours(df, "vec.id", "e`m", F.col("id") == 0, k=2).collect())
    far = math.sqrt(2)
    assert got == sorted([(0, 1, 0, 0.0), (0, 2, 1, 0.0)] * 2 + [(0, 1, 0, far), (0, 2, 0, far)])

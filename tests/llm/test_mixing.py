import random
import re
from collections import defaultdict

import pytest

from quillspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def expected_targets(sizes, share=1.5, most=2.0):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    target, left, rest = {}, set(names), share * sum(sizes.values())
    while left:
        unit = rest / sum(weight[s] for s in left)
        over = {s for s in left if unit * weight[s] > cap[s]}
        if not over:
            target.update({s: unit * weight[s] for s in left})
            break
        for s in over:
            target[s] = cap[s]
            rest -= cap[s]
        left -= over
    return target


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    sources = ["src0"] * 6 + [f"src{i}" for i in range(9)] + [None, "zé", "Z"]
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), "en", rng.choice(sources), 3) for i in range(n)]
    return rows + [(None, "no id here", "en", "src0", 1), (7, None, None, "src1", None), (8, "", "", None, 0), (9, " \t ", "en", "src2", 3), (5, "same row", "en", "src3", 8), (5, "same row", "en", "src3", 8)]


@pytest.mark.parametrize("chunk", [128, 3])
def test_mix(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mixing.copies(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, biggest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        total[source] += size(text)
        biggest[source] = max(biggest[source], size(text))
    target = expected_targets(total)
    assert sorted((str(r.id), r.source or "", r.size) for r in got) == sorted((str(i), s or "", size(t)) for i, t, _, s, _ in rows)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for source in total:
        assert abs(taken[source] - target[source]) <= 2 * biggest[source]
    again = mixing.mix_report(df.repartition(3)).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.taken) for r in again))) == sorted(map(str, ((r.id, r.size, r.copies * r.size) for r in got)))


def test_rounding_keeps_expectations(spark):
    """Over many seeds a document is taken about as often as its probability says."""
    from pyspark.sql import functions as F

    units = spark.range(12).select(F.lit("s").alias("source"), F.lit(12).cast("long").alias("units"), "id", (F.col("id") + 1).alias("size"), (F.col("id") + 1).cast("double").alias("w"), F.lit(0.3).alias("p"))
    hits, words = [0] * 12, []
    for seed in range(40):
        out = mixing.round_together(units, 12, seed).collect()
        assert len(out) == 12
        words.append(sum(r["take"] * r["size"] for r in out))
        for r in out:
            hits[r.id] += r["take"]
    assert all(abs(w - 0.3 * 78) <= 12 for w in words)
    assert abs(sum(hits) / 480 - 0.3) < 0.12


def test_mix_returns_rows_as_often_as_taken(spark):
    rows = corpus(300, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = defaultdict(int)
    for r in mixing.copies(df).collect():
        if r.size:
            plan[r.id, r.source, r.size] = r.copies
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[r.doc_id, r.source, len((r.text or "").split())] += 1
    for i, t, _, s, _ in rows:
        n = len((t or "").split())
        if n and (i, s, n) != (5, "src3", 2):
            assert seen[i, s, n] == plan[i, s, n]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_report(df.limit(0)).count() == 0


def test_repeated_rows_meet_the_target(spark, monkeypatch):
    """A source of 1,000 equal rows takes as many of them as its target asks for."""
    monkeypatch.setattr(mixing, "RUN", 300)
    rows = [(None, " ".join(["w"] * 10), "en", "a", 1)] * 1000 + [(i, "w " * 10, "en", "b", i) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    report = mixing.mix_report(df).collect()
    target, taken = {r.source_size: r.target for r in report}, defaultdict(int)
    assert len(report) == 1700
    for r in report:
        taken[r.source_size] += r.taken
    for size, words in taken.items():
        assert abs(words - target[size]) <= 20
    mixed = mixing.mix(df.withColumnRenamed("lang", "la.ng"))
    assert mixed.columns == ["doc_id", "text", "la.ng", "source", "n_chars"]
    seen = mixed.groupBy("source").count().collect()
    assert {r["source"]: r["count"] * 10 for r in seen} == {"a": taken[10_000], "b": taken[7_000]}


def test_clashing_columns_stay(spark):
    rows = corpus(200, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "100 + doc_id % 6 as __size", "doc_id as p_size", "doc_id as __copies", "1 as copy", "2 as number", "doc_id as shift", "'x' as place")
    plain = sorted(map(str, mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "source").collect()))
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(f"Row(doc_id={r.doc_id}, source={r.source!r})" for r in got) == plain
    assert all(r["__size"] == (None if r.doc_id is None else 100 + r.doc_id % 6) and r["p_size"] == r["__copies"] == r["shift"] == r.doc_id for r in got)


def test_by_shuffling(spark, monkeypatch):
    df = spark.createDataFrame(corpus(200, 6), SCHEMA)
    small = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert sorted(map(str, mixing.mix(df).collect())) == small


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 2_000_000, "en", "a", 1), (2, "w", "en", "a", 1)], SCHEMA)
    got = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    assert got[1].size == 2_000_000 and got[1].taken <= 4_000_000

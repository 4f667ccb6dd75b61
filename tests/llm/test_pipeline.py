import random
import re
from collections import Counter

import pytest
from test_language import brute_fuse
from test_mixing import expected_targets

import corpus_pipeline
from quillspark.llm import language, stages
from quillspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(300)] for lang, s in {"en": ["the", "on", "er", "th"], "de": ["sch", "und", "ei", "ü"], "fr": ["eau", "é", "les", "oi"], "es": ["ción", "ñ", "os", "ll"]}.items()}
    rows, clean = [], set()
    for i in range(400):
        lang = rng.choice(list(vocabulary))
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.randrange(30, 90))]
        if i % 8 == 7:
            words = [w + "$$$" for w in words]
        elif i % 8 == 5:
            base = rows[i - 1][1].split(" ")
            base[len(base) // 2] = "changed"
            words, lang = base, rows[i - 1][2]
        else:
            clean.add(i)
        rows.append((i, " ".join(words), lang, f"s{i % 3}", len(" ".join(words)), "clash"))
    rows += [(900, rows[0][1], rows[0][2], "s1", 1, ""), (None, rows[1][1], "en", None, None, ""), (901, None, None, None, None, ""), (902, "", "en", "s0", 0, ""), (0, *rows[0][1:])]
    labels = [(i, 0 if i % 8 == 7 else 1, 0) for i in range(400) if i % 5]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, clean


def assert_language(before, kept):
    """The rows that stay are those that a plain version of the fusion names."""
    rows = before.collect()
    model = language.train(before, "text", "lang")
    evidence = [(i, language.likelihoods((r.text or "").encode(), model), r.lang, None, r.source, r.source) for i, r in enumerate(rows)]
    named = {i for i, name, _ in brute_fuse(evidence) if name != "und"}
    assert Counter(map(str, kept.collect())) == Counter(str(r) for i, r in enumerate(rows) if i in named)


def assert_mix(before, kept):
    """Each source's words come near its target, no row stays more than twice, none is new."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    rows, out = before.collect(), kept.collect()
    total, largest, got = Counter(), Counter(), Counter()
    for r in rows:
        total[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in out:
        got[r.source] += size(r)
    for source, target in expected_targets(dict(total)).items():
        assert abs(got[source] - target) <= 2 * largest[source]
    had, has = Counter(map(str, rows)), Counter(map(str, out))
    assert all(has[r] <= 2 * had[r] for r in has) and all(has[str(r)] == had[str(r)] for r in rows if not size(r))


def test_stages(spark, world):
    path, rows, clean = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["quality", "language", "near_duplicates", "mix", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, path).cache()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        if name == "quality":
            assert clean <= ids and not {i for i in range(400) if i % 8 == 7} & ids
        elif name == "language":
            assert clean <= ids and 901 not in ids
            assert_language(before, kept)
        elif name == "mix":
            assert_mix(before, kept)
        elif name == "near_duplicates":
            gone = {i for i in range(400) if i % 8 == 5 and near(rows[i][1], rows[i - 1][1])} | {900}
            assert clean <= ids and not gone & ids
            assert kept.where("doc_id = 0").count() == 1
            alive = [r for r in kept.collect() if r.doc_id is not None and r.text]
            assert not any(near(a.text, b.text) for k, a in enumerate(alive) for b in alive[:k])
    last = corpus_pipeline.STAGES[-1][1](spark, kept, path)
    assert last.count() == kept.count() and last.where("not round_trip").count() == 0


def near(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\S+", t.lower())] for i in range(len(w) - 4)}
    x, y = grams(a), grams(b)
    return bool(x & y) and 100 * len(x & y) >= 80 * len(x | y)


def test_run_and_registration(spark, world):
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} == {name.split("_")[0] + "_" for name in QUERIES}
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, world[0])
    assert out.columns == ["doc_id", "n_pieces", "ids", "round_trip"] and out.count() > 300


def test_empty_documents(spark, world):
    path, _, _ = world
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
    assert stages.sized(none) is not None


def test_stages_by_shuffling(spark, world, monkeypatch):
    path, _, _ = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.toDF(*docs.columns[:-1], "rejected_key").withColumnRenamed("n_chars", "n.chars")
    for stage in (stages.language, stages.near_duplicates):
        sent = stage(spark, docs, path)
        assert sent.columns == docs.columns
        rows = sorted(map(str, sent.collect()))
        with monkeypatch.context() as m:
            m.setattr(stages, "BROADCAST_ROWS", -1)
            assert sorted(map(str, stage(spark, docs, path).collect())) == rows

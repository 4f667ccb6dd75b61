import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        words = ["".join(rng.choice(["on", "ti", "re", "the", "and", "er"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            words = [words[0]] * len(words) if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w + rng.choice(["$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words), "en", f"src{rng.randrange(5)}", len(" ".join(words)), "x"))
        truth[i] = int(good)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, truth[i], 0) for i in truth if i % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    unseen = [i for i in truth if not i % 2]
    assert np.mean([(got[i].score >= 0.5) == truth[i] for i in unseen]) > 0.97
    assert all(got[i].score >= 0.5 for i in unseen if truth[i])
    assert all(0 <= s <= 1 for r in got.values() for s in (r.text_score, r.meta_score, r.score))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.5}


def labels_of(spark, truth):
    return spark.createDataFrame([(i, truth[i], 0) for i in truth if i % 2], "doc_id long, quality int, toxic int")


def test_both_views_give_and_take_labels(spark):
    rows, truth = corpus()
    labels = labels_of(spark, truth)
    taught = lambda rows: quality.co_train(quality.featured(spark.createDataFrame(rows, SCHEMA), labels, "doc_id", "text")).taught
    plain = taught([(i, t, lang, s, None, x) for i, t, lang, s, _, x in rows])
    telling = taught([(i, t, lang, f"src{truth[i]}", None, x) for i, t, lang, _, _, x in rows])
    for rounds in (plain, telling):
        assert len(rounds) == quality.ROUNDS
        assert all(view["good"] > 0 and view["used"] > 0 for r in rounds for view in r)
    assert all(text["bad"] > 0 for text, _ in plain) and all(meta["bad"] > 0 for _, meta in telling)
    # sources that tell of quality weigh more than those that say nothing
    weights = [np.mean([meta["weight_bad"] for _, meta in rounds]) for rounds in (plain, telling)]
    assert weights[0] < 0.3 < 0.5 < weights[1]


@pytest.mark.parametrize("table", ["made", "sf0.01"])
def test_exchange_on_the_test_tables(spark, table):
    if table == "made":
        rows, truth = corpus(900, 5)
        docs, labels = spark.createDataFrame(rows, SCHEMA), labels_of(spark, truth)
    else:
        docs, labels = (spark.read.parquet(f"/root/testdata/{table}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_scores(docs, labels).select("text_taught", "meta_taught").distinct().collect()
    assert len(out) == 1 and out[0].text_taught > 0 and out[0].meta_taught > 0


def fitted(x, y, w):
    """Weighted ridge logistic regression by plain gradient steps of Newton's kind."""
    mean = (w[:, None] * x).sum(0) / w.sum()
    scale = np.maximum(np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum()), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    ridge = np.r_[np.ones(z.shape[1] - 1), 1e-6]
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve(z.T @ np.diag(w * p * (1 - p) + 1e-9) @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * b)
    return lambda v: np.clip((v - mean) / scale, -12, 12) @ b[:-1] + b[-1]


def test_equals_brute_force(spark):
    rows, truth = corpus(500, 9)
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(3), labels_of(spark, truth)
    features = quality.save(quality.featured(docs, labels, "doc_id", "text"), "features")
    held = {r.doc_id for r in features.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(10)) < 3).select("doc_id").collect()}
    views = [quality.text_features([r[1].encode() for r in rows]), quality.meta_features([r[3] for r in rows], [r[2] for r in rows], [r[4] for r in rows], [r[1].encode() for r in rows])]
    views = [v.astype(float) for v in views]
    known = np.array([r[0] % 2 == 1 for r in rows])
    out = np.array([r[0] in held for r in rows]) & known
    own, y = known & ~out, np.array([truth[r[0]] for r in rows], float)
    models = [fitted(v[own], y[own], np.ones(own.sum())) for v in views]
    for _ in range(quality.ROUNDS):
        given = []
        for model, v in zip(models, views):
            odds, base = model(v[out]), y[out].mean()
            high, low = np.quantile(odds, 1 - 0.3 * base), np.quantile(odds, 0.3 * (1 - base))
            good = ((y[out][odds >= high]).sum() + 10 * base) / ((odds >= high).sum() + 10)
            bad = ((1 - y[out][odds <= low]).sum() + 10 * (1 - base)) / ((odds <= low).sum() + 10)
            weights = max(0.02, (good - base) / (1 - base)), max(0.02, (bad - 1 + base) / base)
            free = model(v[~known])
            up, down = free >= high, (free <= low) & (free < high)
            given.append((np.r_[np.flatnonzero(~known)[up], np.flatnonzero(~known)[down]], np.r_[np.ones(up.sum()), np.zeros(down.sum())], np.r_[np.full(up.sum(), weights[0]), np.full(down.sum(), weights[1])]))
        models = [fitted(np.vstack([v[own], v[at]]), np.r_[y[own], label], np.r_[np.ones(own.sum()), weight]) for v, (at, label, weight) in zip(views, given[::-1])]
    got = quality.co_train(features)
    for model, mine, v in zip(got.views, models, views):
        assert np.allclose(model.odds(v), mine(v), atol=1e-3)


def test_edges(spark):
    rows = [(None, None, None, None, None, ""), (1, "", "en", "s", 0, ""), (1, "", "en", "s", 0, ""), (2, "word " * 200_000, "en", "s", -5, ""), (3, "\0\x7fé", "", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [1.0] * 5
    one_kind = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, one_kind).count() == 5
    assert quality.quality_scores(docs.limit(0), one_kind).count() == 0 and quality.keep_good(docs.limit(0), one_kind).count() == 0
    two = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 0)] * 5, "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, two)
    assert out.count() == 5 and out.where("doc_id = 1").select("score").distinct().count() == 1
    assert quality.featured(docs, two, "doc_id", "text").where("doc_id = 1").select(F.max("label")).first()[0] == 0.0


def test_column_names(spark):
    rows, truth = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("key"), F.lit(3).alias("has"), F.lit("`").alias("c`d"))
    kept = quality.keep_good(docs, labels_of(spark, truth))
    assert kept.columns == docs.columns and {tuple(r)[6:] for r in kept.collect()} == {(1, 2, 3, "`")}
    null_ids = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.keep_good(null_ids, labels_of(spark, truth)).count() == 200

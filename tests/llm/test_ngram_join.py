import random
import re
from itertools import combinations

import numpy as np
import pytest

from quillspark.llm import ngram_join
from quillspark.llm.words import Words


def brute(rows, width, percent):
    """rows: (doc_id, text). {doc_id: (size, component, links)}; ids must differ."""
    sets, up, links = {}, {}, {}
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        up[doc_id], links[doc_id] = doc_id, 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d), links[d]) for d, s in sets.items()}


def corpus(seed, n, words):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(["x", "New", f"r{i}"])
        else:
            w = [f"w{rng.randrange(500)}" for _ in range(rng.choice(words))]
            if rng.random() < 0.5:
                w += passage
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("width", "percent", "words"), [(3, 90, [1, 2, 3, 11, 12, 13, 60, 300]), (5, 80, [4, 5, 8, 9, 10, 40, 200])])
def test_equals_brute_force(spark, width, percent, words, monkeypatch):
    rows = corpus(width, 260, words) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Same WORDS"), (1004, "same\twords")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_classes(df, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_split_groups_and_no_broadcast(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(60)]
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 700)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == brute(rows, 3, 90)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d"), (4, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, ngram_join.jaccard_classes(df).collect())))
    assert got == sorted(map(str, [(None, 2, None, 0), (None, 0, None, 0), (5, 2, 5, 1), (5, 2, 5, 1), (4, 3, 4, 0)]))
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for size in [4, 5, 6, 9, 10, 11, 23, 24, 25, 100, 101, 400, 401]:
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                gone = ngram_join.differ(len(a), percent)
                cut = rng.integers(0, gone + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 1 << 63, rng.integers(0, gone - cut + 1)).astype(np.uint64)]))
                met = len(np.intersect1d(a, b))
                if 100 * met >= percent * (len(a) + len(b) - met) and not np.array_equal(a, b):
                    met = [len(np.intersect1d(x, y)) >= max(n, m) for x, n in ngram_join.signatures(a, percent) for y, m in ngram_join.signatures(b, percent)]
                    assert any(met)


def test_word_hashes_tell_words_apart():
    words = Words([b"a bb\tccc", b"", b"  eight888 nine99999 a-very-long-word-of-many-bytes\n a", b"bb"])
    assert [words.word(i) for i in range(len(words))] == [b"a", b"bb", b"ccc", b"eight888", b"nine99999", b"a-very-long-word-of-many-bytes", b"a", b"bb"]
    h = words.hashes().tolist()
    assert h[0] == h[6] and h[1] == h[7] and len(set(h)) == 6
    assert words.first.tolist() == [0, 3, 3, 7, 8]


def near_copies(n, size=60):
    base = [f"w{i}" for i in range(size)]
    return [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(n)]


def test_visitors_are_dealt_to_copies_of_groups(spark, monkeypatch):
    rows = near_copies(70) + [(100 + i, t + " more") for i, t in near_copies(30)] + [(200, "w0 " * 3), (3, "w1 w2")]
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "VISIT_TOKENS", 300)
    df = spark.createDataFrame(rows[:-1], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == brute(rows[:-1], 3, 90)


def test_rows_out_of_groups_grow_with_near_copies_not_links(spark, monkeypatch):
    """Ten times the near copies: a hundred times the links, about ten times the rows."""
    out, plain = {}, ngram_join.save

    def spied(df, name):
        out[name] = plain(df, name)
        return out[name]

    monkeypatch.setattr(ngram_join, "save", spied)
    found = []
    for n in (40, 400):
        got = ngram_join.jaccard_classes(spark.createDataFrame(near_copies(n), "doc_id long, text string")).collect()
        assert all((r.component_id, r.n_links) == (0, n - 1) for r in got)
        found.append(out["found"].count())
    assert found[1] <= 11 * found[0] and found[1] <= 3 * 400


def test_tables_are_deleted_and_names_are_free(spark, monkeypatch):
    import os

    made, plain = [], ngram_join.save

    def spied(df, name):
        made.append((name, (out := plain(df, name))._quill_path.removeprefix("file://").removeprefix("file:")))
        return out

    monkeypatch.setattr(ngram_join, "save", spied)
    rows = [(i, t, 1, 2, 3) for i, t in near_copies(20)] + [(50, "é " * 300_000, 1, 2, 3), (51, "é " * 299_999, 1, 2, 3)]
    df = spark.createDataFrame(rows, "`doc.id` long, `te``xt` string, rep int, home int, part int")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(df, "doc.id", "te`xt").collect()}
    assert got == {**dict.fromkeys(range(20), 0), 50: 50, 51: 50}
    assert {name for name, path in made if os.path.exists(path)} <= {"sets", "classes", "found", "small"}


def test_parts_of_very_many_classes(spark, monkeypatch):
    """Parts that the sample shows to be frequent are counted apart, with the same result."""
    rows = near_copies(80) + [(100 + i, f"other words number {i} " * 4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows, 3, 90)
    for sampled, hot in ((1, 1), (4, 2), (64, 8)):
        monkeypatch.setattr(ngram_join, "SAMPLED", sampled)
        monkeypatch.setattr(ngram_join, "HOT", hot)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()} == expected

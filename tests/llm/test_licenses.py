import random
import re

from quillspark.llm import licenses


def brute_base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


TEXTS = [
    "", None, "Released under the MIT License.", "licensed under CC BY-NC 4.0. All Rights Reserved.", "cc by cc by cc-by é cc  by", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0 (the x)", "general public\nlicense", "all rights, reserved all rights all rights reserved", "the license of the version 2 is open", "Mit License", "word " * 50_000 + "all rights reserved",
]


def test_base_equals_brute_force(spark):
    rng = random.Random(3)
    pool = ["cc", "by", "CC", "by-cc", "all", "rights", "reserved", "general", "public", "license", "x,", "é", "12"]
    texts = TEXTS + [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "cc by", ""), (1, "cc by", "")], "doc_id long, text string, labels string").repartition(4)
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None or (r.doc_id == 1 and r.n_words):
            assert r.n_base == 1
            continue
        n, places = brute_base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places)), texts[r.doc_id]
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_notices(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    assert got[2] == ("mit", 1.0) and got[3][0] == "cc-by,cc-by-nc-4.0,reserved" and got[5][0] == "gpl,gpl-3.0" and got[6][0] == "apache-2.0"
    assert got[0] == ("", 0.0) and got[1] == ("", 0.0) and got[9] == ("", 0.0) and got[10] == ("", 0.0)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_a_changed_notice_still_covers(spark):
    text = "Redistribution and use in source and binary forms, with or without modification, are allowed provided that the following conditions are met"
    index = licenses.Index(1000, {b"and": 900, b"the": 900, b"in": 800})
    found = index.places(licenses.words_of(text.encode()))
    assert [(index.templates[n].label, s) for n, s, _ in found] == [("bsd", 0)] and 0.75 <= found[0][2] < 1


def test_every_place_that_covers_enough_is_found():
    rng = random.Random(4)
    counts = {w: rng.choice([0, 3, 30, 300, 900]) for t in licenses.TEMPLATES for w in t.words}
    indexes = [licenses.Index(1000, counts), licenses.Index(1000, {}), licenses.Index(0, {})]
    found = 0
    for index in indexes:
        for number, t in enumerate(index.templates):
            if t.base:
                continue
            weights, order = index.weights[number], list(range(len(t.words)))
            rare = sorted(order, key=lambda i: -weights[i])
            for trial in range(60):
                rng.shuffle(order)
                words, left = list(t.words), 0.25 * sum(weights)
                for i in rare if trial == 0 else order:  # words are lacking as long as enough is covered
                    if weights[i] <= left:
                        words[i], left = b"zzz", left - weights[i]
                if all(licenses._holds(words, p) for p in t.phrases):
                    found += 1
                    assert (number, 0) in {(n, s) for n, s, _ in index.places(words)}, (t.label, words)
    assert found > 200


def test_a_file_looks_up_its_rarest_words():
    counts = {w: 900 for w in (b"the", b"and", b"of", b"to", b"license", b"software", b"public", b"by")}
    index = licenses.Index(1000, counts)
    for number, t in enumerate(index.templates):
        present = set(t.words)
        possible = index.possible(present)
        assert number in possible
        chosen, needed = index.looked_up(present, possible)
        assert chosen <= present and len(chosen) < max(4, len(present))
        assert min(index.idf[w] for w in chosen) >= max((index.idf[w] for w in present - chosen if any(w in index.held[n] for n in possible)), default=0) or len(possible) > 1
        assert needed[number] >= 1
    assert index.possible({b"the", b"license", b"of"}) == []


def test_whole_texts(spark):
    whole = {label: text for label, text, _ in licenses.WHOLE}
    made = [(i, "Copyright 2020 someone\n\n" + text.replace("warranty", "warranties") + "\n x") for i, text in enumerate(whole.values())]
    made += [(100, whole["mit"] + "\n" + whole["zlib"]), (101, whole["mit"][:300]), (102, " ".join(reversed(whole["isc"].split())))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, label in enumerate(whole):
        assert label in got[i].labels.split(","), (label, got[i].labels)
    assert {"mit", "zlib"} <= set(got[100].labels.split(",")) and "zlib" not in got[101].labels and got[102].labels == ""
    assert got[3].labels.split(",") == ["bsd", "bsd-2-clause"] and "bsd-2-clause" not in got[4].labels.split(",")


def test_places_equal_a_search_without_index():
    rng = random.Random(11)
    counts = {w: rng.choice([0, 5, 500]) for t in licenses.TEMPLATES for w in t.words}
    index = licenses.Index(600, counts)
    for trial in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            t = list(rng.choice(index.templates).words)
            for _ in range(rng.randrange(1 + len(t) // 6)):
                t[rng.randrange(len(t))] = rng.choice([b"zzz", b"the", t[0]])
            words += [b"x"] * rng.randrange(5) + t[rng.randrange(3) :]
        slow = set()
        for number, t in enumerate(index.templates):
            for start in range(-len(t.words), len(words) + 1):
                met = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)]
                cover = sum(w for w, m in zip(index.weights[number], met) if m) / sum(index.weights[number])
                window = words[max(0, start) : start + len(t.words)]
                if (all(met) if t.base else cover >= licenses.COVER and all(licenses._holds(window, p) for p in t.phrases)):
                    slow.add((number, start))
        assert {(n, s) for n, s, _ in index.places(words)} == slow

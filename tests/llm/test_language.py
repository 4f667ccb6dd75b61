import math
import random

import numpy as np

from quillspark.llm import language

WORDS = {"de": "und der die nicht einen schlich keit ung wird über".split(), "en": "and the that with thing ation ble would have".split(), "es": "que los una ción para señor está muy aquí".split(), "fr": "les des une est pour été où très ment vous".split()}


def text_in(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(spark, n=200):
    rng = random.Random(1)
    rows = [(i, text_in(rng, lang), lang, f"s{i % 3}") for i in range(n) for lang in [language.LANGUAGES[i % 4]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_counts_equal_brute_force(spark):
    docs = documents(spark, 40)
    counts = np.full((4, language.BUCKETS), 0.5)
    for r in docs.collect():
        counts[language.LANGUAGES.index(r.lang)] += language.trigrams(r.text.encode())
    assert np.allclose(language.train(docs, "text", "lang"), np.log(counts / counts.sum(axis=1, keepdims=True)))


def test_pages(spark):
    rng = random.Random(2)
    model = language.train(documents(spark), "text", "lang")
    rows, truth = [], {}
    for i in range(120):
        lang = language.LANGUAGES[i % 4]
        declared = lang if i % 10 else "en"  # some pages declare the wrong language
        rows.append((i, f"https://h{i % 4}.site{i % 2}.com/{lang}/{i}", f'<html lang="{declared}"><script>the and that</script><p>{text_in(rng, lang)}</p></html>', "clash"))
        truth[i] = lang
    rows += [(500, None, None, ""), (501, "", "<html><p></p>", ""), (502, "http://x.de/1", '<html lang="de"></html>', ""), (None, "http://x.fr/", f"<p>{text_in(rng, 'fr')}", ""), (503, "bad", "<html lang=xx>" + text_in(rng, "es"), ""), (503, "bad", "<html lang=xx>" + text_in(random.Random(9), "es"), "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, language string").repartition(4)
    got = {}
    for r in language.fuse(language.page_evidence(df, model)).collect():
        got.setdefault(r.id, []).append(r)
    assert np.mean([got[i][0].language == truth[i] for i in truth]) == 1.0
    assert got[500][0].language == "und" and got[501][0].language == "und" and got[502][0].language == "de"
    assert got[None][0].language == "fr" and [r.language for r in got[503]] == ["es", "es"]
    assert all(0 < r.posterior <= 1 for rs in got.values() for r in rs)
    assert language.fuse(language.page_evidence(df.limit(0), model)).count() == 0


def test_posterior_equals_formula(spark):
    """Two hosts under one domain, no other evidence: smoothing by hand."""
    rows = [(i, [0.0, -9.0, -9.0, -9.0], None, None, "a.x.com", "x.com") for i in range(30)] + [(100 + i, [-9.0, 0.0, -9.0, -9.0], None, None, "b.x.com", "x.com") for i in range(10)] + [(200, None, None, None, "b.x.com", "x.com")]
    df = spark.createDataFrame(rows, language.EVIDENCE_SCHEMA)
    r = {x.id: x for x in language.fuse(df, floor=0.0).collect()}[200]
    k = language.STRENGTH
    top = [31 / 44, 11 / 44, 1 / 44, 1 / 44]
    domain = [(n + k * p) / (40 + k) for n, p in zip([30, 10, 0, 0], top)]
    host = [(n + k * p) / (10 + k) for n, p in zip([0, 10, 0, 0], domain)]
    assert math.isclose(r.posterior, max(host) / sum(host), rel_tol=1e-9)
    assert r.language == language.LANGUAGES[host.index(max(host))]


def test_addresses():
    assert language.address_of("https://u@Blog.Example.co.uk:8/de/x") == ("de", "blog.example.co.uk", "co.uk")
    assert language.address_of("http://a.fr/about") == ("fr", "a.fr", "a.fr")
    assert language.address_of("http://a.com") == (None, "a.com", "a.com") and language.address_of(None) == (None, None, None)


def test_pages_are_read_by_one_scan():
    import re
    import time

    plain = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    cases = [b"", b"a<b", b"<p>x</p>", b"a<script x>var '<p>'</script >b<style>q", b"<!-- a > b -->c<!-- never", b"<scripts>x</scripts>", b"<SCRIPT>x</script>y<!---->z", b"1 < 2 > 3 <", b"<style>a</script></style>b<script>c", b"<<p>>", b"<!-->x-->y"]
    for case in cases:
        assert language.visible(case) == plain.sub(b" ", case), case
    start = time.time()
    for part in (b"<script ", b"<script>", b"<!-- ", b"<", b"<style></script>", b"<html ", b"<html lang", b"</", b"<a>"):
        hostile = part * (4_000_000 // len(part))
        language.visible(hostile)
        language.declared_language(hostile)
    assert time.time() - start < 30
    assert language.declared_language(b"<HTML><html class=x lang='pt-BR'>") == "pt-BR" and language.declared_language(b"<htmlx lang=de><html lang=fr") == "fr"
    assert language.declared_language(b"<p lang=de>") is None


def brute_fuse(rows, floor=0.5):
    """rows: id, ll, declared, address, host, domain. All evidence by plain sums and products."""
    langs = list(language.LANGUAGES)

    def value(v):
        v = (v or "").strip().split("-")[0].split("_")[0].lower()
        return None if not v else v if v in langs else "other"

    votes = [langs[max(range(4), key=lambda i: (r[1][i], -i))] if r[1] else None for r in rows]
    overall = {lang: votes.count(lang) for lang in langs}
    n = sum(overall.values())
    top = [(overall[lang] + 1) / (n + 4) for lang in langs]

    def reliability(column):
        seen = [(value(r[column]), v) for r, v in zip(rows, votes) if v and value(r[column])]
        return {x: [(seen.count((x, lang)) + (2.0 if x == lang else 0.5)) / (sum(v == lang for _, v in seen) + 0.5 * 5 + 1.5) for lang in langs] for x in [*langs, "other"]}

    declared, address, out = reliability(2), reliability(3), []
    for r, vote in zip(rows, votes):
        at = lambda column, key: [sum(v == lang for s, v in zip(rows, votes) if v and s[column] == key and s[4] is not None) - (vote == lang) if key is not None or column == 5 else 0 for lang in langs]  # noqa: E731, B023
        host = at(4, r[4]) if r[4] is not None else [0] * 4
        domain = at(5, r[5]) if r[4] is not None else [0] * 4
        host, domain = [max(x, 0) for x in host], [max(x, 0) for x in domain]
        k = language.STRENGTH
        p = [(x + k * t) / (sum(domain) + k) for x, t in zip(domain, top)]
        p = [(x + k * t) / (sum(host) + k) for x, t in zip(host, p)]
        w = [math.log(a) + (r[1][i] if r[1] else 0) + (math.log(declared[value(r[2])][i]) if value(r[2]) else 0) + (math.log(address[value(r[3])][i]) if value(r[3]) else 0) for i, a in enumerate(p)]
        mass = sum(math.exp(x - max(w)) for x in w)
        silent = not r[1] and not value(r[2]) and not value(r[3]) and sum(domain) == 0
        out.append((r[0], "und" if 1 / mass < floor or silent else langs[w.index(max(w))], 1 / mass))
    return out


def test_fuse_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        ll = None if rng.random() < 0.2 else [round(-3 * rng.random(), 3) for _ in range(4)]
        host = None if rng.random() < 0.1 else f"h{rng.randrange(6)}.d{rng.randrange(3)}.com"
        rows.append((i, ll, rng.choice([None, "", "de", "EN-us", "fr_FR", "pt", " es "]), rng.choice([None, "de", "en", "es", "fr"]), host, host and host.partition(".")[2]))
    got = {r.id: (r.language, r.posterior) for r in language.fuse(spark.createDataFrame(rows, language.EVIDENCE_SCHEMA)).collect()}
    for i, name, posterior in brute_fuse(rows):
        assert math.isclose(got[i][1], posterior, rel_tol=1e-9), i
        assert got[i][0] == name

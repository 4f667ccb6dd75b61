import random
from datetime import date, timedelta

from quillspark.llm import url_lists

DAY = date(2024, 1, 1)


def brute(captures, entries):
    out = {}
    for i, url, at in captures:
        rest = url.split("://", 1)[1] if url and "://" in url and url.split("://", 1)[0].isalnum() else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower().rstrip(".") or None
        decided = None
        if host and at:
            labels = host.split(".")
            for k in range(len(labels)):
                domain = ".".join(labels[k:])
                past = sorted((s, a) for d, s, a in entries if d == domain and s <= at)
                if past:
                    last = min(a for s, a in past if s == past[-1][0])
                    decided = (domain, past[-1][0], last)
                    break
        out[i] = (host, bool(decided and decided[2] == "block"), decided[0] if decided else None, decided[1] if decided else None)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "deep.very.x.org"]
    entries = [(rng.choice(hosts + ["com", "org"]), DAY + timedelta(rng.randrange(60)), rng.choice(["block", "clear"])) for _ in range(40)]
    urls = [f"https://{h}/p" for h in hosts] + ["http://u:p@A.Example.com:80/?q", "http://x.org.", "no url", "http:///x", "", None, "ftp://other.net#f"]
    captures = [(i, rng.choice(urls), rng.choice([None, *[DAY + timedelta(rng.randrange(-5, 70)) for _ in range(9)]])) for i in range(400)]
    c = spark.createDataFrame([(*x, "clash") for x in captures], "page_id long, url string, fetched date, host string")
    e = spark.createDataFrame([*entries, (None, DAY, "block"), ("x.org", None, "block")], "domain string, since date, action string")
    got = {r.id: (r.host, r.blocked, r.by_domain, r.since) for r in url_lists.evaluate(c, e, "page_id", "url", "fetched").collect()}
    assert got == brute(captures, entries)
    assert url_lists.evaluate(c.limit(0), e, "page_id", "url", "fetched").count() == 0
    assert not any(r.blocked for r in url_lists.evaluate(c, e.limit(0), "page_id", "url", "fetched").collect())


def test_repeated_rows_and_null_ids(spark):
    c = spark.createDataFrame([(1, "http://x.org/", DAY), (1, "http://x.org/", DAY), (None, "http://x.org/", DAY)], "page_id long, url string, fetched date")
    e = spark.createDataFrame([("X.org", DAY, "block"), ("X.org", DAY, "clear")], "domain string, since date, action string")
    assert [r.blocked for r in url_lists.evaluate(c, e, "page_id", "url", "fetched").collect()] == [True] * 3


def test_names_of_entries_agree_in_any_case(spark):
    c = spark.createDataFrame([(1, "http://example.net/", DAY + timedelta(40)), (2, "http://example.net/", DAY)], "page_id long, url string, fetched date")
    e = spark.createDataFrame([("Example.net", DAY, "block"), ("example.net.", DAY + timedelta(31), "clear")], "domain string, since date, action string")
    spans = {r.since: r.until for r in url_lists.intervals(e).collect()}
    assert spans == {DAY: DAY + timedelta(31), DAY + timedelta(31): None}
    assert {r.id: r.blocked for r in url_lists.evaluate(c, e, "page_id", "url", "fetched").collect()} == {1: False, 2: True}


def test_hot_domains_are_dealt_out(spark):
    """One suffix holds every capture; its probes go to several parts, with the same result."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    captures = [(i, f"http://h{rng.randrange(40)}.com/", DAY + timedelta(rng.randrange(60))) for i in range(600)]
    entries = [("com", DAY + timedelta(d), a) for d, a in ((3, "block"), (9, "clear"), (30, "block"))] + [(f"h{i}.com", DAY + timedelta(rng.randrange(60)), rng.choice(["block", "clear"])) for i in range(20)]
    c = spark.createDataFrame([(*x, 1, 2) for x in captures], "page_id long, `ur.l` string, fetched date, domain int, part int")
    e = spark.createDataFrame(entries, "domain string, since date, action string")
    expected = brute(captures, entries)
    for parts in (1, 4, 500):
        got = {r.id: (r.host, r.blocked, r.by_domain, r.since) for r in url_lists.evaluate(c, e, "page_id", "ur.l", "fetched", parts).collect()}
        assert got == expected
    probes = c.select(F.lit("com").alias("domain"), F.col("fetched").alias("at"), "page_id")
    met = url_lists.as_of(probes, url_lists.intervals(e), 8)
    assert met.count() == sum(at >= DAY + timedelta(3) for _, _, at in captures)


def test_times_of_day(spark):
    from datetime import datetime

    c = spark.createDataFrame([(1, "http://a.x.org", datetime(2024, 1, 2, 12)), (2, "http://a.x.org", datetime(2024, 1, 1, 1))], "page_id long, url string, fetched timestamp")
    e = spark.createDataFrame([("x.org", DAY + timedelta(1), "block")], "domain string, since date, action string")
    assert {r.id: r.blocked for r in url_lists.evaluate(c, e, "page_id", "url", "fetched").collect()} == {1: True, 2: False}

"""URL filters by a temporal list join, in DataFrame terms.

A list is a table of dated entries: domain, since, action (``block`` or ``clear``). The
entries of a domain become validity intervals [since, until): each holds until the next.
A capture (url, fetch time) is evaluated against the entries of its host and of every
parent domain that are active at fetch time; the most specific domain decides.

Hosts repeat far more than lists do, so captures are first reduced to distinct (host,
time) pairs, with partial aggregation before the shuffle. Of a pair's domains only those
that the list holds go on, as probes. The as-of join is one running window: per domain
probes and intervals are put in order of time, and each probe takes the last interval
begun. A domain with more than 1 / ``PARTS`` of all probes (a country suffix, a large
host) is dealt to several parts by a hash of the probe, each with all of its intervals;
there are at most ``PARTS`` such domains, so sending their names to all is bounded.

Defined results: a null url, one without a host or a null fetch time is never blocked;
of several entries of a domain at one time the block holds; hosts and listed domains are
compared in lower case without port, user or final dot, and entries that agree then
are of one domain; entries without domain or time are left out; a capture before the first
entry of a domain meets none of it; repeated captures each give a row; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, save

PARTS = 500
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def domain_of(name: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(name), F.lit(".")), F.lit(""))


def host_of(url: Column) -> Column:
    return domain_of(F.regexp_extract(url, HOST, 1))


def parents(host: Column) -> Column:
    """The host and all its parent domains, longest first, with their label counts."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((n - i + 1).alias("labels"), F.array_join(F.slice(labels, i, n), ".").alias("domain")))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, since, until, action: when each entry holds."""
    named = entries.select(domain_of(F.col("domain")).alias("domain"), "since", "action").where("domain is not null and since is not null")
    # at one time the alphabetically first action, block, stands
    one = named.groupBy("domain", "since").agg(F.min("action").alias("action"))
    return one.withColumn("until", F.lead("since").over(Window.partitionBy("domain").orderBy("since"))).select("domain", "since", "until", "action")


def as_of(probes: DataFrame, spans: DataFrame, parts: int = PARTS) -> DataFrame:
    """probes: domain, at and others. Adds ``entry``: the interval of the domain (since,
    until, action) that holds at that time; probes without one are left out."""
    counts = probes.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most ``parts`` domains have more than their share of all probes
    hot = F.broadcast(counts.where(F.col("n") * parts > total).select("domain", F.ceil(F.col("n") * parts / F.lit(max(total, 1))).alias("dealt")))
    rest = [c for c in probes.columns if c not in ("domain", "at")]
    kind = probes.schema["at"].dataType
    asked = probes.join(hot, "domain", "left").select("domain", F.pmod(F.xxhash64("at", *rest), F.coalesce("dealt", F.lit(1))).alias("part"), "at", F.lit(1).alias("late"), F.struct(*rest).alias("probe"), F.lit(None).cast("struct<since:{0},until:{0},action:string>".format(kind.simpleString())).alias("entry"))
    times = [F.col(c).cast(kind).alias(c) for c in ("since", "until")]
    held = spans.join(hot, "domain", "left").select("domain", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("dealt", F.lit(1)) - 1)).alias("part"), F.col("since").cast(kind).alias("at"), F.lit(0).alias("late"), F.lit(None).cast(asked.schema["probe"].dataType).alias("probe"), F.struct(*times, "action").alias("entry"))
    before = Window.partitionBy("domain", "part").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(held).withColumn("entry", F.last("entry", ignorenulls=True).over(before)).where("late = 1 and entry is not null")
    return met.select("domain", "at", "probe.*", "entry")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, fetched_col: str, parts: int = PARTS) -> DataFrame:
    """id, host, blocked (boolean), by_domain, since: the entry that decides."""
    seen = captures.select(F.col(quoted(id_col)).alias("id"), host_of(F.col(quoted(url_col))).alias("host"), F.col(quoted(fetched_col)).alias("fetched"))
    pairs = seen.where("host is not null and fetched is not null").groupBy("host", "fetched").agg(F.lit(1).alias("one"))
    spans = save(intervals(entries), "spans")
    probes = pairs.select("host", F.col("fetched").alias("at"), F.explode(parents(F.col("host"))).alias("p")).select("host", "at", "p.labels", "p.domain")
    probes = save(probes.join(spans.select("domain").distinct(), "domain", "left_semi"), "probes")
    met = as_of(probes, spans, parts)
    best = F.max_by(F.struct("domain", "entry"), F.col("labels"))
    decided = met.groupBy("host", "at").agg(best.alias("e")).select("host", F.col("at").alias("fetched"), "e.domain", "e.entry.since", "e.entry.action")
    out = seen.join(decided, ["host", "fetched"], "left")
    return out.select("id", "host", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), F.col("domain").alias("by_domain"), "since")

"""Language identification by Bayesian evidence fusion.

For each text a naive Bayes model over hashed byte trigrams gives log-likelihoods per
language; it is counted over all training documents. Three more kinds of evidence join
it: the language that the markup (or record) declares, the language that the address
suggests (country suffix or language segment), and the prior of the host. How far
declarations and addresses can be trusted is counted over all rows: how often each value
goes with each language of the text. Host priors are smoothed along the hierarchy all
-> domain -> host from grouped counts, leaving out the row's own vote. The posterior is
the normalised product.

Defined results: null and empty texts have no likelihoods and rest on the other
evidence; declared values other than the known languages count as ``other``, null as
absent (no evidence), as does a null address or host; a row's language is ``und`` if no
posterior reaches ``floor`` or if nothing but the overall prior speaks for it; equal
rows get equal results; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, save, tidy

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 4096
EVIDENCE = 60.0  # trigrams follow each other; a text counts as this many at most
STRENGTH = 20.0  # rows that the level above counts for in smoothing
#: Country suffixes and the languages that they suggest.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr"}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # no letter: white space


def trigrams(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams of the folded text; runs without letters are one
    space and say nothing alone."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(20), minlength=BUCKETS)


def train(docs: DataFrame, text_col: str, lang_col: str, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities (language x bucket), counted over all documents whose declared
    language is known. Each task adds up its own; sums of a fixed number of cells meet."""

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    counts[languages.index(lang)] += trigrams(text)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int32()), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["lang", "counts"])

    known = docs.where(F.col(quoted(lang_col)).isin(*languages)).select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text"))
    cells = known.mapInArrow(tidy(run), "lang int, counts array<long>").select("lang", F.posexplode("counts").alias("bucket", "n"))
    counts = np.full((len(languages), BUCKETS), 0.5)
    for lang, bucket, n in cells.groupBy("lang", "bucket").agg(F.sum("n")).collect():  # languages x buckets at most
        counts[lang, bucket] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def likelihoods(text: bytes, model: np.ndarray) -> list[float] | None:
    counts = trigrams(text)
    n = counts.sum()
    if not n or not text:
        return None
    out = model @ counts * (min(n, EVIDENCE) / n)
    return (out - out.max()).tolist()


def _known(value: Column, languages: tuple[str, ...]) -> Column:
    value = F.lower(F.substring_index(F.substring_index(F.trim(value), "-", 1), "_", 1))
    return F.when(value.isin(*languages), value).when(value.isNotNull() & (value != ""), F.lit("other"))


def fuse(evidence: DataFrame, languages: tuple[str, ...] = LANGUAGES, floor: float = 0.5) -> DataFrame:
    """evidence: id, ll (array<double>, null without text), declared, address, host,
    domain. Returns id, language, posterior, text_language."""
    n, codes = len(languages), F.array(*map(F.lit, languages))
    best = F.when(F.col("ll").isNotNull(), F.element_at(codes, F.array_position("ll", F.array_max("ll")).cast("int")))
    rows = save(evidence.withColumn("vote", best).withColumn("declared", _known(F.col("declared"), languages)).withColumn("address", _known(F.col("address"), languages)), "evidence")
    voted = rows.where("vote is not null")

    def table_of(column: str) -> Column:
        """Log P(value | language) as an array per value, from counts over all rows; of a
        fixed number of cells."""
        counts = {(r[0], r.vote): r.n for r in voted.where(F.col(column).isNotNull()).groupBy(column, "vote").agg(F.count(F.lit(1)).alias("n")).collect()}
        values, out = [*languages, "other"], F.lit(None).cast("array<double>")
        total = {lang: sum(counts.get((v, lang), 0) for v in values) for lang in languages}
        for v in values:
            logs = [math.log((counts.get((v, lang), 0) + (2.0 if v == lang else 0.5)) / (total[lang] + 0.5 * len(values) + 1.5)) for lang in languages]
            out = F.when(F.col(column) == v, F.array(*map(F.lit, logs))).otherwise(out)
        return out

    overall = {r.vote: r.n for r in voted.groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect()}
    everywhere = sum(overall.values())
    top = [(overall.get(lang, 0) + 1.0) / (everywhere + n) for lang in languages]
    counted = lambda: [F.count_if(F.col("vote") == lang).cast("double").alias(f"n{i}") for i, lang in enumerate(languages)]
    hosts = voted.where("host is not null").groupBy("domain", "host").agg(*counted())
    domains = hosts.groupBy("domain").agg(*(F.sum(f"n{i}").alias(f"d{i}") for i in range(n)))
    both = hosts.join(domains, hosts["domain"].eqNullSafe(domains["domain"]), "left").drop(domains["domain"])
    priors = both.select(F.col("host").alias("h"), F.array(*(f"n{i}" for i in range(n))).alias("at_host"), F.array(*(f"d{i}" for i in range(n))).alias("at_domain"))
    joined = rows.join(priors, F.col("host") == F.col("h"), "left")

    own = F.array(*(F.coalesce((F.col("vote") == lang).cast("double"), F.lit(0.0)) for lang in languages))
    zeros = F.array(*[F.lit(0.0)] * n)
    less = lambda c: F.zip_with(F.coalesce(c, zeros), own, lambda x, o: F.greatest(x - o, F.lit(0.0)))
    joined = joined.withColumn("at_host", less(F.col("at_host"))).withColumn("at_domain", less(F.col("at_domain")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda c, prior: F.zip_with(c, prior, lambda x, p: (x + STRENGTH * p) / (total(F.col(c)) + STRENGTH))
    joined = joined.withColumn("p_domain", smooth("at_domain", F.array(*map(F.lit, top))))
    joined = joined.withColumn("p_host", smooth("at_host", "p_domain"))
    add = lambda a, b: F.zip_with(a, F.coalesce(b, zeros), lambda x, y: x + y)
    logs = add(add(add(F.transform("p_host", lambda x: F.log(x)), F.col("ll")), table_of("declared")), table_of("address"))
    joined = joined.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    joined = joined.withColumn("mass", F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most"))))
    posterior = 1 / F.col("mass")
    silent = F.col("ll").isNull() & F.col("declared").isNull() & F.col("address").isNull() & (total(F.col("at_domain")) == 0)
    name = F.element_at(codes, F.array_position("logs", F.col("most")).cast("int"))
    return joined.select("id", F.when((posterior < floor) | silent, F.lit("und")).otherwise(name).alias("language"), posterior.alias("posterior"), F.col("vote").alias("text_language"))


# ------------------------------------------------------------------ pages and documents

_HIDDEN = re.compile(rb"<(script|style)\b", re.I)
_CLOSED = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style")}
_ROOT = re.compile(rb"<html\b", re.I)
_LANG = re.compile(rb"\slang\s*=\s*[\"']?([A-Za-z_-]+)", re.I)
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)[^/?#]*(?:/([A-Za-z]{2})(?=[/?#]|$))?")


def visible(html: bytes) -> bytes:
    """The text of a page: scripts and styles with what they hold, comments and tags become
    a space; what is never closed is text, but for the tag that opens a script or style.

    One scan forward: an end that is once not found is not looked for again."""
    out, at, missing = [], 0, set()
    while (opened := html.find(b"<", at)) >= 0:
        out.append(html[at:opened])
        end = -1
        hidden = _HIDDEN.match(html, opened)
        if hidden and (name := hidden[1].lower()) not in missing:
            closed = _CLOSED[name].search(html, hidden.end())
            if closed:
                end = closed.end()
            else:
                missing.add(name)
        elif html.startswith(b"<!--", opened) and b"--" not in missing:
            end = html.find(b"-->", opened + 4) + 3
            if end == 2:
                missing.add(b"--")
                end = -1
        if end < 0:
            end = html.find(b">", opened + 1) + 1
            if not end:  # no tag can end any more
                at = opened
                break
        out.append(b" ")
        at = end
    out.append(html[at:])
    return b"".join(out)


def declared_language(html: bytes) -> str | None:
    """What the first ``html`` tag with a language declares; each tag is read once."""
    at = 0
    while root := _ROOT.search(html, at):
        end = html.find(b">", root.end())
        end = len(html) if end < 0 else end
        if found := _LANG.search(html, root.end(), end):
            return found[1].decode()
        at = end
    return None


def address_of(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Suggested language, host and domain (its last two labels) of an address."""
    m = _URL.match(url or "")
    if not m or not m[1]:
        return None, None, None
    host = m[1].lower().rstrip(".")
    return (m[2].lower() if m[2] else SUFFIXES.get(host.rpartition(".")[2])), host, ".".join(host.split(".")[-2:])


EVIDENCE_SCHEMA = "id long, ll array<double>, declared string, address string, host string, domain string"
_EVIDENCE_NAMES = ["id", "ll", "declared", "address", "host", "domain"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.float64()), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_EVIDENCE_NAMES)


def page_evidence(pages: DataFrame, model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                html = html or b""
                rows.append((page_id, likelihoods(visible(html), model), declared_language(html), *address_of(url)))
            yield _batch(rows)

    return pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(html_col)).alias("html")).mapInArrow(tidy(run), EVIDENCE_SCHEMA)


def document_evidence(docs: DataFrame, model: np.ndarray, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Documents declare a language and have a source for a host, but no address."""

    def run(batches):
        for batch in batches:
            ids, texts, langs, sources = (batch.column(i) for i in range(4))
            rows = [(d, likelihoods(t or b"", model), lang, None, s, s) for d, t, lang, s in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), langs.to_pylist(), sources.to_pylist())]
            yield _batch(rows)

    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(source_col)).cast("string").alias("source")).mapInArrow(tidy(run), EVIDENCE_SCHEMA)

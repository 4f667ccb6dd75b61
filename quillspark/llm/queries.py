"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trips

    small_batches(spark)
    return round_trips(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    small_batches(spark)
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec, predictor and layout vary with the text, so every decoder is used."""
    from .tiff import by_text, media_digests

    small_batches(spark)
    return media_digests(table(spark, sf_dir, "documents"), how=by_text)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    small_batches(spark)
    return scan_licenses(table(spark, sf_dir, "documents"))


#: Dated entries for whole registered domains; hosts get theirs by rule, see below.
DOMAIN_ENTRIES = [
    ("example.net", "2024-03-01", "block"),
    ("example.net", "2024-06-01", "clear"),
    ("example.org", "2024-09-01", "block"),
    ("tionsh.example.net", "2024-02-01", "clear"),
    ("tionsh.example.net", "2024-11-15", "block"),
    ("com", "2024-12-20", "block"),
]


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the crawl: of its hosts, the quarter whose md5 starts
    with 0 to 3 is blocked from a day that the md5 gives, for 40 days."""
    from .url_lists import host_of

    spark = pages.sparkSession
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    md5 = F.md5(F.col("domain").cast("binary"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(md5, i, 1)) - 1
    listed = hosts.where(digit(1) < 4).select("domain", F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 16 + digit(3)).alias("since"))
    fixed = spark.createDataFrame(DOMAIN_ENTRIES, "domain string, since string, action string").withColumn("since", F.col("since").cast("date"))
    return listed.withColumn("action", F.lit("block")).unionByName(listed.select("domain", F.date_add("since", 40).alias("since"), F.lit("clear").alias("action"))).unionByName(fixed)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_lists import evaluate

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    out = evaluate(captures, url_list(pages), "page_id", "url", "fetched")
    return out.select(F.col("id").alias("page_id"), "host", "blocked", "by_domain", F.col("since").cast("string").alias("since"))


OP6_SQL = f"""
WITH c AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.'), '') AS host,
         CAST(date '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched
  FROM pages),
h AS (SELECT DISTINCT host AS domain, md5(host) AS m FROM c WHERE host IS NOT NULL),
l AS (
  SELECT domain, CAST(date '2024-01-01' + CAST((strpos('0123456789abcdef', substr(m, 2, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(m, 3, 1)) - 1 AS INTEGER) AS DATE) AS since
  FROM h WHERE substr(m, 1, 1) IN ('0', '1', '2', '3')),
e AS (
  SELECT domain, since, 'block' AS action FROM l
  UNION ALL SELECT domain, CAST(since + 40 AS DATE), 'clear' FROM l
  UNION ALL SELECT domain, CAST(since AS DATE), action FROM (VALUES {", ".join(map(str, DOMAIN_ENTRIES))}) AS v(domain, since, action)),
one AS (SELECT domain, since, min(action) AS action FROM e GROUP BY domain, since),
s AS (SELECT domain, since, action, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM one),
m AS (
  SELECT c.page_id, s.domain, s.since, s.action,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC) AS r
  FROM c JOIN s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.host, coalesce(m.action = 'block', false) AS blocked, m.domain AS by_domain, CAST(m.since AS VARCHAR) AS since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.r = 1
"""


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import encode_and_read

    small_batches(spark)
    return encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    small_batches(spark)
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("keep", F.col("score") >= 0.5)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text model is counted over documents, the evidence over pages."""
    from .language import fuse, page_evidence, train

    small_batches(spark)
    model = train(table(spark, sf_dir, "documents"), "text", "lang")
    return fuse(page_evidence(table(spark, sf_dir, "pages"), model)).withColumnRenamed("id", "page_id")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_ngram_join, op3_source_mix, op4_tiff_media, op5_license_scan, op6_url_filter, op7_nearest_vectors, op8_token_output, op9_quality, op10_language_id)}
SQL: dict[str, str] = {"op6_url_filter": OP6_SQL}

"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, drop, fresh, save, small_batches, table
from .queries import tokenizer_path

#: Lists of keys (one long each) up to this many rows are sent to all executors; longer
#: ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from .quality import keep_good

    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language cannot be told go, equal rows together. The text model is
    counted over these same documents by their declared languages."""
    from .language import document_evidence, fuse, train

    small_batches(spark)
    key = F.xxhash64("doc_id", "text", "lang", "source")
    rows = docs.select(key.alias("id"), "text", "lang", "source")
    evidence = document_evidence(rows, train(docs, "text", "lang"), "id", "text", "lang", "source")
    (name,) = fresh(docs, "rejected_key")
    rejected = save(fuse(evidence).where("language = 'und'").select(F.col("id").alias(name)).distinct(), "rejected")
    return docs.join(sized(rejected), key == rejected[name], "left_anti").select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with equal doc_ids are one document: they stay together, equal ones once.
    Rows without doc_id and texts without words stay."""
    from .ngram_join import jaccard_classes

    small_batches(spark)
    found = save(jaccard_classes(docs, width=5, percent=80), "components")
    gone = save(found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "gone")
    twice = save(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    drop(found)
    kept = docs.join(sized(gone), "doc_id", "left_anti").select(*columns_of(docs))
    if twice.isEmpty():
        return kept
    twice = sized(twice)
    once = kept.join(twice, "doc_id", "left_anti").select(*columns_of(docs))
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").select(*columns_of(docs)).dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of every row of the mix."""
    from .pieces import encode_and_check

    small_batches(spark)
    return encode_and_check(docs, tokenizer_path("piece_bpe_32k.model"))

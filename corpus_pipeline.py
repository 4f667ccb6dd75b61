"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame; all but the last return the columns of ``documents``:

1. quality: documents that the co-trained classifier scores below 0.5 go.
2. language: documents without an identified language go.
3. near_duplicates: of documents that link (five-word shingles, Jaccard 0.8 or more),
   directly or over others, the one with the smallest doc_id stays.
4. mix: sources are mixed to their target weights; a document stays as often as taken.
5. sentencepiece: token ids of every text, and whether they decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages
from quillspark.llm.common import save

STAGES = [
    ("quality", stages.quality),
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("mix", stages.mix),
    ("sentencepiece", stages.sentencepiece),
]

#: A trained classifier and random rounding have no SQL; the tests compare the stages
#: with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

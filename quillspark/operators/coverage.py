"""Which symbols a corpus of test files mentions, and which it does not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path

FILE_CHARS = 200_000


def corpus_of(files: DataFrame, path_col: str = "path", content_col: str = "content", most: int | None = None) -> DataFrame:
    """path and the text of each test file, or its first ``most`` characters
    (``FILE_CHARS`` in the model)."""
    content = F.col(content_col) if most is None else F.substring(content_col, 1, most)
    return files.where(is_test_path(path_col)).select(F.col(path_col).alias("path"), content.alias("content"))


def corpus_words(corpus: DataFrame, content_col: str = "content") -> DataFrame:
    words = F.regexp_extract_all(F.col(content_col), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return corpus.select(F.explode(F.array_distinct(words)).alias("word")).distinct()


def mention_split(symbols: DataFrame, corpus: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """symbols with ``covered``: whether the name stands as a whole word in the corpus.

    A name of word characters is a word of the corpus or not: one equi-join with its
    distinct words. Other names are looked for only in the texts that hold their first
    word, by the pattern of the whole name."""
    names = symbols.select(F.col(name_col).alias("__n")).where("__n is not null").distinct()
    simple = F.col("__n").rlike(r"\A[A-Za-z0-9_]+\z")
    plain = names.where(simple).join(corpus_words(corpus, content_col), F.col("__n") == F.col("word"), "left_semi")
    odd = names.where(~simple).withColumn("first", F.regexp_extract("__n", "[A-Za-z0-9_]+", 0)).where("first <> ''")
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    pattern = F.concat(F.lit(edge), F.regexp_replace("__n", r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(edge))
    texts = corpus.select(F.col(content_col).alias("__text")).withColumn("first", F.explode(F.array_distinct(F.regexp_extract_all("__text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))))
    found = odd.withColumn("__p", pattern).join(texts, "first").where("__text rlike __p").select("__n").distinct()
    mentioned = plain.unionByName(found).withColumn("__hit", F.lit(True))
    return symbols.join(mentioned, F.col(name_col) == F.col("__n"), "left").withColumn("covered", F.coalesce("__hit", F.lit(False))).drop("__n", "__hit")


def test_suite(files: DataFrame) -> DataFrame:
    """files: path, content, refused, as a working tree gives them. The test files: path,
    content (null if refused), refused."""
    return files.where(is_test_path("path")).select("path", F.when(~F.coalesce("refused", F.lit(False)), F.col("content")).alias("content"), F.coalesce("refused", F.lit(False)).alias("refused"))


def suite_coverage(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The summary of symbols against a working tree: refused test files count as files,
    but hold nothing."""
    suite = test_suite(files)
    return _summary(symbols, suite.where("not refused"), suite.agg(F.count(F.lit(1)).alias("t"), F.count_if("refused").alias("r")))


def coverage_summary(symbols: DataFrame, corpus: DataFrame, refused: int = 0) -> DataFrame:
    """One row: has_test_suite, test_files, refused, covered, orphans. Without a suite
    nothing is asked of the symbols."""
    return _summary(symbols, corpus, corpus.agg((F.count(F.lit(1)) + refused).alias("t"), F.lit(refused).cast("long").alias("r")))


def _summary(symbols: DataFrame, corpus: DataFrame, files: DataFrame) -> DataFrame:
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    counts = mention_split(symbols, corpus).agg(F.count_if("covered").alias("c"), F.count_if(~F.col("covered")).alias("o"))
    both = files.select("t", "r", *zero("c", "o")).unionByName(counts.select(*zero("t", "r"), "c", "o"))
    both = both.agg(*(F.sum(c).alias(c) for c in "trco"))
    asked = lambda c: F.when(F.col("t") > 0, F.col(c)).otherwise(0)
    return both.select((F.col("t") > 0).alias("has_test_suite"), F.col("t").alias("test_files"), F.col("r").alias("refused"), asked("c").alias("covered"), asked("o").alias("orphans"))

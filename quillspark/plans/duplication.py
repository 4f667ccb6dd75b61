"""Plan: which symbols a change introduces that repeat others of its tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_excluded_symbol
from ..functions.similarity import CANDIDATES, MIN_TOKENS, THRESHOLD, signature_shape
from ..functions.text import name_tokens, shingles, skeleton_tokens
from ..operators.diff import diff_lines
from ..operators.pairs import find_duplicates, once_per_pair
from ..operators.symbols import introduced, symbol_index, symbols_of_lines
from ..sources.scratch import stored


def features(symbols: DataFrame) -> DataFrame:
    """Adds key, tokens, shape and grams: what pairs are compared by, once per symbol. Bodies of
    fewer than ``MIN_TOKENS`` tokens are too short to tell anything and have no grams."""
    key = F.concat_ws(":", "path", "line", "name")
    out = symbols.withColumn("key", key).withColumn("tokens", F.array_distinct(name_tokens("name"))).withColumn("skeleton", skeleton_tokens("body"))
    grams = F.when(F.size("skeleton") >= MIN_TOKENS, shingles(F.col("skeleton"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("grams", grams).withColumn("shape", signature_shape(F.coalesce("signature", F.lit("")))).drop("skeleton", "body")


def duplication(patches: DataFrame, files: DataFrame, threshold: float = THRESHOLD, k: int = CANDIDATES) -> DataFrame:
    """patches: id, patch. files: path, content of the changed tree. Findings: a, b (keys
    path:line:name), scores, rank, introduced_here."""
    index = stored(symbol_index(files), "index")
    added = symbols_of_lines(diff_lines(patches, "id", "patch")).where("exported")
    new = introduced(added.select("ord", "path", "line", "name"), index).drop("a_ord")
    comparable = lambda df: df.where(~is_excluded_symbol("path", "kind", "name"))
    indexed = stored(features(comparable(index)), "symbols")
    keys = comparable(new).select(F.concat_ws(":", "path", "line", "name").alias("key")).distinct()
    ranked = find_duplicates(indexed.join(keys, "key", "left_semi"), indexed, threshold, k)
    once = once_per_pair(ranked, "a", "b", "score", ["a_ord", "a"])
    here = keys.select(F.col("key").alias("b"), F.lit(True).alias("__h"))
    return once.join(here, "b", "left").withColumn("introduced_here", F.coalesce("__h", F.lit(False))).drop("__h", "a_ord")

"""Lints over a corpus of files: forbidden terms, and whether all files were scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forbidden_terms(files: DataFrame, patterns: list[str], path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, line, pattern of each line that holds a forbidden pattern, case-blind."""
    lines = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(content_col, "\n")).alias("at", "text"))
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(f"(?i){p}"), F.lit(p)) for p in patterns)), lambda p: p.isNotNull())
    return lines.withColumn("pattern", F.explode(hits)).select("path", (F.col("at") + 1).alias("line"), "pattern")


def not_scanned(expected: DataFrame, scanned: DataFrame, path_col: str = "path") -> DataFrame:
    """Files that a scan should have reached and did not."""
    return expected.join(scanned, path_col, "left_anti").select(path_col).distinct()


def pinned_versions(files: DataFrame, pattern: str, major: int, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, line, pin of each pinned version whose major number is another one. The
    pattern's first group is the pin's number."""
    lines = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(content_col, "\n")).alias("at", "text"))
    pins = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pin"))
    return pins.where(F.substring_index(F.regexp_replace("pin", "^v", ""), ".", 1) != str(major))

"""Sinks: verdicts as JSON files, key=value outputs, and comments as a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_verdicts(verdicts: DataFrame, location: str) -> None:
    """One JSON object per line, in a folder per check."""
    verdicts.withColumn("__check", F.col("check")).write.mode("overwrite").partitionBy("__check").json(location)


def output_lines(verdicts: DataFrame) -> DataFrame:
    """key=value lines of each verdict: its status, and whether it blocks."""
    from ..operators.verdicts import is_blocking_failure

    lines = F.array(F.concat(F.lit("status="), "status"), F.concat(F.lit("blocking-failure="), is_blocking_failure("status", "blocking").cast("string")))
    return verdicts.select("check", F.explode(lines).alias("line"))


def publish(actions: DataFrame, send: Callable | None = None) -> DataFrame:
    """Comment actions handed to ``send`` by partitions (rows in, results out); without it
    (a dry run) the bodies that would be sent."""
    if send is None:
        return actions.select("change", "body")
    return actions.mapInPandas(send, actions.schema)

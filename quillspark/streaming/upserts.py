"""Streams of changes and verdicts. The batch operators hold; these keep their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_key(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key so far; run in update or complete mode."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def status_counts(verdicts: DataFrame, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Verdicts per window, check and status; a window is final once its lateness is over."""
    return verdicts.withWatermark(time, late).groupBy(F.window(time, size), "check", "status").agg(F.count(F.lit(1)).alias("n"))


def stream_added_lines(patches: DataFrame, sink, checkpoint: str, id_col: str = "id", patch_col: str = "patch") -> StreamingQuery:
    """Added lines of arriving patches, by micro-batches: ``sink`` gets a DataFrame and
    the number of the batch, which a retry repeats."""
    from ..operators.diff import diff_lines

    return patches.writeStream.foreachBatch(lambda df, n: sink(diff_lines(df, id_col, patch_col), n)).option("checkpointLocation", checkpoint).start()

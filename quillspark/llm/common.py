"""Shared helpers of the training-data operators: tables, scratch space, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, so very long texts cannot fill a worker. Plans
    read the setting when they run, after their function has returned, so it stays; a
    session's own smaller bound stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own
    temporary one where the session names none and runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return _own_dir[0]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage
    ends there, so a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later plan reads."""
    for df in tables:
        spark, path = df.sparkSession, df._quill_path
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list:
    return [F.col(quoted(c)) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed until none is a column of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, filled on demand and emptied when full."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


def tidy(run):
    """The function for mapInArrow that, when its partition ends, hands memory that it no
    longer uses back to the system: workers live on for tasks of other stages."""

    def tidied(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied

"""Sources: working trees, patches, rule files, JSON inputs. Only regular files inside
their root are handed to Spark; links that lead out of it are refused."""

from __future__ import annotations

import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Where rules are looked for, in order.
RULE_SOURCES = [
    ("dir", ".claude/rules", "reglas del proyecto"),
    ("dir", ".cursor/rules", "reglas del editor"),
    ("file", ".cursorrules", "reglas del editor"),
    ("file", ".github/copilot-instructions.md", "instrucciones del asistente"),
    ("file", "CLAUDE.md", "instrucciones del asistente"),
    ("file", "AGENTS.md", "instrucciones del asistente"),
    ("file", "CONTRIBUTING.md", "guía de contribución"),
]


def is_regular_within(path: str | os.PathLike, root: str | os.PathLike) -> bool:
    """Whether a path is a regular file (not a link) really inside a root."""
    try:
        if not stat.S_ISREG(os.lstat(path).st_mode):
            return False
        inner = Path(path).resolve(strict=True).relative_to(Path(root).resolve(strict=True))
    except (OSError, ValueError):
        return False
    return bool(inner.parts)


def tree_files(spark: SparkSession, root: str, paths: list[str] | None = None, most_chars: int | None = None) -> DataFrame:
    """path (inside the root), content, refused. A given listing is guarded on the driver;
    contents are read by the executors, whole files of any size; with ``most_chars``, files
    of more than four bytes for each have no content and count as refused."""
    top = Path(root)
    listed = paths if paths is not None else sorted(str(p.relative_to(top)) for p in top.rglob("*") if ".git" not in p.parts and (p.is_symlink() or p.is_file()))
    good = [p for p in listed if is_regular_within(top / p, top) and (most_chars is None or (top / p).stat().st_size <= 4 * most_chars)]
    kept = set(good)
    refused = spark.createDataFrame([(p, None, True) for p in listed if p not in kept], "path string, content string, refused boolean")
    if not good:
        return refused
    # readers pass over names that start with a dot or an underscore: settings, a few
    hidden = [p for p in good if Path(p).name[0] in "._"]
    own = [(p, (top / p).read_text(errors="replace"), False) for p in hidden]
    out = refused.unionByName(spark.createDataFrame(own, refused.schema))
    if len(hidden) == len(good):
        return out
    prefix = f"file:{top.resolve()}/"
    read = spark.read.text([f"file:{top.resolve() / p}" for p in good if p not in set(hidden)], wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("content"))
    path = F.expr(f"substring(url_decode(replace(at, 'file:///', 'file:/')), {len(prefix) + 1})")
    return read.select(path.alias("path"), "content", F.lit(False).alias("refused")).unionByName(out)


def patches(spark: SparkSession, location: str) -> DataFrame:
    """id and patch of every file of patches in a folder."""
    return spark.read.text(location, wholetext=True, recursiveFileLookup=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("id"), F.col("value").alias("patch"))


def raw_text(path: str | os.PathLike, root: str | os.PathLike) -> str:
    """The text of a file inside a root; a path that leads out of it is refused."""
    if not is_regular_within(path, root):
        raise ValueError(f"{path} is no regular file inside {root}")
    return Path(path).read_text(encoding="utf-8")


def discovered_rules(listing: DataFrame, sources: list[tuple[str, str, str]] = RULE_SOURCES) -> DataFrame:
    """listing: change, path, content, refused. The rule files of each change: change, ord,
    path, origin, body (null if refused), found (its path in the listing). Sources come in
    their order, a folder's files by path; a file that several sources hold counts for the
    first."""
    found = None
    for place, (kind, where, origin) in enumerate(sources):
        inside = F.col("path").startswith(f"{where}/") & F.col("path").rlike(r"(?i)\.(md|mdc|txt)\z") if kind == "dir" else F.col("path") == where
        name = F.expr(f"substring(path, {len(where) + 2})") if kind == "dir" else F.col("path")
        part = listing.where(inside).select("change", F.lit(place).alias("place"), name.alias("name"), F.lit(origin).alias("origin"), "content", "refused", F.col("path").alias("found"))
        found = part if found is None else found.unionByName(part)
    first = Window.partitionBy("change", "found").orderBy("place")
    once = found.withColumn("r", F.row_number().over(first)).where("r = 1")
    ord_ = F.row_number().over(Window.partitionBy("change").orderBy("place", "found")) - 1
    body = F.when(~F.coalesce("refused", F.lit(False)), F.regexp_replace("content", r"(?U)\A\s+|\s+\z", ""))
    return once.select("change", ord_.alias("ord"), F.col("name").alias("path"), "origin", body.alias("body"), "found")


def rule_files(spark: SparkSession, root: str, change: str = "") -> DataFrame:
    """change, ord, path, origin, body (null if the file is refused): rule files in the
    order of their sources, each once."""
    files = tree_files(spark, root).withColumn("change", F.lit(change))
    return discovered_rules(files).select("change", "ord", "path", "origin", "body")


def json_files(spark: SparkSession, location: str) -> DataFrame:
    """path and text of JSON files in a folder and the folders in it."""
    return spark.read.text(location, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


VERDICT = "check string, title string, status string, blocking boolean, summary string, rows array<struct<id:string,label:string,verdict:string,evidence:string>>, details array<struct<id:string,heading:string,body:string>>, notes array<string>, emptyMessage string, meta struct<model:string,tokens:bigint,taskId:string,counts:map<string,bigint>>"


def verdict_scan(spark: SparkSession, location: str) -> DataFrame:
    """Valid verdicts of a folder; corrupt or other files are left out."""
    from ..operators.verdicts import is_valid

    read = json_files(spark, location).select("path", F.from_json("text", VERDICT).alias("v")).select("path", "v.*")
    return read.where(is_valid("check", "status", "rows", "details"))


def verdict_lines(spark: SparkSession, location: str) -> DataFrame:
    """Valid verdicts of JSON files that hold one to a line, as they are written here."""
    from ..operators.verdicts import is_valid

    read = spark.read.text(location, recursiveFileLookup=True).select(F.from_json("value", VERDICT).alias("v")).select("v.*")
    return read.where(is_valid("check", "status", "rows", "details"))

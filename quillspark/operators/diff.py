"""Operators over unified diffs and their summaries: text in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, let, text_of, trim

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
HEADER = r'^\+\+\+ (?:"b/(.+)"|b/(.+))$'


def diff_lines(patches: DataFrame, id_col: str, patch_col: str) -> DataFrame:
    """Added lines of each patch: id, path, line (in the new file), text, ord.

    What a line means depends on the lines before it, so each patch is read by running
    windows: the section starts at ``diff --git``, the hunk at ``@@``; a file header
    counts only before a section's first hunk, so an added line that looks like a header
    is content; added and kept lines advance the number of the new file's line."""
    lines = patches.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_of(patch_col), "\n")).alias("ord", "raw"))
    ahead = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count_if(F.col("raw").startswith("diff --git ")).over(ahead))
    start = F.when(F.col("raw").rlike(HUNK), F.regexp_extract("raw", HUNK, 1).cast("int"))
    in_section = Window.partitionBy("id", "section").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("start", start).withColumn("hunk", F.count("start").over(in_section))
    named = F.concat(F.regexp_extract("raw", HEADER, 1), F.regexp_extract("raw", HEADER, 2))
    header = F.when((F.col("hunk") == 0) & F.col("raw").rlike(HEADER), F.struct(F.nullif(named, F.lit("dev/null")).alias("path")))
    in_hunk = Window.partitionBy("id", "section", "hunk").orderBy("ord")
    before = in_hunk.rowsBetween(Window.unboundedPreceding, -1)
    advances = F.substring("raw", 1, 1).isin("+", " ") & header.isNull()
    lines = lines.withColumn("header", header).withColumn("path", F.last("header", ignorenulls=True).over(in_section)["path"])
    first = F.max("start").over(in_hunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lines = lines.withColumn("line", F.coalesce(first, F.lit(0)) + F.coalesce(F.count_if(advances).over(before), F.lit(0)).cast("int"))
    added = F.col("raw").startswith("+") & F.col("header").isNull() & F.col("path").isNotNull()
    return lines.where(added).select("id", "path", "line", F.expr("substring(raw, 2)").alias("text"), "ord")


def count_diff_files(diff: str | Column) -> Column:
    return F.regexp_count(text_of(diff), F.lit(r"(?m)^diff --git ")).cast("int")


def stat_lines(stat: str | Column) -> Column:
    return F.filter(F.transform(F.split(text_of(stat), "\n"), trim), lambda x: x != "")


def count_stat_files(stat: str | Column) -> Column:
    """Lines of a summary without the totals that end it."""

    def counted(lines: Column) -> Column:
        total = F.coalesce(F.try_element_at(lines, F.lit(-1)).rlike(r"\bfiles? changed\b"), F.lit(False))
        return F.size(lines) - total.cast("int")

    return let(stat_lines(stat), counted)


def files_from_stat(stat: str | Column) -> Column:
    """Paths of a summary, renames at their new place, in order."""

    def path_of(line: Column) -> Column:
        path = trim(F.regexp_extract(line, r"^(.*)\|", 1))
        renamed = F.regexp_replace(F.regexp_replace(path, r"^(.*)\{.*=>\s*(.*?)\}(.*)$", "$1$2$3"), "/{2,}", "/")
        return trim(F.when(path.rlike(r"^(.*)\{.*=>\s*(.*?)\}(.*)$"), renamed).otherwise(path))

    lines = F.filter(stat_lines(stat), lambda x: x.contains("|") & ~x.rlike(r"\bfiles?\s+changed\b"))
    return F.filter(F.transform(lines, path_of), lambda p: p != "")


def cut_on_boundary(text: str | Column, most: int, boundary: str = "\ndiff --git ") -> Column:
    """The first ``most`` characters, ended before the last boundary in them (its line
    end stays) if there is one after the start; texts that fit stay whole."""
    whole = text_of(text)

    def cut(part: Column) -> Column:
        # the last place of the boundary, from the end
        back = F.locate(boundary[::-1], F.reverse(part))
        at = F.length(part) - back - (len(boundary) - 1) + 1
        return F.when((back > 0) & (at > 1), F.substring(part, F.lit(1), at)).otherwise(part)

    return F.when(F.length(whole) > most, let(F.substring(whole, 1, most), cut)).otherwise(whole)


def diff_context(changes: DataFrame, diff_col: str, stat_col: str, most: int = 36_000) -> DataFrame:
    """Adds what is known of a diff under a budget: diff (cut, with a note), block,
    empty, truncated, total_chars, total_files, included_files, omitted_files."""
    raw = text_of(diff_col)
    long = F.length(raw) > most
    out = changes.withColumns({"total_chars": F.length(raw), "total_files": count_stat_files(stat_col), "empty": trim(raw) == "", "truncated": long, "__cut": cut_on_boundary(diff_col, most)})
    out = out.withColumn("diff", F.when(F.col("truncated"), F.concat("__cut", F.lit(f"\n\n[... diff truncated at {most} chars ...]"))).otherwise(F.col("__cut"))).drop("__cut")
    out = out.withColumn("included_files", F.when(F.col("truncated"), count_diff_files("diff")).otherwise(F.col("total_files")))
    block = F.when(F.col("empty"), F.lit("(empty — the branch has no changes vs base)")).otherwise(F.concat(F.lit("```diff\n"), "diff", F.lit("\n```")))
    return out.withColumn("omitted_files", F.greatest(F.lit(0), F.col("total_files") - F.col("included_files"))).withColumn("block", block)


def first_difference(a: str | Column, b: str | Column, around: int = 40) -> Column:
    """Where two texts first differ: offset, line and the texts around it; null if equal."""
    a, b = text_of(a), text_of(b)
    n = F.least(F.length(a), F.length(b))

    # halving the length that still agrees needs as many steps as the length has bits
    def step(low: Column, bit: Column) -> Column:
        to = low + bit
        return F.when((to <= n) & (F.substring(a, F.lit(1), to) == F.substring(b, F.lit(1), to)), to).otherwise(low)

    same = F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), step)

    def found(at: Column) -> Column:
        context = lambda t: F.substring(t, F.greatest(F.lit(1), at - around + 1), F.lit(2 * around))
        line = F.length(F.regexp_replace(F.substring(a, F.lit(1), at), "[^\n]", "")) + 1
        return F.struct(at.alias("offset"), line.alias("line"), context(a).alias("left"), context(b).alias("right"))

    return F.when(a != b, let(same, found))


def truncation_note(truncated: str | Column, shown: str | Column, total: str | Column, omitted: str | Column, files: str | Column) -> Column:
    scope = F.when(col(omitted) > 0, F.format_string("%d de %d archivos quedaron fuera", col(omitted), col(files))).otherwise(F.lit("el último archivo quedó incompleto"))
    return F.when(col(truncated), F.concat(F.format_string("Diff truncado en %d de %d caracteres: ", col(shown), col(total)), scope, F.lit(". La revisión es parcial.")))


def too_large(patch: str | Column, most: int = 64 << 20) -> Column:
    """Whether a patch is more than can be read: the change's own fault, not a tool's."""
    return F.coalesce(F.octet_length(col(patch)) > most, F.lit(False))


def classify_files(files: str | Column) -> Column:
    """The paths of a change as files, code, non_code and has_code."""
    from ..functions.paths import is_code_file

    paths = F.coalesce(col(files), F.array().cast("array<string>"))
    code = F.filter(paths, is_code_file)
    return F.struct(paths.alias("files"), code.alias("code"), F.filter(paths, lambda p: ~is_code_file(p)).alias("non_code"), (F.size(code) > 0).alias("has_code"))

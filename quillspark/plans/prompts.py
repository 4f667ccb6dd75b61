"""Plan: what a check asks of its judge, as text. A prompt is a stack of sections; a check
that lacks what it must show has no prompt and an error instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_fence, col, inline_value, text_of, trim, untrusted_block

PAIRS, BODY_CHARS = 8, 1200

# What an answer must look like, by check.
SHAPES = {
    "criteria": '{"correspondence", "correspondenceReason", "overall", "summary", "criteria": [{"id", "criterion", "verdict": met|partial|not_met|manual, "evidence", "reasoning"}]}',
    "security": '{"overall", "summary", "findings": [{"severity": high|medium|low, "issue", "location", "recommendation"}]}',
    "rules": '{"overall", "summary", "rules": [{"rule", "status": ok|violated|na, "evidence", "reasoning"}]}',
    "quality": '{"overall", "summary", "findings": [{"severity": high|medium|low, "issue", "location", "recommendation"}]}',
    "duplication": '{"overall", "summary", "findings": [{"symbol", "location", "existing", "existingLocation", "verdict": duplicate|similar|unrelated, "recommendation"}]}',
    "tests": '{"overall", "summary", "symbols": [{"symbol", "location", "verdict": needs_test|not_needed, "suggestion"}]}',
}


def header(task_id: str | Column, branch: str | Column, base: str | Column, repo: str | Column, source: str | Column, status: str | Column, terminal: str | Column, incident: str | Column, parent: str | Column) -> Column:
    """Who and what a change is: task, branch, and what is known of the task."""
    task = F.coalesce(F.concat(F.lit("#"), col(task_id)), F.lit("(unspecified)"))
    resolved = F.when(col(source).isNotNull(), F.concat(F.lit(" (resolved from the "), col(source), F.lit(")"))).otherwise(F.lit(""))
    lines = F.array(
        F.concat(F.lit("Task: "), task, resolved),
        F.concat(F.lit("Branch: "), text_of(branch), F.lit(" -> base: "), text_of(base), F.lit("   Repo: "), text_of(repo)),
        F.when(text_of(status) != "", F.concat(F.lit("Task status: "), col(status), F.when(F.coalesce(col(terminal), F.lit(False)), F.lit(" (handed over)")).otherwise(F.lit("")))),
        F.when(F.coalesce(col(incident), F.lit(False)), F.lit("The task is an incident.")),
        F.when(col(parent).isNotNull(), F.concat(F.lit("The task derives from #"), col(parent))),
    )
    return F.array_join(F.array_compact(lines), "\n")


def diff_section(stat: str | Column, block: str | Column, base: str | Column, head: str | Column, truncated: str | Column) -> Column:
    shown = F.when(text_of(stat) == "", F.lit("(no changes)")).otherwise(text_of(stat))
    cut = F.when(F.coalesce(col(truncated), F.lit(False)), F.lit(" [TRUNCATED]")).otherwise(F.lit(""))
    return F.concat(F.lit("## Diff stat\n"), shown, F.lit("\n\n## Diff ("), text_of(base), F.lit("..."), text_of(head), F.lit(")"), cut, F.lit("\n"), text_of(block))


def output_format(check: str | Column) -> Column:
    shapes = F.create_map(*[F.lit(x) for p in SHAPES.items() for x in p])
    return F.concat(F.lit("## Output format\nOne JSON object, nothing around it:\n"), F.coalesce(F.try_element_at(shapes, col(check)), F.lit("{}")), F.lit("\nAt most 10 entries; a summary only on FAIL."))


def described(name: Column, kind: Column, path: Column, line: Column) -> Column:
    return F.concat(inline_value(name, 120), F.lit(" ("), inline_value(kind, 30), F.lit(") — "), inline_value(path, 200), F.lit(":"), F.coalesce(line.cast("string"), F.lit("0")))


def shown_body(body: Column, signature: Column) -> Column:
    whole = trim(F.coalesce(F.nullif(body, F.lit("")), signature, F.lit("")))
    return F.when(F.length(whole) > BODY_CHARS, F.concat(F.substring(whole, 1, BODY_CHARS), F.lit("\n// [...truncated]"))).otherwise(whole)


def pair_sections(findings: DataFrame, change: str = "change") -> DataFrame:
    """findings: change, ord, introduced_here, score, name_score, signature_score,
    body_score, and a, b: structs of name, kind, path, line, signature, body. The first
    pairs of each change, both bodies side by side: change, section."""
    from ..operators.pairs import top_k

    two = lambda c: F.format_number(F.col(c), 2)
    side = lambda s: F.concat(described(*(F.col(f"{s}.{c}") for c in ("name", "kind", "path", "line"))), F.lit("\n"), code_fence(shown_body(F.col(f"{s}.body"), F.col(f"{s}.signature"))))
    first = top_k(findings, change, [F.col("ord")], PAIRS, "__n")
    origin = F.when(F.col("introduced_here"), F.lit("Both symbols are new.")).otherwise(F.lit("The second symbol was there before."))
    block = F.concat(
        F.lit("### Pair "), F.col("__n").cast("string"), F.lit(" — similarity "), two("score"), F.lit(" (name "), two("name_score"), F.lit(", signature "), two("signature_score"), F.lit(", body "), two("body_score"), F.lit(")\n"), origin, F.lit("\n\nNew: "), side("a"), F.lit("\n\nExisting: "), side("b")
    )
    listed = F.array_sort(F.collect_list(F.struct("__n", block.alias("t"))))
    return first.groupBy(change).agg(F.concat(F.lit("## Candidate pairs\n\n"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n")).alias("section"))


def candidate_sections(orphans: DataFrame, change: str = "change") -> DataFrame:
    """orphans: change, ord, name, kind, path, line, signature. The untested symbols of
    each change, which bounds the list: change, section."""
    line = F.concat(F.lit("- "), described(*(F.col(c) for c in ("name", "kind", "path", "line"))), F.lit("\n  "), inline_value("signature", 200))
    listed = F.array_sort(F.collect_list(F.struct("ord", line.alias("t"))))
    return orphans.groupBy(change).agg(F.concat(F.lit("## Untested public symbols\n"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n")).alias("section"))


def context_sections(tasks: DataFrame, change: str = "change") -> DataFrame:
    """tasks: change, ord, id, title, description of other tasks that a change refers to."""
    part = trim(F.concat(F.lit("### Task #"), text_of("id"), F.lit("\n"), text_of("title"), F.lit("\n"), text_of("description")))
    listed = F.array_sort(F.collect_list(F.struct("ord", part.alias("t"))))
    return tasks.groupBy(change).agg(F.concat(F.lit("## Context tasks (background only)\n\n"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n")).alias("section"))


def build_prompts(inputs: DataFrame) -> DataFrame:
    """inputs: check, block_id, header, stat, diff_section, section (pairs, candidates or
    context), rules_text, criteria (array), task_title, task_description, pr_title,
    pr_body. Adds ``prompt`` and ``error``: one of them is null."""
    is_ = lambda *c: F.col("check").isin(*c)
    author = untrusted_block("Title and description of the change", F.concat_ws("\n\n", F.nullif(text_of("pr_title"), F.lit("")), F.nullif(text_of("pr_body"), F.lit(""))), "block_id")
    rules = untrusted_block("Project rules", "rules_text", F.concat("block_id", F.lit("-rules")), 1 << 30)
    listed = F.array_join(F.transform("criteria", lambda c, i: F.concat(F.lit("C"), (i + 1).cast("string"), F.lit(". "), c)), "\n")
    stated = F.size(F.coalesce("criteria", F.array().cast("array<string>"))) > 0
    criteria = F.when(stated, F.concat(F.lit("## Acceptance criteria\n"), listed)).otherwise(F.concat(F.lit("## Task\n"), text_of("task_title"), F.lit("\n\n"), text_of("task_description")))
    no_task = ~stated & (text_of("task_title") == "") & (text_of("task_description") == "")
    error = (
        F.when(is_("criteria") & no_task, F.lit("needs a task or criteria"))
        .when(is_("rules") & (text_of("rules_text") == ""), F.lit("needs rules"))
        .when(is_("duplication", "tests") & (text_of("section") == ""), F.lit("needs candidates"))
        .when(~is_(*SHAPES), F.lit("unknown check"))
    )
    stat = F.concat(F.lit("## Diff stat\n"), text_of("stat"))
    parts = F.array(
        F.when(is_("rules"), rules),
        F.col("header"),
        F.when(is_("criteria"), criteria),
        F.when(is_("duplication", "tests", "criteria"), F.col("section")),
        F.when(is_("criteria", "quality", "duplication", "tests"), author),
        F.when(is_("duplication"), stat).otherwise(F.col("diff_section")),
        output_format("check"),
    )
    prompt = F.array_join(F.filter(F.array_compact(parts), lambda p: p != ""), "\n\n")
    return inputs.withColumn("error", error).withColumn("prompt", F.when(F.col("error").isNull(), prompt))


def context_notes(contexts: DataFrame) -> DataFrame:
    """contexts: config_notes, refused, rules_notes (arrays), criteria_ignored, diff_note,
    index_truncated. Adds ``notes``: in order what a verdict must say of its context."""
    nothing = F.array().cast("array<string>")
    held = F.when(F.size(F.coalesce("refused", nothing)) > 0, F.concat(F.lit("Ajustes ignorados por afectar al gate: "), F.array_join("refused", ", ")))
    ignored = F.when(F.coalesce("criteria_ignored", F.lit(False)), F.lit("El bloque de criterios del cuerpo no se usó: se obtuvo la tarea."))
    partial = F.when(F.coalesce("index_truncated", F.lit(False)), F.lit("El índice de símbolos se truncó: la revisión es parcial."))
    notes = F.concat(F.coalesce("config_notes", nothing), F.array(held, ignored, F.col("diff_note")), F.coalesce("rules_notes", nothing), F.array(partial))
    return contexts.withColumn("notes", F.array_compact(notes))

"""References to tasks in a change, and the shape of task records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, html_to_text, let, text_of, trim

TERMINAL = ("enviado qa", "completadas", "no aplica")  # fixed values
CONTEXT_TASKS = 3


def criteria_block(body: str | Column) -> Column:
    found = trim(F.regexp_extract(text_of(body), r"(?i)```criteria\s*\n([\s\S]*?)```", 1))
    return F.when(found != "", F.concat(found, F.lit("\n"))).otherwise(F.lit(""))


def criteria_list(block: str | Column) -> Column:
    """Texts of the bullets and numbered points of a block."""
    point = r"^\s*(?:[-*]|\d+[.)])\s+(.*\S)\s*$"
    lines = F.filter(F.split(text_of(block), "\n"), lambda x: x.rlike(point))
    return F.transform(lines, lambda x: trim(F.regexp_extract(x, point, 1)))


def criteria_mode(block: str | Column, description: str | Column) -> Column:
    """Whether a task states its criteria or they are inferred from it."""
    stated = text_of(description).rlike(r"(?iu)criterios?\s+de\s+aceptaci[oó]n|acceptance\s+criteria")
    return F.when((text_of(block) != "") | stated, F.lit("explicit")).otherwise(F.lit("inferred"))


def ids_from_text(text: str | Column) -> Column:
    """Every ``#n``, ``[n]``, ``(n)`` and ``(#n)``, in order, as strings."""
    found = F.regexp_extract_all(text_of(text), F.lit(r"#\d+|\[\d+\]|\(#?\d+\)"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_extract(x, r"\d+", 0))


def id_from_branch(ref: str | Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(ref), r"(?:^|/)(\d+)-", 1), F.lit(""))


def task_ref(branch: str | Column, title: str | Column, body: str | Column) -> Column:
    """mode, subject_id, source, context_ids (three at most), criteria_block: the branch
    comes before the title, the title before the body."""
    parts = F.struct(id_from_branch(branch).alias("branch"), ids_from_text(title).alias("title"), ids_from_text(body).alias("body"), criteria_block(body).alias("block"))

    def chosen(p: Column) -> Column:
        first = lambda c: F.try_element_at(p[c], F.lit(1))
        subject = F.coalesce(p["branch"], first("title"), first("body"))
        source = F.when(p["branch"].isNotNull(), F.lit("branch")).when(first("title").isNotNull(), F.lit("title")).when(first("body").isNotNull() | (p["block"] != ""), F.lit("body"))
        others = F.filter(F.array_distinct(F.concat(p["title"], p["body"])), lambda i: i != F.coalesce(subject, F.lit("")))
        mode = F.when(subject.isNotNull() | (p["block"] != ""), F.lit("task")).otherwise(F.lit("none"))
        return F.struct(mode.alias("mode"), subject.alias("subject_id"), source.alias("source"), F.slice(others, 1, CONTEXT_TASKS).alias("context_ids"), p["block"].alias("criteria_block"))

    return let(parts, chosen)


def is_terminal(status: str | Column) -> Column:
    return F.coalesce(F.lower(trim(col(status))).isin(*TERMINAL), F.lit(False))


def shape_task(payload: str | Column) -> Column:
    """A task record from the JSON that a service answers, in any of its envelopes:
    id, title, description, status, is_terminal, is_incident, parent, subtasks."""
    raw = col(payload)
    pick = lambda *paths: F.coalesce(*(F.get_json_object(raw, f"$.{root}{p}") for root in ("data.", "") for p in paths))
    status = pick("taskStatus.name", "status.name", "status")
    status = F.when(~F.coalesce(status.startswith("{"), F.lit(False)), status)
    incident = F.coalesce(pick("incidentOrigin"), F.lit(""))
    parent = F.struct(*(F.coalesce(pick(f"task.{k}", f"parentTask.{k}"), F.lit("")).alias(k) for k in ("id", "title")))
    return F.struct(
        F.coalesce(pick("id"), F.lit("")).alias("id"),
        F.coalesce(pick("title"), F.lit("")).alias("title"),
        html_to_text(pick("description")).alias("description"),
        status.alias("status"),
        is_terminal(status).alias("is_terminal"),
        (~incident.isin("", "false", "0", "null")).alias("is_incident"),
        F.when(F.coalesce(pick("task", "parentTask"), F.lit("null")) != "null", parent).alias("parent"),
        F.coalesce(F.json_array_length(pick("subTasks")), F.lit(0)).alias("subtasks"),
    )

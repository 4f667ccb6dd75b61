"""Plan: from changes, their contexts and recorded answers to verdicts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.verdicts import first_acceptable, make_verdicts, render, report_rows, short_circuit


def evaluate(contexts: DataFrame, answers: DataFrame, attempts: int = 3) -> DataFrame:
    """contexts: change, check and the columns of :func:`short_circuit`, with fail_on,
    mode and task_id. answers: change, check, attempt, text. A verdict for each context:
    checks that end early need no answer."""
    early = short_circuit(contexts)
    usable = first_acceptable(answers, ["change", "check"], "attempt", "text", "check", attempts)
    met = early.join(usable, ["change", "check"], "left").withColumn("answer", F.when(F.col("early").isNull(), F.col("answer")))
    out = make_verdicts(render(met))
    note = F.coalesce(F.col("early.reason"), F.when(F.col("overall").isNull(), F.coalesce("reason", F.lit("no answer"))), F.col("note"))
    nothing = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), dict(out.dtypes)[c]))
    return out.withColumns({"rows": nothing("rows"), "details": nothing("details"), "notes": F.array_compact(F.array(note))}).drop("early", "answer", "reason", "note")


def report(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of each change's report; ``ord`` tells the last of equal verdicts."""
    return report_rows(expected, verdicts)


def with_tasks(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """refs: change, subject_id, context_ids. tasks: id, title, description, status,
    is_terminal, is_incident, parent (struct of id and title). Adds the subject's title,
    description, status, is_terminal, is_incident, parent_id, has_task, and ``context``:
    what is known of the tasks that the change also refers to, in order."""
    subject = tasks.select(F.col("id").alias("subject_id"), "title", "description", "status", "is_terminal", "is_incident", F.col("parent.id").alias("parent_id"), F.lit(True).alias("has_task"))
    asked = refs.select("change", F.posexplode("context_ids").alias("ord", "id"))
    known = asked.join(tasks.select("id", "title", "description"), "id")
    # three to a change at most
    context = known.groupBy("change").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "title", "description"))).alias("context"))
    out = refs.join(subject, "subject_id", "left").join(context, "change", "left")
    return out.withColumn("has_task", F.coalesce("has_task", F.lit(False)))


def first_task(verdicts: DataFrame, change: str = "change", task: str = "task_id", order: str = "ord") -> DataFrame:
    """change and the first task that one of its verdicts names (null if none does)."""
    named = F.when(F.col(task).isNotNull() & (F.col(task) != ""), F.col(order))
    return verdicts.groupBy(change).agg(F.min_by(task, named).alias(task))

"""Verdicts: from answers and context to rows, gates, statuses and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import CHECKS, SHIPPED, TITLES, check_rank
from ..functions.text import cell, col, evidence, label, let, plain, prose, text_of, trim

STATUSES = ("pass", "fail", "tool-error", "skipped")
SUMMARY_CHARS, ERROR_CHARS = 700, 1500
MARKER = "<!-- change-review -->"  # what marks the one comment of a change

ITEM = "struct<id:string,criterion:string,verdict:string,evidence:string,reasoning:string,severity:string,issue:string,location:string,recommendation:string,rule:string,status:string,symbol:string,existing:string,existingLocation:string,suggestion:string>"
ANSWER = f"struct<overall:string,summary:string,correspondence:string,correspondenceReason:string,criteria:array<{ITEM}>,findings:array<{ITEM}>,rules:array<{ITEM}>,symbols:array<{ITEM}>>"
LISTS = {"criteria": "criteria", "security": "findings", "rules": "rules", "quality": "findings", "duplication": "findings", "tests": "symbols"}

# ------------------------------------------------------------------ answers


def extract_json(text: str | Column) -> Column:
    """The JSON object in an answer, as text: inside the first fence if there is one, from
    the first brace to the last; null if there is none or it is no JSON."""

    def inner(t: Column) -> Column:
        fence = r"(?i)```(?:json)?\s*([\s\S]*?)```"
        return F.when(t.rlike(fence), trim(F.regexp_extract(t, fence, 1))).otherwise(t)

    def braces(t: Column) -> Column:
        start, back = F.locate("{", t), F.locate("}", F.reverse(t))
        object_ = F.substring(t, start, F.length(t) - back + 1 - start + 1)
        return F.when((start > 0) & (back > 0) & (F.length(t) - back + 1 > start), object_)

    return let(let(inner(trim(text_of(text))), braces), lambda o: F.when(F.try_parse_json(o).isNotNull(), o))


def acceptable(check: str | Column, answer: str | Column) -> Column:
    """Whether an answer (JSON text) has the list that its check needs."""
    key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LISTS.items() for x in p]), col(check)), F.lit(""))
    has = F.lit(False)
    for name in set(LISTS.values()):
        has = has | ((key == name) & F.coalesce(trim(F.get_json_object(col(answer), f"$.{name}")).startswith("["), F.lit(False)))
    mismatch = (col(check) == "criteria") & F.coalesce(F.get_json_object(col(answer), "$.correspondence") == "mismatch", F.lit(False))
    return col(answer).isNotNull() & (has | mismatch)


def first_acceptable(answers: DataFrame, keys: list[str], attempt: str, text: str, check: str | Column, attempts: int = 3) -> DataFrame:
    """Per key the first acceptable answer within the attempts: answer, attempt, or nulls
    and the reason why the last attempt failed."""
    tried = answers.where(F.col(attempt) <= attempts).withColumn("__json", extract_json(text))
    tried = tried.withColumn("__ok", acceptable(check, "__json"))
    at = lambda c: F.when(F.col("__ok"), F.col(c))
    reason = F.when(F.col("__json").isNull(), F.lit("unparseable")).otherwise(F.lit("unexpected shape"))
    out = tried.groupBy(*keys).agg(F.min_by(at("__json"), at(attempt)).alias("answer"), F.min(at(attempt)).alias("attempt"), F.max_by(reason, attempt).alias("__why"))
    return out.withColumn("reason", F.when(F.col("answer").isNull(), F.col("__why"))).drop("__why")


def token_usage(usage: str | Column) -> Column:
    """Reported token counts of a JSON record; what is not reported is null, not 0."""
    number = lambda *paths: F.coalesce(*(F.get_json_object(col(usage), f"$.{p}") for p in paths)).try_cast("double").cast("long")
    return F.struct(
        number("totalTokens").alias("total"),
        number("inputTokens").alias("input"),
        number("outputTokens").alias("output"),
        number("inputTokenDetails.cachedTokens", "inputTokenDetails.cacheReadTokens").alias("cache_read"),
        number("inputTokenDetails.cacheWriteTokens", "inputTokenDetails.cacheCreationTokens").alias("cache_write"),
        number("outputTokenDetails.reasoningTokens").alias("reasoning"),
    )


# ------------------------------------------------------------------ rendering


def resolve_overall(said: str | Column, failing: str | Column) -> Column:
    """overall and note: items in a failing state decide; an answer that says FAIL without
    one passes with a note."""
    overall = F.when(col(failing) > 0, F.lit("FAIL")).otherwise(F.lit("PASS"))
    note = F.when((col(failing) <= 0) & (col(said) == "FAIL"), F.lit("El modelo marcó FAIL sin ninguna entrada bloqueante: se reporta PASS."))
    return F.struct(overall.alias("overall"), note.alias("note"))


def _parts(check: Column, i: Column, n: Column) -> tuple[Column, Column, Column, Column, Column, Column]:
    """id, label, verdict token, evidence, heading and body of an item of a check."""
    by = lambda default, **own: _case(check, default, own)
    letter = by(F.lit("?"), security=F.lit("S"), rules=F.lit("R"), quality=F.lit("Q"), duplication=F.lit("D"), tests=F.lit("T"))
    number = F.when(check == "criteria", F.coalesce(i["id"], F.lit("?"))).otherwise(F.concat(letter, n.cast("string")))
    token = by(i["verdict"], security=i["severity"], quality=i["severity"], rules=i["status"])
    both = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" ↔ "), F.coalesce(b, F.lit("")))
    title = by(cell(i["issue"], 90), criteria=cell(i["criterion"], 90), rules=cell(i["rule"], 70), duplication=cell(both(i["symbol"], i["existing"]), 70), tests=cell(i["symbol"], 60))
    proof = by(evidence(i["location"], 60), criteria=evidence(i["evidence"], 120), rules=evidence(i["evidence"], 110), duplication=evidence(both(i["location"], i["existingLocation"]), 90), tests=evidence(i["location"], 80))
    heading = by(
        F.concat(number, F.lit(" — "), title, F.lit(" ("), label(token), F.lit(", "), cell(i["location"], 60), F.lit(")")),
        criteria=F.concat(number, F.lit(" — "), title, F.lit(" ("), label(token), F.lit(")")),
        rules=cell(i["rule"], 70),
        tests=F.concat(cell(i["symbol"], 60), F.lit(" ("), cell(i["location"], 80), F.lit(")")),
        duplication=F.concat(cell(i["symbol"], 60), F.lit(" ("), cell(i["location"], 60), F.lit(") ↔ "), cell(i["existing"], 60), F.lit(" ("), cell(i["existingLocation"], 60), F.lit(")")),
    )
    body = by(plain(i["recommendation"]), criteria=plain(i["reasoning"]), rules=plain(i["reasoning"]), tests=plain(i["suggestion"]))
    return number, title, token, proof, heading, body


def _case(check: Column, default: Column, own: dict[str, Column]) -> Column:
    out = default
    for name, value in own.items():
        out = F.when(check == name, value).otherwise(out)
    return out


def render(answers: DataFrame) -> DataFrame:
    """answers: check, answer (JSON text), fail_on (array; null: as shipped), mode of
    criteria (``explicit``, ``inferred``, null), task_id. Adds rows, details, overall,
    note, counts (map) and summary; all are null where the shape is not the check's."""
    shipped = F.create_map(*[x for c in CHECKS for x in (F.lit(c), F.array(*map(F.lit, SHIPPED[c]["failOn"])))])
    a = answers.withColumn("__a", F.from_json("answer", ANSWER)).withColumn("__fail", F.coalesce("fail_on", F.try_element_at(shipped, F.col("check"))))
    items = _case(F.col("check"), F.lit(None).cast(f"array<{ITEM}>"), {c: F.col(f"__a.{name}") for c, name in LISTS.items()})
    a = a.withColumn("__ok", acceptable("check", "answer")).withColumn("__items", F.coalesce(items, F.array().cast(f"array<{ITEM}>")))
    a = a.withColumn("__mismatch", (F.col("check") == "criteria") & F.coalesce(F.col("__a.correspondence") == "mismatch", F.lit(False)))
    state = lambda i: _case(F.col("check"), i["verdict"], {"security": i["severity"], "quality": i["severity"], "rules": i["status"]})
    a = a.withColumn("__failing", F.filter("__items", lambda i: F.array_contains(F.col("__fail"), F.coalesce(state(i), F.lit("")))))
    relevant = F.filter("__items", lambda i: F.coalesce(i["status"], F.lit("")) != "na")
    a = a.withColumn("__relevant", relevant).withColumn("__shown", F.when((F.col("check") == "rules") & (F.size("__relevant") > 0), F.col("__relevant")).otherwise(F.col("__items")))

    def row(i: Column, n: Column) -> Column:
        number, title, token, proof, _, _ = _parts(F.col("check"), i, n + 1)
        return F.struct(number.alias("id"), title.alias("label"), label(token).alias("verdict"), proof.alias("evidence"))

    def detail(i: Column, n: Column) -> Column:
        number, _, _, _, heading, body = _parts(F.col("check"), i, n + 1)
        return F.struct(number.alias("id"), heading.alias("heading"), body.alias("body"))

    every = F.col("check").isin("security", "quality")
    a = a.withColumn("__detailed", F.when(every, F.col("__items")).otherwise(F.col("__failing")))
    task = F.coalesce(F.concat(F.lit("#"), F.col("task_id")), F.lit("la tarea referenciada"))
    wrong = F.concat(F.lit("Los cambios no corresponden a "), task)
    none = F.lit("").alias("evidence")
    rows = F.when(F.col("__mismatch"), F.array(F.struct(F.lit("REF").alias("id"), cell(wrong, 90).alias("label"), F.lit("NO CORRESPONDE").alias("verdict"), none))).otherwise(F.transform("__shown", row))
    details = F.when(F.col("__mismatch"), F.array(F.struct(F.lit("REF").alias("id"), wrong.alias("heading"), plain(F.col("__a.correspondenceReason")).alias("body")))).otherwise(F.transform("__detailed", detail))
    failing = F.when(F.col("mode") == "inferred", F.lit(0)).otherwise(F.size("__failing"))
    said = F.when(F.coalesce(F.col("mode"), F.lit("")) != "inferred", F.col("__a.overall"))
    gate = resolve_overall(said, failing)
    name = _case(F.col("check"), F.lit("blocking"), {"criteria": F.lit("gaps"), "tests": F.lit("gaps"), "rules": F.lit("violations"), "duplication": F.lit("duplicates")})
    counts = F.map_filter(
        F.create_map(F.lit("total"), F.size("__items"), name, F.size("__failing"), F.lit("relevant"), F.when(F.col("check") == "rules", F.size("__relevant")), F.lit("mismatch"), F.lit(None).cast("int")),
        lambda k, v: v.isNotNull(),
    )
    wrong_counts = F.create_map(F.lit("total"), F.lit(0), F.lit("gaps"), F.lit(0), F.lit("mismatch"), F.lit(1))
    out = a.withColumns({"rows": rows, "details": details, "overall": F.when(F.col("__mismatch"), F.lit("FAIL")).otherwise(gate["overall"]), "note": F.when(~F.col("__mismatch"), gate["note"]), "counts": F.when(F.col("__mismatch"), wrong_counts).otherwise(counts), "summary": F.substring(text_of("__a.summary"), 1, SUMMARY_CHARS)})
    for c in ("rows", "details", "overall", "note", "counts", "summary"):
        out = out.withColumn(c, F.when(F.col("__ok"), F.col(c)))
    return out.select(*answers.columns, "rows", "details", "overall", "note", "counts", "summary")


# ------------------------------------------------------------------ statuses


def is_content_failure(flagged: str | Column, kind: str | Column) -> Column:
    """Whether a failure to read a change is the change's own fault."""
    return F.coalesce(col(flagged), F.lit(False)) | F.coalesce(col(kind) == "syntax", F.lit(False))


def failure_status(flagged: str | Column, kind: str | Column, blocking: str | Column) -> Column:
    """status and blocking of a check that could not run: content that cannot be read
    fails as configured; a tool's own error never blocks."""
    own = is_content_failure(flagged, kind)
    return F.struct(F.when(own, F.lit("fail")).otherwise(F.lit("tool-error")).alias("status"), (own & F.coalesce(col(blocking), F.lit(True))).alias("blocking"))


def short_circuit(contexts: DataFrame) -> DataFrame:
    """contexts: check, is_fork, diff_empty, code_files (null: not known), has_suite,
    orphans, findings, rules_text, budget_exhausted, blocking, task_mode, has_task. Adds
    ``early`` (status, blocking, reason), null where the check goes on. The first of the
    ordered gates that closes decides."""
    skip = lambda reason: F.struct(F.lit("skipped").alias("status"), F.lit(False).alias("blocking"), F.lit(reason).alias("reason"))
    needs_code = F.col("check").isin(*(c for c in CHECKS if SHIPPED[c]["code"]))
    is_ = lambda c: F.col("check") == c
    no_rules = is_("rules") & (text_of("rules_text") == "")
    fail = F.struct(F.lit("fail").alias("status"), F.coalesce("blocking", F.lit(True)).alias("blocking"), F.lit("rules budget exhausted").alias("reason"))
    early = (
        F.when(~F.col("check").isin(*CHECKS), F.struct(F.lit("tool-error").alias("status"), F.lit(False).alias("blocking"), F.lit("unknown check").alias("reason")))
        .when(F.coalesce("is_fork", F.lit(False)), skip("fork"))
        .when(needs_code & (F.col("code_files") == 0) & ~F.coalesce("diff_empty", F.lit(False)), skip("no code"))
        .when(is_("tests") & ~F.coalesce("has_suite", F.lit(False)), skip("no test suite"))
        .when(is_("tests") & (F.coalesce("orphans", F.lit(0)) == 0), skip("nothing untested"))
        .when(is_("duplication") & (F.coalesce("findings", F.lit(0)) == 0), skip("no similar symbols"))
        .when(no_rules & F.coalesce("budget_exhausted", F.lit(False)), fail)
        .when(no_rules, skip("no rules"))
        .when(is_("criteria") & (F.col("task_mode") == "none"), skip("no task"))
        .when(is_("criteria") & ~F.coalesce("has_task", F.lit(False)), skip("task unavailable"))
        .when(~is_("criteria") & F.coalesce("diff_empty", F.lit(False)), skip("empty diff"))
    )
    return contexts.withColumn("early", early)


def make_verdicts(rendered: DataFrame) -> DataFrame:
    """rendered: as from :func:`render`, with early (or null), attempt and blocking. Adds
    title, status, blocking: an early end stands; no usable answer is a tool error,
    which never blocks; else the gate decides."""
    titles = F.create_map(*[F.lit(x) for p in TITLES.items() for x in p])
    status = F.coalesce(F.col("early.status"), F.when(F.col("overall").isNull(), F.lit("tool-error")).when(F.col("overall") == "FAIL", F.lit("fail")).otherwise(F.lit("pass")))
    blocks = F.when(F.col("early").isNotNull(), F.col("early.blocking")).when(F.col("overall").isNull(), F.lit(False)).otherwise(F.coalesce("blocking", F.lit(True)))
    return rendered.withColumn("title", F.coalesce(F.try_element_at(titles, F.col("check")), F.col("check"))).withColumn("status", status).withColumn("blocking", blocks)


def is_valid(check: str | Column, status: str | Column, rows: str | Column, details: str | Column) -> Column:
    return col(check).isNotNull() & F.coalesce(col(status).isin(*STATUSES), F.lit(False)) & col(rows).isNotNull() & col(details).isNotNull()


def is_blocking_failure(status: str | Column, blocking: str | Column) -> Column:
    return (col(status) == "fail") & F.coalesce(col(blocking), F.lit(False))


def exit_code(status: str | Column) -> Column:
    return F.when(col(status) == "tool-error", 2).when(col(status) == "fail", 1).otherwise(0)


# ------------------------------------------------------------------ reports


def status_label(status: str | Column, blocking: str | Column, counts: str | Column) -> Column:
    """A status with its most telling count; null is a check without a result."""
    n = lambda k: F.try_element_at(col(counts), F.lit(k))
    shown = lambda v: F.when(F.coalesce(v, F.lit(0)) != 0, F.concat(F.lit(" ("), v.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    free = F.when(F.coalesce(col(blocking), F.lit(False)), F.lit("")).otherwise(F.lit(" — no bloquea"))
    fail = F.when(F.coalesce(n("mismatch"), F.lit(0)) != 0, F.lit("❌ NO CORRESPONDE")).otherwise(F.concat(F.lit("❌ FAIL"), shown(F.coalesce(n("gaps"), n("violations"), n("blocking"), n("total")))))
    return (
        F.when(col(status).isNull(), F.lit("⏳ sin resultado"))
        .when(col(status) == "pass", F.concat(F.lit("✅ PASS"), shown(n("total"))))
        .when(col(status) == "fail", F.concat(fail, free))
        .when(col(status) == "tool-error", F.lit("⚠️ error de herramienta — no bloquea"))
        .when(col(status) == "skipped", F.lit("➖ omitido"))
        .otherwise(col(status))
    )


def report_rows(expected: DataFrame, verdicts: DataFrame, change: str = "change", order: str = "ord") -> DataFrame:
    """expected: change, check. verdicts: change, check, title, status, blocking, counts,
    rows, details, ord. One row per expected check: of several valid verdicts the last
    counts, a missing one is pending; ``pos`` is its place in the table, ``section`` its
    place among the sections (failing ones first; null if it has none)."""
    valid = verdicts.where(is_valid("check", "status", "rows", "details"))
    last = valid.groupBy(change, "check").agg(F.max_by(F.struct(*(F.col(c) for c in verdicts.columns if c not in (change, "check"))), order).alias("v"))
    met = expected.select(change, "check").distinct().join(last, [change, "check"], "left").select(change, "check", "v.*")
    met = met.withColumn("title", F.coalesce("title", "check")).withColumn("label", status_label("status", "blocking", "counts"))
    places = [check_rank("check"), F.col("check")]
    table = F.row_number().over(Window.partitionBy(change).orderBy(*places))
    sections = F.row_number().over(Window.partitionBy(change).orderBy(F.col("status").isNull(), F.col("status") != "fail", *places))
    return met.withColumn("pos", table).withColumn("section", F.when(F.col("status").isNotNull(), sections))


def usage_breakdown(usage: str | Column) -> Column:
    u = col(usage)
    part = lambda v, text: F.when(v.isNotNull(), F.concat(v.cast("string"), F.lit(text)))
    parts = F.array_compact(F.array(part(u["cache_read"], " leídos de caché"), part(u["cache_write"], " escritos en caché"), part(u["reasoning"], " de razonamiento")))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise(F.lit(""))


def section_text() -> Column:
    """The body of a verdict's section: summary, table or message, what to fix, notes."""
    row = lambda r: F.concat(F.lit("| "), r["id"], F.lit(" | "), r["label"], F.lit(" | "), r["verdict"], F.lit(" | "), r["evidence"], F.lit(" |"))
    head = "| # | Detalle | Veredicto | Evidencia |\n|---|---------|-----------|-----------|\n"
    table = F.when(F.size("rows") > 0, F.concat(F.lit(head), F.array_join(F.transform("rows", row), "\n")))
    fix = F.when(F.size("details") > 0, F.concat(F.lit("#### Qué corregir\n\n"), F.array_join(F.transform("details", lambda d: F.concat(F.lit("**"), prose(d["heading"], 200), F.lit("**\n\n"), prose(d["body"]))), "\n\n")))
    notes = F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("> "), F.replace(prose(n), F.lit("\n"), F.lit("\n> "))))
    parts = F.concat(F.array(F.nullif(prose("summary"), F.lit("")), F.coalesce(table, F.nullif(prose("empty_message"), F.lit(""))), fix), notes)
    return F.array_join(F.array_compact(parts), "\n\n")


def render_reports(rows: DataFrame, change: str = "change") -> DataFrame:
    """rows: as from :func:`report_rows`, with summary, empty_message and notes. One
    report per change: table in display order, sections with failing ones first."""
    line = F.concat(F.lit("| "), "title", F.lit(" | "), "label", F.lit(" |"))
    shape = F.concat(F.lit("<details"), F.when(F.col("status") == "fail", F.lit(" open")).otherwise(F.lit("")), F.lit("><summary><strong>"), "title", F.lit("</strong> — "), "label", F.lit("</summary>\n\n"), "__body", F.lit("\n\n</details>"))
    ready = rows.withColumn("__body", section_text()).withColumn("__line", line)
    ready = ready.withColumn("__part", F.when(F.col("section").isNotNull() & (F.col("__body") != ""), shape))
    ordered = lambda by, what, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(by).alias("o"), F.col(what).alias("t"))))), lambda x: x["t"])
    grouped = ready.groupBy(change).agg(ordered("pos", "__line", F.lit(True)).alias("lines"), ordered("section", "__part", F.col("__part").isNotNull()).alias("parts"), ordered("pos", "check", F.col("status").isNull()).alias("missing"))
    late = F.when(F.size("missing") > 0, F.concat(F.lit("> Sin resultado de: "), F.array_join("missing", ", "), F.lit(".")))
    head = F.concat(F.lit(f"{MARKER}\n## Validación de PR\n\n| Check | Veredicto |\n|-------|-----------|\n"), F.array_join("lines", "\n"))
    return grouped.select(change, F.concat(F.array_join(F.array_compact(F.concat(F.array(head), F.col("parts"), F.array(late))), "\n\n"), F.lit("\n")).alias("body"))


def upsert_comments(existing: DataFrame, reports: DataFrame, author: str, change: str = "change") -> DataFrame:
    """existing: change, id, login, body. What publishing a report does: change, action
    (``updated``, ``created``), id (the first own comment with the marker), body."""
    own = existing.where(F.col("body").contains(MARKER) & (F.col("login") == author)).groupBy(change).agg(F.min("id").alias("id"))
    met = reports.join(own, change, "left")
    return met.select(change, F.when(F.col("id").isNotNull(), F.lit("updated")).otherwise(F.lit("created")).alias("action"), "id", "body")


def keyed_upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """current with the last change of each key in its place, new keys added."""
    rest = [c for c in current.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("n"))
    both = current.select(key, F.struct(*rest).alias("o")).join(last, key, "full")
    return both.select(key, F.coalesce("n", "o").alias("x")).select(key, "x.*")



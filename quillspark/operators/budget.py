"""Packing of ordered texts under a budget, and the scopes that they declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of, trim
from ..sources.scratch import stored

FRONT = r"\A---\r?\n([\s\S]*?)\r?\n---"
SCOPE = r"(?im)^\s*(globs|appliesTo|applies_to|files)\s*:\s*(.+)$"
BUDGET, SEPARATOR = "budget", 2


def declared_scope(body: str | Column) -> Column:
    """Globs that a text's front matter declares; empty if it declares none."""
    scope = F.regexp_extract(F.regexp_extract(text_of(body), FRONT, 1), SCOPE, 2)
    items = F.split(F.regexp_replace(scope, r"^\[|\]$", ""), ",")
    return F.filter(F.transform(items, lambda g: F.regexp_replace(trim(g), r"^['\"]|['\"]$", "")), lambda g: g != "")


def strip_front(body: str | Column) -> Column:
    return trim(F.regexp_replace(text_of(body), FRONT, ""))


CHUNK = 4096


def greedy_pack(items: DataFrame, group: list[str], ord_col: str, size_col: str, budget: int, separator: int = SEPARATOR) -> DataFrame:
    """items with ``kept``: in order, an item stays if it fits into what is left of its
    group's budget; one that does not is skipped and later, smaller ones may still fit.
    The order must be unique within a group.

    Whether an item fits depends on all decisions before it. So rounds pass on a small
    state per group: what is used, and how far it has come. A round takes each group's
    next ``CHUNK`` items that are not too large for what is left and folds them; items that
    no longer fit are passed over by a filter. A group of any size costs a bounded fold
    a round, and rounds end as soon as nothing that is left fits."""
    small = stored(items.select(*group, F.col(ord_col).alias("__o"), F.col(size_col).cast("long").alias("__s")).where(F.col("__s") <= budget), "pack")
    start = F.struct(F.col("__used").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["s"] <= budget
        used = F.when(fits, state["used"] + x["s"] + separator).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["kept"], F.array(fits)).alias("kept"))

    # groups may be null: states are met by null-safe keys
    state, chosen = None, []
    while True:
        if state is None:
            ahead = small.withColumn("__used", F.lit(0).cast("long"))
        else:
            s = state.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), "__used", "__at")
            same = F.lit(True)
            for i, g in enumerate(group):
                same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
            ahead = small.join(s, same & (F.col("__o") > F.col("__at")) & (F.col("__used") + F.col("__s") <= budget)).select(*group, "__o", "__s", "__used")
        next_ones = ahead.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy("__o"))).where(F.col("__r") <= CHUNK)
        listed = F.array_sort(F.collect_list(F.struct(F.col("__o").alias("o"), F.col("__s").alias("s"))))
        folded = next_ones.groupBy(*group, "__used").agg(listed.alias("__items"))
        folded = stored(folded.withColumn("__end", F.aggregate("__items", start, step)), "packed")
        if folded.isEmpty():
            break
        taken = folded.select(*group, F.explode(F.arrays_zip("__items", F.col("__end.kept").alias("k"))).alias("x")).select(*group, F.col("x.__items.o").alias("__o"), F.col("x.k").alias("__k"))
        chosen.append(taken.where("__k").drop("__k"))
        state = folded.select(*group, F.col("__end.used").alias("__used"), F.element_at("__items", -1)["o"].alias("__at"))
    if not chosen:
        return items.withColumn("kept", F.lit(False))
    hits = chosen[0]
    for more in chosen[1:]:
        hits = hits.unionByName(more)
    hits = hits.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__o"), F.lit(True).alias("__hit"))
    same = F.col(ord_col) == F.col("__o")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = items.join(hits, same, "left")
    return out.select(*items.columns, F.coalesce("__hit", F.lit(False)).alias("kept"))


def pack_rules(rules: DataFrame, touched: DataFrame | None, budget: int = 48_000) -> DataFrame:
    """rules: change, ord, path, body (null: could not be read). One row per rule with
    section, chars, decision (``loaded``, ``unreadable``, ``out of scope``, ``budget``).

    touched: change, path of the files of each change, or null if they are not known.
    The scope comes before the budget: what does not apply takes no room."""
    from ..functions.paths import glob_regex

    @F.pandas_udf("array<string>")
    def patterns(globs):
        return globs.map(lambda gs: [p for p in map(glob_regex, gs if gs is not None else []) if p])

    sections = rules.withColumn("scope", declared_scope("body")).withColumn("section", F.concat(F.lit("### "), "path", F.lit("\n"), strip_front("body")))
    sections = sections.withColumn("chars", F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.length("section"))).withColumn("readable", F.col("body").isNotNull())
    if touched is None:
        scoped = sections.withColumn("applies", F.lit(True))
    else:
        globs = sections.where("readable").select("change", "ord", patterns("scope").alias("ps")).where(F.size("ps") > 0)
        files = touched.select(F.col("change"), F.col("path").alias("file"))
        hits = globs.select("change", "ord", F.explode("ps").alias("p")).join(files, "change").where("file rlike p").select("change", "ord").distinct()
        known = files.select("change").distinct().withColumn("known", F.lit(True))
        scoped = sections.join(hits.withColumn("hit", F.lit(True)), ["change", "ord"], "left").join(globs.select("change", "ord", F.lit(True).alias("scoped")), ["change", "ord"], "left").join(known, "change", "left")
        scoped = scoped.withColumn("applies", F.col("known").isNull() | F.col("scoped").isNull() | F.col("hit").isNotNull()).drop("hit", "scoped", "known")
    packed = greedy_pack(scoped.where("readable and applies").select("change", "ord", "chars"), ["change"], "ord", "chars", budget).drop("chars")
    out = scoped.join(packed, ["change", "ord"], "left")
    decision = F.when(~F.col("readable"), F.lit("unreadable")).when(~F.col("applies"), F.lit("out of scope")).when(F.col("kept"), F.lit("loaded")).otherwise(F.lit(BUDGET))
    return out.withColumn("decision", decision).select("change", "ord", "path", "scope", "section", "chars", "decision")


def rules_summary(packed: DataFrame, most: int = 48_000) -> DataFrame:
    """Per change: text of what was loaded, total_chars, loaded, truncated,
    budget_exhausted, empty."""
    loaded = F.col("decision") == "loaded"
    parts = F.array_sort(F.collect_list(F.when(loaded, F.struct("ord", "section"))))
    cut = F.bool_or(F.col("decision") == BUDGET)
    return packed.groupBy("change").agg(
        F.array_join(F.transform(parts, lambda x: x["section"]), "\n\n").alias("text"),
        F.sum("chars").alias("total_chars"),
        F.count_if(loaded).alias("loaded"),
        cut.alias("truncated"),
        (cut & (F.count_if(loaded) == 0)).alias("budget_exhausted"),
        (F.count(F.lit(1)) == 0).alias("empty"),
        F.lit(most).alias("max_chars"),
    )


def rules_notes(packed: DataFrame) -> DataFrame:
    """Per change its notes, in order: what was cut, loaded, unreadable, out of scope."""

    def named(decision: str, text: Column | None = None) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col("decision") == decision, F.struct("ord", (text if text is not None else F.col("path")).alias("t")))))
        return F.transform(picked, lambda x: x["t"])

    scoped = F.concat("path", F.lit(" — fuera de alcance (declara "), F.array_join("scope", ", "), F.lit(")"))
    lists = packed.groupBy("change").agg(named("loaded").alias("l"), named("unreadable").alias("u"), named("out of scope", scoped).alias("s"), named(BUDGET).alias("b"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    note = lambda c, head, sep=", ": F.when(F.size(c) > 0, F.concat(F.lit(head), F.size(c).cast("string"), F.lit("): "), F.array_join(c, sep), F.lit(".")))
    cut = F.when(F.size("b") > 0, F.concat(F.format_string("Corpus de reglas truncado: %d de %d archivos cargados (%d caracteres en total). Omitidos por presupuesto: ", F.size("l"), F.col("n"), F.col("chars")), F.array_join("b", ", "), F.lit(".")))
    return lists.select("change", F.array_compact(F.array(cut, note("l", "Reglas cargadas ("), note("u", "Reglas no leídas ("), note("s", "Reglas omitidas por no aplicar a los archivos de este PR (", "; "))).alias("notes"))

"""Layered settings: the branch's own file may tighten a gate and never relax it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, let, trim

# Defaults, bounds, and what ships with each check.
CHECKS = ("criteria", "security", "rules", "quality", "duplication", "tests")
DEFAULTS = {"blocking": True, "attempts": 3, "maxDiffChars": 36_000, "maxRulesChars": 48_000}
BOUNDS = {"attempts": (1, 5), "maxDiffChars": (4_000, 200_000), "maxRulesChars": (4_000, 200_000), "threshold": (0.3, 1), "maxCandidates": (1, 20)}
EFFORTS = ("low", "medium", "high", "max")
BUDGETS = {"low": 1_024, "medium": 4_096, "high": 12_288, "max": 24_576}
SHIPPED = {
    "criteria": {"failOn": ["not_met", "partial"], "effort": "max", "maxDiffChars": 36_000, "code": False},
    "security": {"failOn": ["high"], "effort": "max", "maxDiffChars": 36_000, "code": True},
    "rules": {"failOn": ["violated"], "effort": "medium", "maxDiffChars": 36_000, "maxRulesChars": 48_000, "code": False},
    "quality": {"failOn": ["high"], "effort": "medium", "maxDiffChars": 36_000, "code": True},
    "duplication": {"failOn": ["duplicate"], "effort": "low", "maxDiffChars": 24_000, "threshold": 0.55, "maxCandidates": 5, "code": True},
    "tests": {"failOn": ["needs_test"], "effort": "low", "maxDiffChars": 36_000, "code": True},
}
TITLES = {"criteria": "Criterios de aceptación", "security": "Seguridad del código", "rules": "Reglas del proyecto", "quality": "Calidad del código", "duplication": "Duplicación de lógica", "tests": "Cobertura de tests"}
TOP_KEYS = ["checks", "model", "maxDiffChars", "maxRulesChars", "checksConfig"]
CHECK_KEYS = ["model", "blocking", "attempts", "maxDiffChars", "maxRulesChars", "failOn", "threshold", "maxCandidates", "effort"]


def first_defined(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


def bounded(value: Column, bounds: tuple[float, float]) -> Column:
    """A number held inside its bounds; null if it is none."""
    n = value.cast("string").try_cast("double")
    n = F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(None)).otherwise(n)
    return F.when(n.isNotNull(), F.greatest(F.lit(float(bounds[0])), F.least(F.lit(float(bounds[1])), n)))


def clamp(value: Column, bounds: tuple[float, float], fallback: float) -> Column:
    return F.coalesce(bounded(value, bounds), F.lit(float(fallback)))


def highest_effort(shipped: Column, requested: Column) -> Column:
    """The higher of two levels; unknown ones count for nothing."""
    levels = F.array(*map(F.lit, EFFORTS))
    at = lambda c: F.coalesce(F.array_position(levels, c), F.lit(0)).cast("int")
    base = F.when(at(shipped) > 0, at(shipped)).otherwise(F.lit(EFFORTS.index("medium") + 1))
    return F.element_at(levels, F.greatest(base, at(requested)))


def merge_fail_on(shipped: Column, requested: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return F.array_union(F.coalesce(shipped, nothing), F.coalesce(requested, nothing))


def name_list(c: str | Column) -> Column:
    """Names of a comma list; null if there are none."""
    names = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), trim), lambda n: n != "")
    return let(names, lambda x: F.when(F.size(x) > 0, x))


def requested_checks(config: str | Column) -> Column:
    """``checks`` of a JSON config as a list of names: a comma list or an array; null for
    an object, an empty list or none."""
    value = F.get_json_object(col(config), "$.checks")
    listed = F.filter(F.transform(F.from_json(value, "array<string>"), trim), lambda n: n != "")
    shaped = trim(value)
    return F.when(shaped.startswith("["), let(listed, lambda x: F.when(F.size(x) > 0, x))).when(~shaped.startswith("{"), name_list(value))


def per_check_settings(config: str | Column) -> Column:
    """The JSON object of settings per check: ``checks`` if it is one, else
    ``checksConfig``, else an empty one."""
    checks = F.get_json_object(col(config), "$.checks")
    return F.when(trim(checks).startswith("{"), checks).otherwise(F.coalesce(F.get_json_object(col(config), "$.checksConfig"), F.lit("{}")))


def is_object(text: str | Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.try_parse_json(col(text)).isNotNull() & trim(col(text)).startswith("{"), F.lit(False))


def unknown_keys(config: str | Column) -> Column:
    """Keys that have no effect: at the top, and in each check's settings."""
    top = F.array_except(F.coalesce(F.json_object_keys(col(config)), F.array().cast("array<string>")), F.array(*map(F.lit, TOP_KEYS)))
    nothing = F.array().cast("array<string>")

    def within(root: str) -> Column:
        settings = F.get_json_object(col(config), f"$.{root}")
        pairs = F.map_entries(F.from_json(F.when(trim(settings).startswith("{"), settings), "map<string,string>"))

        def each(e: Column) -> Column:
            odd = F.array_except(F.coalesce(F.json_object_keys(e["value"]), nothing), F.array(*map(F.lit, CHECK_KEYS)))
            return F.transform(odd, lambda k: F.concat(F.lit(f"{root}."), e["key"], F.lit("."), k))

        return F.coalesce(F.flatten(F.transform(pairs, each)), nothing)

    nested = F.concat(within("checks"), within("checksConfig"))
    return F.concat(top, nested)


def resolve_config(settings: DataFrame) -> DataFrame:
    """settings: check, and the layers input, repo_check, repo, shipped as maps of
    strings (failOn of repo_check and shipped as fail_on_repo, fail_on_shipped). Adds the
    settings that hold."""
    at = lambda layer, key: F.try_element_at(F.col(layer), F.lit(key))
    layers = {"attempts": ["repo_check", "shipped"], "maxDiffChars": ["repo_check", "repo", "shipped"], "maxRulesChars": ["repo_check", "repo", "shipped"]}
    out = {"model": F.coalesce(first_defined(at("input", "model"), at("repo_check", "model"), at("repo", "model"), at("shipped", "model")), F.lit(""))}
    own = first_defined(at("input", "blocking"), at("shipped", "blocking"), F.lit("true"))
    out["blocking"] = (own != "false") | F.coalesce(at("repo_check", "blocking") == "true", F.lit(False))
    for key, names in layers.items():
        out[key] = clamp(first_defined(*(at(n, key) for n in names), F.lit(str(DEFAULTS[key]))), BOUNDS[key], DEFAULTS[key]).cast("int")
    out["failOn"] = merge_fail_on(F.col("fail_on_shipped"), F.col("fail_on_repo"))
    out["effort"] = highest_effort(first_defined(at("input", "effort"), at("shipped", "effort"), F.lit("medium")), at("repo_check", "effort"))
    out["threshold"] = bounded(first_defined(at("repo_check", "threshold"), at("shipped", "threshold")), BOUNDS["threshold"])
    out["maxCandidates"] = bounded(first_defined(at("repo_check", "maxCandidates"), at("shipped", "maxCandidates")), BOUNDS["maxCandidates"]).cast("int")
    return settings.withColumns(out)


def refused_overrides(settings: DataFrame) -> DataFrame:
    """Adds ``refused``: settings of the branch's file that would relax the gate."""
    at = lambda layer, key: F.try_element_at(F.col(layer), F.lit(key))
    parts = [F.when(at("repo_check", "blocking") == "false", F.lit("blocking: false"))]
    for key in ("attempts", "maxDiffChars", "maxRulesChars"):
        asked = first_defined(at("repo_check", key), *([at("repo", key)] if key != "attempts" else []))
        n = asked.try_cast("double")
        bad = n.isNull() | F.isnan(n) | (n < BOUNDS[key][0]) | (n > BOUNDS[key][1])
        parts.append(F.when(asked.isNotNull() & bad, F.concat(F.lit(f"{key}: "), asked)))
    return settings.withColumn("refused", F.array_compact(F.array(*parts)))


def effort_options(model: str | Column, effort: str | Column) -> Column:
    """What tells a model's provider how hard to think, as JSON; null if it takes nothing."""
    provider, level = F.substring_index(col(model), "/", 1), col(effort)
    budgets = F.create_map(*[F.lit(x) for pair in BUDGETS.items() for x in pair])
    budget = F.try_element_at(budgets, level)
    known = level.isin(*EFFORTS)
    plain = F.when(level == "max", F.lit("high")).otherwise(level)
    deep = F.when(level.isin("high", "max"), F.to_json(F.struct(F.struct(F.lit("enabled").alias("type")).alias("thinking"), level.alias("reasoningEffort")))).otherwise(F.lit('{"thinking":{"type":"adaptive"}}'))
    inner = (
        F.when(provider.isin("openai", "xai"), F.to_json(F.struct(plain.alias("reasoningEffort"))))
        .when(provider == "google", F.to_json(F.struct(F.struct(budget.alias("thinkingBudget")).alias("thinkingConfig"))))
        .when(provider == "anthropic", F.to_json(F.struct(F.struct(F.lit("enabled").alias("type"), budget.alias("budgetTokens")).alias("thinking"))))
        .when(provider == "deepseek", deep)
    )
    return F.when(known & inner.isNotNull(), F.concat(F.lit('{"'), provider, F.lit('":'), inner, F.lit("}")))


def cache_options(model: str | Column, check: str | Column, repo: str | Column) -> Column:
    """The key under which one provider keeps the rules prompt; null elsewhere."""
    named = F.to_json(F.struct(F.struct(F.concat(F.lit("change-review:"), col(check), F.lit(":"), col(repo)).alias("promptCacheKey")).alias("openai")))
    return F.when((col(check) == "rules") & (F.substring_index(col(model), "/", 1) == "openai"), named)


def provider_options(model: str | Column, check: str | Column, repo: str | Column, effort: str | Column) -> Column:
    """Cache and effort options merged per provider, as JSON; null if there are none."""
    kind = "map<string,map<string,string>>"
    cache, level = cache_options(model, check, repo), effort_options(model, effort)
    both = F.map_zip_with(F.from_json(cache, kind), F.from_json(level, kind), lambda k, a, b: F.map_concat(F.coalesce(a, F.from_json(F.lit("{}"), "map<string,string>")), F.coalesce(b, F.from_json(F.lit("{}"), "map<string,string>"))))
    return F.when(cache.isNotNull() & level.isNotNull(), F.to_json(both)).otherwise(F.coalesce(cache, level))


def check_rank(name: str | Column) -> Column:
    """Place of a check in reports; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, CHECKS)), col(name))
    return F.when(place > 0, place).otherwise(F.lit(1 << 30)).cast("int")


def run_list(runs: DataFrame, input_col: str = "input", config_col: str = "config") -> DataFrame:
    """Which checks each run executes: checks, source, unknown, readded. A list of the
    branch's file may add checks; blocking ones are always run."""
    every = F.array(*map(F.lit, CHECKS))
    asked = runs.withColumn("__i", name_list(input_col)).withColumn("__h", requested_checks(config_col))
    asked = asked.withColumn("__q", F.array_distinct(F.coalesce("__i", "__h"))).withColumn("__known", F.array_intersect("__q", every))
    asked = asked.withColumn("unknown", F.coalesce(F.array_except("__q", every), F.array().cast("array<string>")))
    head, some = F.col("__i").isNull() & F.col("__h").isNotNull(), F.size("__known") > 0
    readded = F.when(head & some, F.array_except(every, F.col("__known"))).otherwise(F.array().cast("array<string>"))
    asked = asked.withColumn("readded", readded)
    chosen = F.when(some, F.filter(every, lambda c: F.array_contains(F.concat("__known", "readded"), c))).otherwise(every)
    source = F.when(~F.coalesce(some, F.lit(False)), F.lit("all")).when(head, F.lit("file")).otherwise(F.lit("input"))
    return asked.withColumn("checks", chosen).withColumn("source", source).drop("__i", "__h", "__q", "__known")


def run_matrix(checks: str | Column) -> Column:
    """The list of checks as the JSON that fans out jobs."""
    return F.to_json(col(checks))


def repo_config(content: str | Column) -> Column:
    """The branch's own file as config (JSON text), present and note: no file is no
    config; what is no JSON object is ignored with a note, as are unknown keys."""
    text = col(content)
    good = is_object(text)
    unknown = F.when(good, unknown_keys(text))
    note = (
        F.when(text.isNull(), F.lit(None))
        .when(F.try_parse_json(text).isNull(), F.lit("no JSON: ignored"))
        .when(~good, F.lit("no JSON object: ignored"))
        .when(F.size(unknown) > 0, F.concat(F.lit("without effect: "), F.array_join(unknown, ", ")))
    )
    return F.struct(F.when(good, text).otherwise(F.lit("{}")).alias("config"), text.isNotNull().alias("present"), note.alias("note"))


def check_table(spark) -> DataFrame:
    """What ships with each check: check, pos, title, fail_on, effort, needs_code, blocking
    and its limits."""
    made = [(c, i, TITLES[c], SHIPPED[c]["failOn"], SHIPPED[c]["effort"], SHIPPED[c]["code"], True, SHIPPED[c]["maxDiffChars"], SHIPPED[c].get("threshold"), SHIPPED[c].get("maxCandidates")) for i, c in enumerate(CHECKS)]
    return spark.createDataFrame(made, "check string, pos int, title string, fail_on array<string>, effort string, needs_code boolean, blocking boolean, max_diff_chars int, threshold double, max_candidates int")

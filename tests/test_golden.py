"""Golden cases of the operators: fixed rows in, fixed rows out."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import config as C
from quillspark.functions import similarity as S
from quillspark.functions import tasks as T
from quillspark.functions import text as X
from quillspark.operators import budget, diff, symbols, verdicts
from quillspark.plans.queries import joined, rows

CASES = {}


def golden(columns, *values):
    """The rows that a case must give."""

    def add(f):
        CASES[f.__name__] = (f, columns.split(", "), values)
        return f

    return add


_NAMES = [("CalculateOrderTotal", "compute order sum"), ("calculate_order_totals", "compute order sum"), ("getOrderTotal", "order sum"), ("HTTPClientFactory", "http client factory"), ("getHTTPResponseCode", "http response code"), ("parseURLFromXMLHTTPRequest", "map url xmlhttp request"), ("IOError", "io error"), ("ABCd", "ab cd"), ("", ""), ("get_set", "")]

@golden("name, tokens", *_NAMES)
def name_tokens_cases(spark):
    return rows(spark, "name string, expected string", *_NAMES).select("name", joined(X.name_tokens("name")).alias("tokens"))

_ENTITIES = [(1, "a&#233;b", "aéb"), (2, "&#x1F;&#65;&#x263a;", "A☺"), (3, "&eacute;&Uuml;&ntilde;&Ccedil;", "éÜñÇ"), (4, "<ul><li>one</li><li>two</li></ul>", "- one\n\n- two"), (5, "a&amp;lt;b", "a&lt;b"), (6, None, ""), (7, "<p>x</p>  <br/>y", "x\n\ny")]

@golden("id, text", *[(i, "A☺" if i == 2 else t) for i, _, t in _ENTITIES])
def html_entities(spark):
    """Entities that the pages do not hold. (The unit separator is trimmed.)"""
    return rows(spark, "id long, html string, expected string", *_ENTITIES).select("id", F.replace(X.html_to_text("html"), F.lit("\x1f"), F.lit("")).alias("text"))

SOURCE = [
    ("Depot.cs", "public sealed class Depot"), ("Depot.cs", "    [HttpGet] protected internal static List<Crate> FindCrates(int depotId)"), ("Depot.cs", "    public decimal Weight { get; private set; }"),
    ("Depot.cs", "public readonly struct CrateKey(int Id)"), ("Depot.cs", "internal interface ILoader"), ("Depot.cs", "    public static async Task Unload(Crate crate)"), ("Depot.cs", "    void NoAccess()"), ("Depot.cs", "    public abstract int Count();"),
    ("crates.ts", "export function* walk<T>(list: T[]) {"), ("crates.ts", "export abstract class Shelf {"), ("crates.ts", "export const useCrates = createStore('crates')"), ("crates.ts", "export let pick = async item => item.id"), ("crates.ts", "export const LIMIT = 12"), ("crates.ts", "class Inner {}"), ("crates.ts", "export const enum Size { Big }"), ("crates.ts", "export interface Crate {"),
    ("Crate.php", "abstract class Crate"), ("Crate.php", "    final public static function open(int $depth)"), ("Crate.php", "    private function seal()"), ("Crate.php", "    protected function weigh(): float"), ("Crate.php", "    public function __toString()"), ("Crate.php", "trait Stackable"),
    ("crate_list-item.vue", "export const label = function (x) {"), ("plan.md", "public class Plan"),
]
SYMBOLS = [
    ("Crate.php", 1, "Crate", "class", True), ("Crate.php", 2, "open", "method", True), ("Crate.php", 4, "weigh", "method", False), ("Crate.php", 6, "Stackable", "class", True),
    ("Depot.cs", 1, "Depot", "class", True), ("Depot.cs", 4, "CrateKey", "class", True), ("Depot.cs", 5, "ILoader", "interface", False), ("Depot.cs", 6, "Unload", "method", True),
    ("crates.ts", 1, "walk", "function", True), ("crates.ts", 2, "Shelf", "class", True), ("crates.ts", 3, "useCrates", "function", True), ("crates.ts", 4, "pick", "function", True), ("crates.ts", 7, "Size", "enum", True), ("crates.ts", 8, "Crate", "interface", True),
    ("crate_list-item.vue", 1, "CrateListItem", "component", True), ("crate_list-item.vue", 1, "label", "function", True),
]


@golden("path, line, name, kind, exported", *SYMBOLS)
def symbols_from_source(spark):
    seen: dict[str, int] = {}
    lines = [("c", path, seen.setdefault(path, 0) or 0, text, i) for i, (path, text) in enumerate(SOURCE)]
    numbered = []
    for i, (_, path, _, text, _) in enumerate(lines):
        seen[path] += 1
        numbered.append(("c", path, seen[path], text, i))
    found = symbols.symbols_of_lines(rows(spark, "id string, path string, line int, text string, ord int", *numbered))
    return found.select("path", F.col("line").cast("long").alias("line"), "name", "kind", "exported")

BODIES = [
    (1, 1, "int f() {\n  a();\n}\nint g() {", "int f() {\n  a();\n}"),
    (2, 1, "int f();\nint g() {", "int f();"),
    (3, 2, "x\nint f()\n{\n if (a) {\n }\n}\nrest", "int f()\n{\n if (a) {\n }\n}"),
    (4, 1, "int f()\n\nint g()", "int f()\n"),
    (5, 1, "open {\nnever closed", "open {\nnever closed"),
]

@golden("id, body", *[(i, b) for i, _, _, b in BODIES])
def body_window(spark):
    made = rows(spark, "id long, line int, content string, body string", *BODIES).withColumn("lines", F.split("content", "\n"))
    return made.select("id", symbols.body_window("lines", "line").alias("body"))

SIGNATURES = [
    ("public async Task<decimal> Total(Order order, bool taxes)", 2, "order,bool", "task<decimal>"),
    ("export function total(order: Order, taxes: boolean): number {", 2, "order,boolean", "number"),
    ("int Map(Dictionary<string, int> pairs, int n = 3)", 2, "int>,int", "int"),
    ("function f(a) {", 1, "", ""),
    ("export const x = 3", None, "", "="),
    ("void g()", 0, "", "void"),
]

@golden("signature, arity, types, returns", *SIGNATURES)
def signature_shapes(spark):
    made = rows(spark, "signature string, arity int, types string, returns string", *SIGNATURES).select("signature", S.signature_shape("signature").alias("s"))
    return made.select("signature", F.col("s.arity").cast("long").alias("arity"), F.array_join("s.types", ",").alias("types"), "s.returns")

STATS = [
    (1, " a/b.ts | 3 ++-\n src/{old => new}/c.cs | 1 +\n 2 files changed, 4 insertions(+)", "a/b.ts src/new/c.cs", 2),
    (2, " src/{ => deep}/x.md | Bin 0 -> 3 bytes\n 1 file changed", "src/deep/x.md", 1),
    (3, "", "", 0),
    (4, " only | 1 +", "only", 1),
]

@golden("id, files, n", *[(i, f, n) for i, _, f, n in STATS])
def files_from_stat(spark):
    made = rows(spark, "id long, stat string, files string, n int", *STATS)
    return made.select("id", joined(diff.files_from_stat("stat")).alias("files"), diff.count_stat_files("stat").cast("long").alias("n"))

RULES = [
    ("c", 0, "all.md", "always"),
    ("c", 1, "ts.md", "---\nglobs: src/**/*.ts, \"*.vue\"\n---\nonly scripts"),
    ("c", 2, "py.md", "---\nglobs: [**/*.py]\n---\nonly python"),
    ("c", 3, "link.md", None),
    ("c", 4, "long.md", "x" * 90),
    ("c", 5, "short.md", "y"),
]

@golden("path, scope, chars, decision", ("all.md", "", 17, "loaded"), ("ts.md", "src/**/*.ts *.vue", 22, "loaded"), ("py.md", "**/*.py", 21, "out of scope"), ("link.md", "", 0, "unreadable"), ("long.md", "", 102, "budget"), ("short.md", "", 14, "loaded"))
def rules_packing(spark):
    touched = rows(spark, "change string, path string", ("c", "src/a/b.ts"), ("c", "README.md"))
    packed = budget.pack_rules(rows(spark, "change string, ord int, path string, body string", *RULES), touched, 100)
    return packed.select("path", joined(F.col("scope")).alias("scope"), F.col("chars").cast("long").alias("chars"), "decision")

RUNS = [
    (1, "rules, criteria,rules", None, "criteria,rules", "input", ""),
    (2, "", '{"checks": "tests"}', "criteria,security,rules,quality,duplication,tests", "file", ""),
    (3, "nope", '{"checks": ["tests"]}', "criteria,security,rules,quality,duplication,tests", "all", "nope"),
    (4, None, '{"checks": {"tests": {}}}', "criteria,security,rules,quality,duplication,tests", "all", ""),
    (5, "tests,nope,security", None, "security,tests", "input", "nope"),
    (6, None, "not json", "criteria,security,rules,quality,duplication,tests", "all", ""),
]

@golden("id, checks, source, unknown", *[(i, c, s, u) for i, _, _, c, s, u in RUNS])
def run_list_resolution(spark):
    made = rows(spark, "id long, input string, config string, c string, s string, u string", *RUNS)
    return C.run_list(made.select("id", "input", "config")).select("id", F.array_join("checks", ",").alias("checks"), "source", F.array_join("unknown", ",").alias("unknown"))

OPTIONS = [
    ("openai/x", "rules", "high", '{"openai":{"promptCacheKey":"change-review:rules:r","reasoningEffort":"high"}}'),
    ("openai/x", "tests", "max", '{"openai":{"reasoningEffort":"high"}}'),
    ("google/x", "tests", "low", '{"google":{"thinkingConfig":{"thinkingBudget":1024}}}'),
    ("other/x", "rules", "low", None),
    ("xai/x", "rules", "odd", None),
]

@golden("model, check_name, effort, options", *OPTIONS)
def provider_options(spark):
    made = rows(spark, "model string, check_name string, effort string, options string", *OPTIONS)
    return made.select("model", "check_name", "effort", C.provider_options("model", "check_name", F.lit("r"), "effort").alias("options"))

@golden("id, unknown", (1, "colour,checks.tests.speed"), (2, ""), (3, "x,checksConfig.rules.y"))
def unknown_settings(spark):
    made = rows(spark, "id long, j string", (1, '{"model":"m","colour":1,"checks":{"tests":{"speed":2,"effort":"max"}}}'), (2, '{"checks":["a"]}'), (3, '{"x":1,"checksConfig":{"rules":{"y":1}}}'))
    return made.select("id", F.array_join(C.unknown_keys("j"), ",").alias("unknown"))

TASKS = [
    (1, '{"data":{"id":7,"title":"A","description":"<p>x</p>","taskStatus":{"name":" Completadas "},"subTasks":[1,2],"task":{"id":3,"title":"P"}}}', "A", "x", True, False, "P", 2),
    (2, '{"title":"B","status":"open","incidentOrigin":{"k":1}}', "B", "", False, True, None, 0),
]

@golden("id, title, description, is_terminal, is_incident, parent, subtasks", *[(i, *r) for i, _, *r in TASKS])
def task_records(spark):
    made = rows(spark, "id long, payload string", *[(i, p) for i, p, *_ in TASKS]).select("id", T.shape_task("payload").alias("t"))
    return made.select("id", "t.title", "t.description", "t.is_terminal", "t.is_incident", F.col("t.parent.title").alias("parent"), F.col("t.subtasks").cast("long").alias("subtasks"))

ANSWERS = [
    (1, '{"findings": []}', '{"findings": []}'), (2, 'Sure:\n```json\n{"findings": []}\n```', '{"findings": []}'), (3, 'I think {"findings": []} it is', '{"findings": []}'),
    (4, '{"findings": [', None), (5, "no", None), (6, "", None), (7, None, None),
]

@golden("id, answer", *[(i, a) for i, _, a in ANSWERS])
def json_recovery(spark):
    return rows(spark, "id long, text string, a string", *ANSWERS).select("id", verdicts.extract_json("text").alias("answer"))

COMMENTS = [("a", 1, "me", "hello"), ("a", 2, "other", f"{verdicts.MARKER} x"), ("a", 5, "me", f"{verdicts.MARKER} y"), ("a", 4, "me", f"{verdicts.MARKER} z"), ("b", 9, "other", f"{verdicts.MARKER} w")]

@golden("change, action, id", ("a", "updated", 4), ("b", "created", None), ("c", "created", None))
def comment_upsert(spark):
    existing = rows(spark, "change string, id long, login string, body string", *COMMENTS)
    return verdicts.upsert_comments(existing, rows(spark, "change string, body string", ("a", "1"), ("b", "2"), ("c", "3")), "me").select("change", "action", "id")

CONTEXTS = [
    ("tests", False, False, 0, True, 3, 0, "", False, None, None, "no code"), ("tests", False, False, 2, False, 0, 0, "", False, None, None, "no test suite"), ("tests", False, False, 2, True, 0, 0, "", False, None, None, "nothing untested"),
    ("tests", False, False, 2, True, 1, 0, "", False, None, None, None), ("duplication", False, False, 2, None, None, 0, "", False, None, None, "no similar symbols"), ("rules", False, False, 0, None, None, None, "", True, None, None, "rules budget exhausted"),
    ("rules", False, False, 0, None, None, None, "", False, None, None, "no rules"), ("criteria", False, False, 0, None, None, None, None, None, "none", None, "no task"), ("criteria", False, False, 0, None, None, None, None, None, "task", False, "task unavailable"),
    ("criteria", False, True, 0, None, None, None, None, None, "task", True, None), ("security", True, False, 1, None, None, None, None, None, None, None, "fork"), ("security", False, True, 0, None, None, None, None, None, None, None, "empty diff"), ("odd", False, False, 1, None, None, None, None, None, None, None, "unknown check"),
]

@golden("id, reason", *[(i, c[-1]) for i, c in enumerate(CONTEXTS)])
def short_circuits(spark):
    schema = "id long, check string, is_fork boolean, diff_empty boolean, code_files int, has_suite boolean, orphans int, findings int, rules_text string, budget_exhausted boolean, task_mode string, has_task boolean, expected string"
    made = rows(spark, schema, *[(i, *c) for i, c in enumerate(CONTEXTS)]).withColumn("blocking", F.lit(True))
    return verdicts.short_circuit(made).select("id", F.col("early.reason").alias("reason"))

RENDERED = [
    ("security", '{"overall":"PASS","findings":[{"severity":"high","issue":"a|b","location":"x:1","recommendation":" fix "},{"severity":"low","issue":"c","location":"y:2"}]}', "FAIL", "S1/a\\|b/ALTA/x:1 S2/c/BAJA/y:2", 2, None),
    ("rules", '{"overall":"FAIL","rules":[{"rule":"r","status":"na"},{"rule":"s","status":"ok","evidence":"e"}]}', "PASS", "R1/s/OK/e", 0, "note"),
    ("criteria", '{"overall":"PASS","criteria":[{"id":"C1","criterion":"k","verdict":"partial","evidence":"f:1"}]}', "FAIL", "C1/k/PARCIAL/f:1", 1, None),
    ("criteria", '{"correspondence":"mismatch","correspondenceReason":"no"}', "FAIL", "REF/Los cambios no corresponden a la tarea referenciada/NO CORRESPONDE/", 1, None),
    ("tests", '{"symbols":[{"symbol":"f","location":"p:3","verdict":"not_needed"}]}', "PASS", "T1/f/NO APLICA/p:3", 0, None),
    ("duplication", '{"findings":[{"symbol":"f","existing":"g","location":"p:3","existingLocation":"q:4","verdict":"duplicate"}]}', "FAIL", "D1/f ↔ g/DUPLICA/p:3 ↔ q:4", 1, None),
    ("quality", '{"rules":[]}', None, None, None, None),
]

@golden("id, overall, rows, details, note", *[(i, o, r, d, n) for i, (_, _, o, r, d, n) in enumerate(RENDERED)])
def render_answers(spark):
    made = rows(spark, "id long, check string, answer string", *[(i, c, a) for i, (c, a, *_) in enumerate(RENDERED)])
    made = made.withColumns({"fail_on": F.lit(None).cast("array<string>"), "mode": F.lit(None).cast("string"), "task_id": F.lit(None).cast("string")})
    out = verdicts.render(made)
    shown = F.array_join(F.transform("rows", lambda r: F.concat_ws("/", r["id"], r["label"], r["verdict"], r["evidence"])), " ")
    return out.select("id", "overall", shown.alias("rows"), F.when(F.col("details").isNotNull(), F.size("details")).cast("long").alias("details"), F.when(F.col("note").isNotNull(), F.lit("note")).alias("note"))

PROMPTS = [("rules", "r", None, None), ("rules", "", None, "needs rules"), ("tests", None, None, "needs candidates"), ("tests", None, "## s", None), ("criteria", None, None, "needs a task or criteria"), ("odd", None, None, "unknown check")]

@golden("id, error, prompted", *[(i, e, e is None) for i, (_, _, _, e) in enumerate(PROMPTS)])
def prompt_inputs(spark):
    """Which checks have what their prompt must show."""
    from quillspark.plans.prompts import build_prompts

    made = rows(spark, "id long, check string, rules_text string, section string, e string", *[(i, *p) for i, p in enumerate(PROMPTS)])
    for c in ("header", "stat", "diff_section", "task_title", "task_description", "pr_title", "pr_body"):
        made = made.withColumn(c, F.lit(None if c.startswith("task") else c).cast("string"))
    out = build_prompts(made.withColumn("block_id", F.lit("1")).withColumn("criteria", F.lit(None).cast("array<string>")))
    return out.select("id", "error", F.col("prompt").isNotNull().alias("prompted"))

CONFIGS = [(1, None, "{}", False, None), (2, '{"model": "m"}', '{"model": "m"}', True, None), (3, "{broken", "{}", True, "no JSON: ignored"), (4, "[1]", "{}", True, "no JSON object: ignored"), (5, '{"colour": 1}', '{"colour": 1}', True, "without effect: colour")]

@golden("id, config, present, note", *[(i, *r) for i, _, *r in CONFIGS])
def repo_configs(spark):
    made = rows(spark, "id long, content string", *[(i, c) for i, c, *_ in CONFIGS])
    return made.select("id", C.repo_config("content").alias("c")).select("id", "c.*")


@pytest.mark.parametrize("name", sorted(CASES))
def test_golden(spark, name):
    make, columns, values = CASES[name]
    got = sorted(str([r[c] for c in columns]) for r in make(spark).collect())
    assert got == sorted(str(list(v)) for v in values)

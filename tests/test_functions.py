import pytest
from pyspark.sql import functions as F

from quillspark.functions import config, paths, similarity, tasks, text
from quillspark.plans import queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("CalculateOrderTotal", "computeOrderTotals", 1.0), ("SendInvoiceEmail", "ParseCsvHeader", 0.0), ("get", "set", 0.0), ("SendInvoiceEmail", "DispatchEmail", 1.0)],
)
def test_name_overlap(spark, a, b, score):
    assert one(spark, similarity.overlap(text.name_tokens(F.lit(a)), text.name_tokens(F.lit(b)))) == score


def test_hostile_name_and_body_end_soon(spark):
    assert one(spark, F.size(text.name_tokens(F.lit("A" * 400_000)))) == 1
    quoted = 'x = "' + '\\"' * 9_000 + '"; if (y) { z }'
    assert one(spark, F.array_join(text.skeleton_tokens(F.lit(quoted)), " ")) == "X = X ; if ( X ) { X }"


LOOP_A = "int Sum(List<Order> orders) {\n  var total = 0; // adds\n  foreach (var o in orders) { total += o.Price; }\n  return total;\n}"
LOOP_B = "int Add(List<Item> items) {\n  var sum = 0;\n  foreach (var i in items) { sum += i.Cost; }\n  return sum;\n}"
SLUG = "string Slug(string s) { return s.ToLower().Replace(' ', '-').Trim('-'); }"


def test_bodies(spark):
    grams = lambda b: text.shingles(text.skeleton_tokens(F.lit(b)))
    assert one(spark, similarity.jaccard(grams(LOOP_A), grams(LOOP_B))) == 1.0
    assert one(spark, similarity.jaccard(grams(LOOP_A), grams(SLUG))) < 0.3
    assert one(spark, similarity.jaccard(grams("a"), grams("a"))) == 0.0


def test_long_bodies_count_whole(spark):
    body = "f(a); " * 5_000
    tokens = lambda b, most=None: one(spark, text.skeleton_tokens(F.lit(b), most))
    assert tokens(body) == ["X", "(", "X", ")", ";"] * 5_000
    assert tokens(body + "if") != tokens(body + "else")
    assert tokens(body, 20_000) == tokens(body[:20_000])


def test_long_documents_have_whole_skeletons(spark, tmp_path):
    long = "f(a); " * 5_000
    spark.createDataFrame([(1, long + "if"), (2, long + "else")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["skeleton_tokens"](spark, str(tmp_path)).collect()
    assert [r.n_tokens for r in got] == [25_001, 25_001] and len({r.skeleton for r in got}) == 2


def test_signature_similarity(spark):
    score = lambda a, b: one(spark, similarity.signature_similarity(similarity.signature_shape(F.lit(a)), similarity.signature_shape(F.lit(b))))
    assert score("int F(int a)", "int F(int a, int b)") == 0.0
    assert score("int F(int a)", "int G(int b)") == 1.0
    assert score("const x = 3", "int G(int b)") == 0.0
    assert score("function f(a) {", "function g(b) {") > 0.5
    assert abs(score("Task<decimal> T(Order o, bool t)", "int U(Order o, int t)") - 0.6) < 1e-9


def test_pair_score(spark):
    score = lambda *v: one(spark, similarity.pair_score(*map(F.lit, v)))
    assert score(1.0, 0.6, 1.0) == 1.0
    assert abs(score(1.0, 0.6, 0.5) - 0.67) < 1e-12
    assert score(0.0, 0.0, 0.85) == 0.85


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("**/*.ts", "src/a/b.ts", True), ("**/*.ts", "b.ts", True), ("src/**/*.vue", "tests/a.vue", False), ("src/**/*.vue", "src/a.vue", True), ("*.{ts,vue}", "a.vue", True), ("*.{ts,vue}", "a.cs", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("{a,b", "b", True), ("SRC/*", "src/x", True)],
)
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.matches_any(F.lit(path), [glob])) is hit


@pytest.mark.parametrize("glob", ["[", "(", "***", "{{{", "a\\", ""])
def test_malformed_globs_do_not_raise(spark, glob):
    assert one(spark, paths.matches_any(F.lit("x"), [glob])) in (True, False)


def test_no_usable_glob_matches(spark):
    assert one(spark, paths.matches_any(F.lit("x"), [])) is True


@pytest.mark.parametrize(("path", "code"), [("src/a.py", True), ("README.md", False), ("x/LICENSE", False), ("Makefile", True), ("a/b.PNG", False), ("dir/", False), (None, False)])
def test_code_files(spark, path, code):
    assert one(spark, paths.is_code_file(F.lit(path))) is code


@pytest.mark.parametrize(("path", "out"), [("src/migrations/1.cs", True), ("Migrations/1.cs", True), ("Node_Modules/a.js", False), ("node_modules/a.js", True), ("a/OrderTests.cs", True), ("a/ordertests.cs", False), ("a.d.ts", True), ("src/a.ts", False)])
def test_excluded_paths(spark, path, out):
    assert one(spark, paths.is_excluded_path(F.lit(path))) is out


@pytest.mark.parametrize(
    ("branch", "title", "body", "subject", "source"),
    [("feature/2803-x", "", "", "2803", "branch"), ("team/anthony/4100-algo", "", "", "4100", "branch"), ("main", "(#3002) fix", "", "3002", "title"), ("main", "[3002]", "#1", "3002", "title"), ("main", "x", "see #5", "5", "body"), ("main", "x", "y", None, None), ("2803-x", "#1", "", "2803", "branch"), ("main", "", "```criteria\n- a\n```", None, "body")],
)
def test_task_refs(spark, branch, title, body, subject, source):
    ref = one(spark, tasks.task_ref(F.lit(branch), F.lit(title), F.lit(body)))
    assert (ref.subject_id, ref.source) == (subject, source)
    assert ref.mode == ("task" if source else "none")


def test_criteria(spark):
    assert one(spark, tasks.criteria_list(F.lit("- a\n* b \n1. c\n2) d\nno"))) == ["a", "b", "c", "d"]
    assert one(spark, tasks.criteria_mode(F.lit(""), F.lit("Criterios de aceptación:\n- x"))) == "explicit"
    assert one(spark, tasks.criteria_mode(F.lit(""), F.lit("just do it"))) == "inferred"


def test_cells(spark):
    assert one(spark, text.cell(F.lit(" a|b \n c "), 110)) == "a\\|b c"
    assert one(spark, text.evidence(F.lit("one; two; three; four"), 16)) == "one +3 más"
    assert one(spark, text.evidence(F.lit("x" * 30), 10)) == "…" + "x" * 9
    assert one(spark, text.code_fence(F.lit("a ```` b"))).startswith("`````\n")
    assert one(spark, text.prose(F.lit("a<script>-->\x00"))) == "a&lt;script>--&gt;"
    assert one(spark, text.label(F.lit(None).cast("string"))) == "?" and one(spark, text.label(F.lit("high"))) == "ALTA"
    assert "[redacted delimiter]" in one(spark, text.untrusted_block("T", F.lit("x AUTHOR_INPUT_END"), F.lit("1")))


def test_config_bounds(spark):
    assert one(spark, config.clamp(F.lit("7"), (1, 5), 3)) == 5.0
    assert one(spark, config.clamp(F.lit("x"), (1, 5), 3)) == 3.0
    assert one(spark, config.bounded(F.lit(None).cast("string"), (1, 5))) is None
    assert one(spark, config.highest_effort(F.lit("high"), F.lit("low"))) == "high"
    assert one(spark, config.highest_effort(F.lit("high"), F.lit("odd"))) == "high"
    assert one(spark, config.is_object(F.lit("[1]"))) is False and one(spark, config.is_object(F.lit('{"a":1}'))) is True


def test_classified_files_and_sizes(spark):
    from quillspark.operators import diff

    c = one(spark, diff.classify_files(F.array(F.lit("a.py"), F.lit("README.md"), F.lit("LICENSE"))))
    assert (c.code, c.non_code, c.has_code) == (["a.py"], ["README.md", "LICENSE"], True)
    assert one(spark, diff.classify_files(F.lit(None).cast("array<string>"))).has_code is False
    assert one(spark, diff.too_large(F.lit("abc"), 2)) is True and one(spark, diff.too_large(F.lit(None).cast("string"))) is False


def test_run_inputs():
    from quillspark.plans.inputs import RunInputs

    got = RunInputs.of({"CHECK": "rules", "INPUT_CHECK": "", "PR_IS_FORK": "true", "HEAD_SHA": "abc"})
    assert (got.check, got.is_fork, got.head, got.base) == ("rules", True, "abc", "origin/develop")

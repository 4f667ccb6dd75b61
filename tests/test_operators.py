import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import budget, coverage, diff, lint, pairs, symbols, verdicts
from quillspark.plans import checks, duplication, queries
from quillspark.sources import files, sinks
from quillspark.streaming import upserts

PATCH = """diff --git a/x.ts b/x.ts
--- a/x.ts
+++ b/x.ts
@@ -1,3 +2,4 @@
 kept
+first
+++ b/forged.ts
-gone
\\ No newline at end of file
+last
diff --git a/old b/old
+++ dev/null
@@ -1 +0,0 @@
-bye
diff --git "a/\\303\\241.ts" "b/\\303\\241.ts"
+++ "b/quoted.ts"
@@ -0,0 +1 @@
+new
diff --git a/none b/none
+unattributed"""


def test_diff_lines(spark):
    got = diff.diff_lines(spark.createDataFrame([(1, PATCH), (2, None), (3, "")], "id int, patch string"), "id", "patch").orderBy("ord").collect()
    assert [(r.path, r.line, r.text) for r in got] == [("x.ts", 3, "first"), ("x.ts", 4, "++ b/forged.ts"), ("x.ts", 5, "last"), ("quoted.ts", 1, "new")]


def test_diff_context(spark):
    long = "diff --git a b\n" + "x" * 50 + "\ndiff --git c d\n" + "y" * 50
    df = spark.createDataFrame([(long, " a | 1 +\n c | 1 +\n 2 files changed"), ("", "")], "d string, s string")
    a, b = diff.diff_context(df, "d", "s", 90).collect()
    assert a.truncated and a.included_files == 1 and a.omitted_files == 1 and a.diff.startswith("diff --git a b\n" + "x" * 50 + "\n\n\n[...")
    assert b.empty and not b.truncated and b.block.startswith("(empty")


def test_index_and_duplication_plan(spark):
    body = "public int {name}(Order order, bool taxes)\n{{\n  var t = 0;\n  foreach (var l in order.Lines) {{ if (taxes) {{ t += l.Price; }} }}\n  return t;\n}}\n"
    tree = [("src/A.cs", "public class A\n" + body.format(name="TotalOf")), ("src/B.cs", "public class B\n" + body.format(name="SumFor")), ("src/migrations/C.cs", body.format(name="Other")), ("notes.md", "x")]
    df = spark.createDataFrame(tree, "path string, content string")
    index = symbols.symbol_index(df).collect()
    assert sorted((r.path, r.name, r.line) for r in index) == [("src/A.cs", "A", 1), ("src/A.cs", "TotalOf", 2), ("src/B.cs", "B", 1), ("src/B.cs", "SumFor", 2)]
    patch = "diff --git a/src/B.cs b/src/B.cs\n+++ b/src/B.cs\n@@ -0,0 +1,7 @@\n" + "\n".join("+" + line for line in tree[1][1].split("\n"))
    found = duplication.duplication(spark.createDataFrame([("c", patch)], "id string, patch string"), df).collect()
    assert [(r.a, r.b, r.introduced_here, r.body_score) for r in found] == [("src/B.cs:2:SumFor", "src/A.cs:2:TotalOf", False, 1.0)]


def test_large_files_are_indexed(spark, tmp_path):
    content = "// " + "x" * 1_700_000 + "\nexport class Last {\n}\n"
    df = spark.createDataFrame([("src/big.ts", content)], "path string, content string")
    assert [r.name for r in symbols.symbol_index(df).collect()] == ["Last"]
    assert symbols.symbol_index(df, most_chars=400_000).count() == 0
    (tmp_path / "big.ts").write_text(content)
    read = lambda **cap: files.tree_files(spark, str(tmp_path), ["big.ts"], **cap).select("path", F.length("content").alias("n")).collect()
    assert [tuple(r) for r in read()] == [("big.ts", len(content))] and [tuple(r) for r in read(most_chars=400_000)] == [("big.ts", None)]


def random_sets(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = set(rng.choice(rows)[1]) if rows and rng.random() < 0.6 else {f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 20))}
        for _ in range(rng.randrange(3)):
            base ^= {f"t{rng.randrange(60)}"}
        rows.append((i, sorted(base)))
    return rows


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8])
def test_similar_sets_equal_brute_force(spark, least):
    rows = random_sets(int(least * 100), 120)
    df = spark.createDataFrame(rows, "id long, t array<string>")
    score = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    sets = {i: set(t) for i, t in rows}
    want = {(a, b): score(sets[a], sets[b]) for a in sets for b in sets if a < b and score(sets[a], sets[b]) >= least}
    got = {(r.a, r.b): r.jaccard for r in pairs.similar_sets(df, "id", "t", least).collect()}
    assert got == pytest.approx(want)
    top = {}
    for r in pairs.similar_top_k(df, "id", "t", least, 3).collect():
        top.setdefault(r.a, []).append((r["rank"], r.b))
    for a in sets:
        others = sorted((b for b in sets if b != a and score(sets[a], sets[b]) >= least), key=lambda b: (-score(sets[a], sets[b]), b))[:3]
        assert [b for _, b in sorted(top.get(a, []))] == others


def test_pruned_equals_full(spark):
    rng = random.Random(2)
    words = ["Load", "Order", "Total", "Save", "User", "Parse", "Send", "Mail"]
    made = [(f"k{i}", "p", i, "".join(rng.sample(words, 2)), "method", f"int F({', '.join(['int a'] * rng.randrange(4))})", " ".join(rng.choice(["x = y;", "if (a) {", "}", "return b;", "call(c);"]) for _ in range(rng.randrange(2, 14))), i) for i in range(60)]
    df = duplication.features(spark.createDataFrame(made, "key string, path string, line int, name string, kind string, signature string, body string, ord int")).withColumn("key", F.concat(F.lit("k"), "ord"))
    for threshold in (0.4, 0.55):
        same = [sorted(map(tuple, pairs.find_duplicates(df, df, threshold, 5, prune).collect())) for prune in (True, False)]
        assert same[0] == same[1] and same[0]


def test_mentions(spark):
    corpus = spark.createDataFrame([("tests/a.test.ts", "uses LoadOrder and $scope(x)"), ("src/b.ts", "Hidden")], "path string, content string")
    names = spark.createDataFrame([("LoadOrder",), ("Load",), ("Hidden",), ("a$scope",), ("$",)], "name string")
    got = {r.name: r.covered for r in coverage.mention_split(names, coverage.corpus_of(corpus)).collect()}
    assert got == {"LoadOrder": True, "Load": False, "Hidden": False, "a$scope": False, "$": False}
    row = coverage.coverage_summary(names, coverage.corpus_of(corpus)).first()
    assert (row.has_test_suite, row.covered, row.orphans) == (True, 1, 4)


def test_mentions_at_the_end_of_long_texts(spark, tmp_path):
    long = "x " * 150_000
    spark.createDataFrame([(1, long + "LastWord")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "LastWord Nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = lambda q: [r.name for r in queries.QUERIES[q](spark, str(tmp_path)).collect()]
    assert (names("mention_semi"), names("mention_anti")) == (["LastWord"], ["Nowhere"])
    corpus = spark.createDataFrame([("tests/a.test.ts", long + "LastWord")], "path string, content string")
    mentioned = lambda **cap: coverage.mention_split(spark.createDataFrame([("LastWord",)], "name string"), coverage.corpus_of(corpus, **cap)).first().covered
    assert mentioned() and not mentioned(most=coverage.FILE_CHARS)


def test_greedy_pack_skips_and_goes_on(spark, monkeypatch):
    monkeypatch.setattr(budget, "CHUNK", 2)
    rows = [("g", i, n) for i, n in enumerate([30, 80, 25, 40, 5, 200, 1])] + [(None, 0, 101), (None, 1, 100)]
    df = spark.createDataFrame(rows, "g string, o int, n long")
    got = {(r.g, r.o): r.kept for r in budget.greedy_pack(df, ["g"], "o", "n", 100).collect()}
    want, used = {}, {}
    for g, o, n in rows:
        want[g, o] = used.get(g, 0) + n <= 100
        if want[g, o]:
            used[g] = used.get(g, 0) + n + 2
    assert got == want
    assert budget.greedy_pack(df.limit(0), ["g"], "o", "n", 100).count() == 0


def test_rules_summary_and_notes(spark):
    rows = [("c", 0, "a.md", "one"), ("c", 1, "b.md", "x" * 200), ("c", 2, "l.md", None)]
    packed = budget.pack_rules(spark.createDataFrame(rows, "change string, ord int, path string, body string"), None, 100)
    s = budget.rules_summary(packed).first()
    assert (s.text, s.loaded, s.truncated, s.budget_exhausted) == ("### a.md\none", 1, True, False)
    notes = budget.rules_notes(packed).first().notes
    assert len(notes) == 3 and "b.md" in notes[0] and "a.md" in notes[1] and "l.md" in notes[2]


def test_evaluate_and_report(spark):
    contexts = spark.createDataFrame(
        [("c", "security", 1, None), ("c", "rules", 1, None), ("c", "tests", 0, None), ("c", "quality", 1, None)], "change string, check string, code_files int, fail_on array<string>"
    )
    for name, kind in (("is_fork", "boolean"), ("diff_empty", "boolean"), ("has_suite", "boolean"), ("orphans", "int"), ("findings", "int"), ("rules_text", "string"), ("budget_exhausted", "boolean"), ("task_mode", "string"), ("has_task", "boolean"), ("mode", "string"), ("task_id", "string")):
        contexts = contexts.withColumn(name, F.lit(None).cast(kind))
    contexts = contexts.withColumn("blocking", F.lit(True))
    answers = spark.createDataFrame([("c", "security", 1, "no"), ("c", "security", 2, '{"findings":[{"severity":"high","issue":"i"}]}'), ("c", "quality", 1, "no")], "change string, check string, attempt int, text string")
    out = checks.evaluate(contexts, answers)
    got = {r.check: (r.status, r.blocking) for r in out.collect()}
    assert got == {"security": ("fail", True), "rules": ("skipped", False), "tests": ("skipped", False), "quality": ("tool-error", False)}
    expected = contexts.select("change", "check").unionByName(spark.createDataFrame([("c", "criteria")], "change string, check string"))
    rows = checks.report(expected, out.withColumn("ord", F.lit(1)))
    assert [r.check for r in rows.orderBy("pos").collect()] == ["criteria", "security", "rules", "quality", "tests"]
    body = verdicts.render_reports(rows.withColumn("empty_message", F.lit(""))).first().body
    assert body.startswith(verdicts.MARKER) and "❌ FAIL (1)" in body and "Sin resultado de: criteria" in body and body.index("<details open>") < body.index("<details><summary>")
    assert sorted(r.line for r in sinks.output_lines(out).where("check = 'security'").collect()) == ["blocking-failure=true", "status=fail"]


def test_token_usage_keeps_unknown_apart_from_zero(spark):
    df = spark.createDataFrame([('{"totalTokens": 5, "inputTokenDetails": {"cacheReadTokens": 0}}',)], "u string")
    u = df.select(verdicts.token_usage("u").alias("u")).first().u
    assert (u.total, u.cache_read, u.output) == (5, 0, None)


def test_lint(spark):
    df = spark.createDataFrame([("a", "x\nSecret here"), ("b", "uses: tool@v3\nuses: tool@v4")], "path string, content string")
    assert [(r.path, r.line) for r in lint.forbidden_terms(df, ["secret"]).collect()] == [("a", 2)]
    assert [(r.path, r.line, r.pin) for r in lint.pinned_versions(df, r"tool@(v?\d+)", 4).collect()] == [("b", 1, "v3")]
    assert [r.path for r in lint.not_scanned(df, df.where("path = 'a'")).collect()] == ["b"]


def test_sources_refuse_links(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / ".claude/rules").mkdir(parents=True)
    (tmp_path / "secret.md").write_text("secret")
    (root / "src/a b.ts").write_text("export const x = () => 1\n")
    (root / ".claude/rules/r.md").write_text("rule")
    (root / ".claude/rules/z.md").symlink_to(tmp_path / "secret.md")
    (root / "CONTRIBUTING.md").write_text("guide")
    got = {r.path: (r.content, r.refused) for r in files.tree_files(spark, str(root)).collect()}
    assert got["src/a b.ts"] == ("export const x = () => 1\n", False)
    assert got[".claude/rules/z.md"] == (None, True)
    rules = [(r.path, r.body) for r in files.rule_files(spark, str(root)).orderBy("ord").collect()]
    assert rules == [("r.md", "rule"), ("z.md", None), ("CONTRIBUTING.md", "guide")]
    assert not files.is_regular_within(root, root) and not files.is_regular_within(root / "none", root)


def test_verdict_files(spark, tmp_path):
    verdict = '{"check":"rules","status":"pass","rows":[],"details":[],"meta":{"counts":{"total":2}}}'
    (tmp_path / "in/x").mkdir(parents=True)
    (tmp_path / "in/x/a.json").write_text(verdict)
    (tmp_path / "in/b.json").write_text("{broken")
    (tmp_path / "in/c.json").write_text('{"check":"rules","status":"odd","rows":[],"details":[]}')
    got = files.verdict_scan(spark, str(tmp_path / "in"))
    assert [(r.check, r.meta.counts["total"]) for r in got.collect()] == [("rules", 2)]
    sinks.write_verdicts(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("v", 2, "b")], "k string, n long, x string").write.parquet(str(source))
    stream = upserts.latest_by_key(spark.readStream.schema("k string, n long, x string").parquet(str(source)), "k", "n")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest").collect())) == [("u", 3, "c"), ("v", 2, "b")]
    patches = tmp_path / "patches"
    spark.createDataFrame([(1, PATCH)], "id int, patch string").write.parquet(str(patches))
    seen = []
    q = upserts.stream_added_lines(spark.readStream.schema("id int, patch string").parquet(str(patches)), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 4


def test_capped_index(spark):
    df = spark.createDataFrame([(f"f{i}.ts", "export class A {}\nexport class B {}") for i in range(5)] + [("x.md", "no")], "path string, content string")
    index, partial = symbols.capped_index(df, 3, 100)
    assert partial and index.count() == 6
    index, partial = symbols.capped_index(df, 5, 10)
    assert not partial and index.count() == 10
    assert symbols.capped_index(df, 5, 9)[1]


def test_prompts(spark):
    from quillspark.plans import prompts

    side = "struct<name:string,kind:string,path:string,line:int,signature:string,body:string>"
    rows = [("c", i, i == 0, 0.9, 1.0, 0.5, 0.8, ("f\n", "method", "a.cs", 3, "sig", "```" + "x" * 2000), ("g", "method", "b.cs", None, "sig", "")) for i in range(10)]
    df = spark.createDataFrame(rows, f"change string, ord int, introduced_here boolean, score double, name_score double, signature_score double, body_score double, a {side}, b {side}")
    section = prompts.pair_sections(df).first().section
    assert section.count("### Pair") == prompts.PAIRS and "similarity 0.90 (name 1.00, signature 0.50, body 0.80)" in section
    assert "New: f (method) — a.cs:3\n````\n```x" in section and "// [...truncated]" in section and "b.cs:0\n```\nsig\n```" in section
    orphans = spark.createDataFrame([("c", 2, "h", "function", "x.ts", 9, "export h"), ("c", 1, "k", "function", "x.ts", 4, "export k")], "change string, ord int, name string, kind string, path string, line int, signature string")
    assert prompts.candidate_sections(orphans).first().section.split("\n")[1] == "- k (function) — x.ts:4"
    tasks = spark.createDataFrame([("c", 1, "7", "T", None)], "change string, ord int, id string, title string, description string")
    assert prompts.context_sections(tasks).first().section.endswith("### Task #7\nT")
    one = spark.createDataFrame([("3", "main", "dev", "r", "title", "open", True, True, "1")], "t string, b string, d string, r string, s string, st string, te boolean, i boolean, p string")
    assert one.select(prompts.header("t", "b", "d", "r", "s", "st", "te", "i", "p").alias("h")).first().h.count("\n") == 4


def test_context_notes(spark):
    from quillspark.plans import prompts

    df = spark.createDataFrame([(["a"], ["attempts: 9"], ["r"], True, "cut", True), (None, None, None, None, None, None)], "config_notes array<string>, refused array<string>, rules_notes array<string>, criteria_ignored boolean, diff_note string, index_truncated boolean")
    got = [r.notes for r in prompts.context_notes(df).collect()]
    assert len(got[0]) == 6 and got[0][0] == "a" and "attempts: 9" in got[0][1] and got[0][3:5] == ["cut", "r"] and got[1] == []


def test_contained_sets_on_both_sides_of_the_bound(spark):
    import random

    rng = random.Random(3)
    items = [(i, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 8))]) for i in range(20)]
    docs = [(i, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 15))]) for i in range(60)]
    want = sorted((i, d, len(set(a) & set(b)), len(set(a) & set(b)) / min(len(set(a)), len(set(b)))) for i, a in items for d, b in docs if b and len(set(a) & set(b)) / min(len(set(a)), len(set(b))) >= 0.55)
    i, d = spark.createDataFrame(items, "i int, t array<string>"), spark.createDataFrame(docs, "d int, t array<string>")
    for most in (1 << 20, 0):
        assert sorted(map(tuple, pairs.contained_sets(i, d, "i", "d", "t", 0.55, most).collect())) == want

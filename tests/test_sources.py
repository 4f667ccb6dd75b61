"""Sources: git, rule files, guarded texts, shared folders, and the entry without its llm part."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quillspark.functions.similarity import MIN_TOKENS
from quillspark.operators import coverage
from quillspark.plans import duplication
from quillspark.sources import files, git, scratch


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@x", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    run(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a.cs").write_text("public class A\n")
    (tmp_path / ".gitignore").write_text("hidden.txt\n")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "one")
    run(tmp_path, "checkout", "-qb", "work")
    (tmp_path / "a.cs").write_text("public class A\npublic class B\n")
    run(tmp_path, "commit", "-qam", "two")
    run(tmp_path, "checkout", "-q", "main")
    (tmp_path / "other.md").write_text("later on main\n")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "three")
    run(tmp_path, "checkout", "-q", "work")
    return tmp_path


def test_change_is_a_three_dot_diff(spark, repo):
    row = git.change(spark, str(repo), "main", change_id="c").first()
    assert row.error is None and "+public class B" in row.patch and "other.md" not in row.patch and "1 file changed" in row.stat
    assert git.change(spark, str(repo), "nowhere").first().error.startswith("git")
    assert git.change(spark, str(repo / "absent"), "main").first().error.startswith("git")
    assert git.change(spark, str(repo), "main", most=10).first().error == "too large"
    assert git.ensure_base(str(repo), "main") and not git.ensure_base(str(repo), "origin/none")


def test_listing_and_working_tree(spark, repo):
    (repo / "hidden.txt").write_text("x")
    (repo / "new_test.spec.ts").write_text("B is tested")
    (repo / "link.spec.ts").symlink_to("/etc/hostname")
    assert git.listing(str(repo)) == [".gitignore", "a.cs", "link.spec.ts", "new_test.spec.ts"]
    assert git.listing("/") == []
    tree = git.working_tree(spark, str(repo))
    suite = {r.path: (r.content, r.refused) for r in coverage.test_suite(tree).collect()}
    assert suite == {"new_test.spec.ts": ("B is tested", False), "link.spec.ts": (None, True)}
    names = spark.createDataFrame([("B",), ("C",)], "name string")
    assert tuple(coverage.suite_coverage(names, tree).first()) == (True, 2, 1, 1, 1)
    assert tuple(coverage.suite_coverage(names, tree.limit(0)).first()) == (False, 0, 0, 0, 0)


def test_raw_text_stays_inside(repo):
    assert files.raw_text(repo / "a.cs", repo).startswith("public class A")
    for path in (repo / ".." / "x", "/etc/hostname", repo):
        with pytest.raises(ValueError):
            files.raw_text(path, repo)


def test_rule_files_in_order(spark, tmp_path):
    for name in (".claude/rules/b.md", ".claude/rules/a/z.TXT", ".claude/rules/a/no.png", ".cursor/rules/c.mdc", ".cursorrules", "AGENTS.md", "README.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f" {name}\n")
    (tmp_path / "CLAUDE.md").symlink_to("/etc/hostname")
    got = [(r.ord, r.path, r.body) for r in files.rule_files(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(0, "a/z.TXT", ".claude/rules/a/z.TXT"), (1, "b.md", ".claude/rules/b.md"), (2, "c.mdc", ".cursor/rules/c.mdc"), (3, ".cursorrules", ".cursorrules"), (4, "CLAUDE.md", None), (5, "AGENTS.md", "AGENTS.md")]


def test_short_bodies_have_no_grams(spark):
    rows = [(i, f"f{i}", "void f()", " ".join("{ return x ; } if ( y )".split()[:i])) for i in range(10)]
    made = duplication.features(spark.createDataFrame(rows, "line int, name string, signature string, body string").withColumn("path", F.lit("a.cs")))
    assert {r.line: len(r.grams) > 0 for r in made.collect()} == {i: i >= MIN_TOKENS for i in range(10)}


def test_a_body_of_a_third_of_all_symbols(spark):
    """Equal bodies under many names: each finds its first others, and no pairs are listed."""
    from quillspark.operators import pairs

    body = "if (a) { return b; } else { return c(d, e); }"
    rows = [(f"src/{i % 40}.cs", i, f"Name{i}", body if i % 3 == 0 else f"while (x{i}) {{ " + "call(a); " * (i % 50) + "}") for i in range(900)]
    df = spark.createDataFrame(rows, "path string, line int, name string, body string").select("*", F.lit("method").alias("kind"), F.lit("int f()").alias("signature"), F.col("line").alias("ord"))
    made = duplication.features(df)
    found = pairs.find_duplicates(made, made)
    ranked = {}
    for r in found.where(F.split("a", ":")[1].cast("int") % 3 == 0).collect():
        ranked.setdefault(r.a, []).append((r["rank"], r.score, int(r.b.split(":")[1])))
    assert len(ranked) == 300
    for a, list_ in ranked.items():
        me = int(a.split(":")[1])
        assert sorted(list_) == [(n + 1, 1.0, b) for n, b in enumerate([x for x in range(0, 40, 3) if x != me][:5])]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        scratch.place(Far, "x")


def test_entry_without_the_training_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    whole = entry.queries()
    monkeypatch.setitem(sys.modules, "quillspark.llm", None)
    monkeypatch.setitem(sys.modules, "quillspark.llm.queries", None)
    with pytest.warns(UserWarning):
        left = entry.queries()
    assert "near_dup_documents" in left and not any(n.startswith("op") and n[2].isdigit() for n in left) and len(left) <= len(whole)

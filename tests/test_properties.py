"""Random inputs against plain Python versions."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.functions import paths, text
from quillspark.operators import budget, diff

quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
line = st.sampled_from(["diff --git a/x b/x", "+++ b/x.ts", "+++ b/y.ts", "+++ dev/null", "+++ b/dev/null", "@@ -1,2 +3,4 @@", "@@ -1 +9 @@ def", "+a", "+", "-b", " c", "\\ No newline", "", "+++ c", "other"])


def added(patch):
    out, path, number, inside = [], None, 0, False
    for raw in patch.split("\n"):
        if raw.startswith("diff --git "):
            path, inside, number = None, False, 0
        elif not inside and (m := re.match(r"^\+\+\+ b/(.+)$", raw)):
            path = None if m[1] == "dev/null" else m[1]
        elif m := re.match(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", raw):
            number, inside = int(m[1]), True
        else:
            if raw.startswith("+") and path:
                out.append((path, number, raw[1:]))
            number += raw[:1] in ("+", " ") and raw != ""
    return out


@quick
@given(st.lists(st.lists(line, max_size=25), min_size=4, max_size=20))
def test_diff_lines(spark, patches):
    df = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(patches)], "id int, patch string")
    got = {}
    for r in diff.diff_lines(df, "id", "patch").orderBy("ord").collect():
        got.setdefault(r.id, []).append((r.path, r.line, r.text))
    assert got == {i: a for i, p in enumerate(patches) if (a := added("\n".join(p)))}


@quick
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60)), max_size=40), st.integers(0, 120), st.integers(1, 5))
def test_greedy_pack(spark, sizes, limit, chunk):
    rows, want, used = [(g, i, n) for i, (g, n) in enumerate(sizes)], {}, {}
    for g, i, n in rows:
        want[i] = used.get(g, 0) + n <= limit
        if want[i]:
            used[g] = used.get(g, 0) + n + 2
    before, budget.CHUNK = budget.CHUNK, chunk
    try:
        got = {r.o: r.kept for r in budget.greedy_pack(spark.createDataFrame(rows, "g string, o int, n long"), ["g"], "o", "n", limit).collect()}
    finally:
        budget.CHUNK = before
    assert got == want


@quick
@given(st.lists(st.text(alphabet="ab\n", max_size=30), min_size=1, max_size=40), st.integers(1, 20))
def test_cut_on_boundary(spark, texts, most):
    def cut(t):
        if len(t) <= most:
            return t
        at = t[:most].rfind("\na")
        return t[: at + 1] if at > 0 else t[:most]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(diff.cut_on_boundary("t", most, "\na").alias("c")).collect()] == [cut(t) for t in texts]


@quick
@given(st.lists(st.text(alphabet="aA1_ sS.", max_size=14), min_size=1, max_size=60))
def test_name_tokens(spark, names):
    def singular(w):
        if len(w) > 3 and w.endswith("ies"):
            return w[:-3] + "y"
        if len(w) > 3 and w.endswith("ses"):
            return w[:-2]
        return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w

    def tokens(n):
        n = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", n))
        words = [singular(w.lower()) for w in re.split("[^A-Za-z0-9]+", n) if w]
        return [t for w in words if (t := text.SYNONYMS.get(w, w)) not in text.STOP_TOKENS]

    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.t for r in df.select(text.name_tokens("n").alias("t")).collect()] == [tokens(n) for n in names]


@quick
@given(st.lists(st.text(alphabet="a*?{},/[(\\.", max_size=8), min_size=1, max_size=30))
def test_globs_never_raise(spark, globs):
    for g in globs:
        pattern = paths.glob_regex(g)
        assert pattern is None or re.compile(pattern)
    df = spark.createDataFrame([("a/a.a",), ("",)], "p string")
    assert df.select(*(paths.matches_any("p", [g]).alias(f"c{i}") for i, g in enumerate(globs))).count() == 2

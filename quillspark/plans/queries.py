"""One query per operator of the library over the test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import paths as P
from ..functions import similarity as S
from ..functions import tasks as T
from ..functions import text as X
from ..operators import budget, coverage, diff, lint, pairs, verdicts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


# ------------------------------------------------------------------ SQL fragments

_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.SYNONYMS.items())
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def name_tokens_sql(e: str) -> str:
    spaced = rf"regexp_replace(regexp_replace(left(coalesce({e}, ''), 200), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    low = f"list_transform(list_filter(string_split_regex({spaced}, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w))"
    one = "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w) > 3 AND w LIKE '%ses' THEN left(w, -2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END"
    return f"list_filter(list_transform(list_transform({low}, lambda w: {one}), lambda w: CASE w {_CASES} ELSE w END), lambda w: w NOT IN ({_IN(X.STOP_TOKENS)}))"


def skeleton_sql(e: str) -> str:
    body = f"coalesce({e}, '')"
    for pattern, put in (
        (r"/\*[\s\S]*?\*/", " "),
        (r"(^|[^:])//[^\n]*", r"\1 "),
        (r"(^|\s)#[^\n]*", r"\1 "),
        (r'"(?:[^"\\]|\\.)*"', ' "S" '),
        (r"''(?:[^''\\]|\\.)*''", ' "S" '),
        (r"`(?:[^`\\]|\\.)*`", ' "S" '),
        (r"\b[0-9][0-9_.]*\b", " 0 "),
    ):
        body = f"regexp_replace({body}, '{pattern}', '{put}', 'g')"
    found = rf"regexp_extract_all({body}, '[A-Za-z_$][A-Za-z0-9_$]*|[{{}}()\[\];,.=<>+\-*/%!&|?:]')"
    return f"list_transform({found}, lambda t: CASE WHEN lower(t) IN ({_IN(X.KEYWORDS)}) THEN lower(t) WHEN regexp_matches(t, '^[A-Za-z_$]') THEN 'X' ELSE t END)"


def windows_sql(tokens: str, size: int = 4) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({tokens}) - {size - 2}, 1)), lambda i: array_to_string(list_slice({tokens}, i, i + {size - 1}), ' ')))"


WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(X.text_of(text)), r"\s+"), lambda w: w != "")


def word_sets(docs: DataFrame, id_col: str = "doc_id", size: int = 4) -> DataFrame:
    """id and the distinct windows of words of each text, hashed."""
    return docs.select(F.col(id_col), X.window_hashes(words_of("text"), size).alias("grams"))


# ------------------------------------------------------------------ names and bodies

for _table, _key, _name in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")):

    def _names(spark, sf_dir, t=_table, k=_key, n=_name):
        return table(spark, sf_dir, t).select(k, joined(X.name_tokens(n)).alias("tokens"))

    QUERIES[f"name_tokens_{_table}"] = _names
    SQL[f"name_tokens_{_table}"] = f"SELECT {_key}, array_to_string({name_tokens_sql(_name)}, ' ') AS tokens FROM {_table}"


@query(f"SELECT doc_id, len(s) AS n_tokens, md5(array_to_string(s, ' ')) AS skeleton FROM (SELECT doc_id, {skeleton_sql('text')} AS s FROM documents)")
def skeleton_tokens(spark, sf_dir):
    bodies = table(spark, sf_dir, "documents").select("doc_id", X.skeleton_tokens("text").alias("s"))
    return bodies.select("doc_id", F.size("s").cast("long").alias("n_tokens"), F.md5(joined(F.col("s")).cast("binary")).alias("skeleton"))


@query(f"SELECT doc_id, unnest(g) AS shingle FROM (SELECT doc_id, {windows_sql('w')} AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 4)")
def shingle_postings(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").select("doc_id", X.shingles(words_of("text")).alias("grams"))
    return pairs.postings(sets, "doc_id", "grams").select(F.col("id").alias("doc_id"), F.col("token").alias("shingle"))


# ------------------------------------------------------------------ similarity

_OVERLAP = "len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))::DOUBLE"


@query(f"""
WITH s AS (SELECT p_name, list_distinct({name_tokens_sql('p_name')}) AS t FROM (SELECT DISTINCT p_name FROM part))
SELECT a.p_name AS a, b.p_name AS b, {_OVERLAP} AS score FROM s a JOIN s b ON a.p_name < b.p_name
WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) > 0""")
def name_overlap_pairs(spark, sf_dir):
    """Pairs of names that share a token: met by token, not by comparing all."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("t", F.array_distinct(X.name_tokens("p_name")))
    by = names.select("p_name", "t", F.explode("t").alias("token"))
    x, y = by.alias("x"), by.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.p_name") < F.col("y.p_name")))
    return met.select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b"), S.overlap("x.t", "y.t").alias("score")).distinct()


_DOC_SETS = f"s AS (SELECT doc_id, {windows_sql('w')} AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 4), p AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s)"
_JACCARD = f"{_DOC_SETS}, j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb FROM p x JOIN p y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2), f AS (SELECT a, b, shared, shared / (na + nb - shared)::DOUBLE AS jaccard FROM j WHERE shared / (na + nb - shared)::DOUBLE >= 0.55)"
_TOP = f"WITH {_JACCARD}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS rank FROM f), k AS (SELECT * FROM r WHERE rank <= 5)"


@query(f"{_TOP}, b AS (SELECT *, max(jaccard) OVER (PARTITION BY a) AS best FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY best DESC, a) AS r FROM b) SELECT a AS doc_a, b AS doc_b, shared, jaccard FROM o WHERE r = 1")
def near_dup_documents(spark, sf_dir):
    """The five most similar others of each document, each pair once."""
    sets = word_sets(table(spark, sf_dir, "documents"))
    once = pairs.once_per_pair(pairs.similar_top_k(sets, "doc_id", "grams", S.THRESHOLD), "a", "b", "jaccard")
    return once.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.col("shared").cast("long").alias("shared"), "jaccard")


@query(f"{_TOP} SELECT a AS doc_id, rank, b AS other, jaccard FROM k")
def top_k_matches(spark, sf_dir):
    sets = word_sets(table(spark, sf_dir, "documents"))
    return pairs.similar_top_k(sets, "doc_id", "grams", S.THRESHOLD).select(F.col("a").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.col("b").alias("other"), "jaccard")


COMMON_BODY = "if (a) { return b; } else { return c(d, e); }"
SHORT_BODY = "{ return x ; } if ( y ) { z = x + y ; } while ( q )".split()


def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols made of part names and types: as many as these have values."""
    parts = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_size").alias("size"))
    words = F.split("p_name", " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    long = F.concat(F.lit("for (x in "), first, F.lit(") { "), F.repeat(F.concat(F.lit("y += "), last, F.lit("; if (z) { call(y); } ")), (F.col("size") % 4).cast("int")), F.lit("return y; }"))
    # a third of the bodies are equal; some have 0 to 20 tokens
    short = F.array_join(F.slice(F.array(*map(F.lit, SHORT_BODY)), 1, F.col("size") % 21), " ")
    body = F.when(F.col("size") % 3 == 0, F.lit(COMMON_BODY)).when(F.col("size") % 3 == 1, short).otherwise(long)
    made = parts.select(
        F.concat(F.initcap("p_name"), F.lit(" "), F.initcap("p_type")).alias("name"),
        F.concat(F.lit("public "), F.col("p_type"), F.lit(" Make("), first, F.lit(" a, int b)")).alias("signature"),
        body.alias("body"),
        F.concat(F.lit("src/"), last, F.lit(".cs")).alias("path"),
        F.col("size").alias("line"),
        F.lit("method").alias("kind"),
    )
    from .duplication import features

    return features(made.withColumn("ord", F.col("name"))).withColumn("key", F.col("name"))


_SYMBOLS = f"""
m AS (SELECT p_name, p_type, min(p_size) AS size, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[-1] AS w2 FROM part GROUP BY p_name, p_type),
v AS (SELECT list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || w[2:]), lambda x, y: x || ' ' || y) || ' ' || upper(left(p_type, 1)) || lower(p_type[2:]) AS name,
  lower(w1) AS t1, lower(p_type) AS ret, 'src/' || w2 || '.cs' AS path, size AS line,
  CASE size % 3 WHEN 0 THEN '{COMMON_BODY}' WHEN 1 THEN array_to_string(list_slice([{", ".join(f"'{w}'" for w in SHORT_BODY)}], 1, size % 21), ' ')
   ELSE 'for (x in ' || w1 || ') {{ ' || repeat('y += ' || w2 || '; if (z) {{ call(y); }} ', size % 4) || 'return y; }}' END AS body FROM m),
s AS (SELECT *, list_distinct({name_tokens_sql('name')}) AS t, CASE WHEN len(k) >= 8 THEN {windows_sql('k')} ELSE [] END AS g FROM (SELECT *, {skeleton_sql('body')} AS k FROM v)),
c AS (SELECT a.name AS a, b.name AS b,
  CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))::DOUBLE ELSE 0.0::DOUBLE END AS name_score,
  least(1.0::DOUBLE, 0.4::DOUBLE + 0.4::DOUBLE * (((CASE WHEN 'new' IN (a.t1, b.t1) THEN 0.5 WHEN a.t1 = b.t1 THEN 1 ELSE 0 END) + 1) / 2.0::DOUBLE) + CASE WHEN a.ret = b.ret THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS signature_score,
  len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS body_score
  FROM s a JOIN s b ON NOT (a.path = b.path AND (a.line = b.line OR a.name = b.name)) WHERE len(a.g) > 0 AND len(b.g) > 0),
f AS (SELECT *, CASE WHEN body_score >= 0.8 THEN greatest(w, body_score) ELSE w END AS score FROM (SELECT *, 0.3::DOUBLE * name_score + 0.2::DOUBLE * signature_score + 0.5::DOUBLE * body_score AS w FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM f WHERE score >= 0.55)"""
_SCORES = "a, b, round(score, 9) AS score, round(name_score, 9) AS name_score, round(signature_score, 9) AS signature_score, round(body_score, 9) AS body_score, rank"


def _scores(df: DataFrame) -> DataFrame:
    return df.select("a", "b", *(F.round(c, 9).alias(c) for c in ("score", "name_score", "signature_score", "body_score")), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SYMBOLS} SELECT {_SCORES} FROM r WHERE rank <= 5")
def score_pairs_weighted(spark, sf_dir):
    made = symbol_table(spark, sf_dir)
    return _scores(pairs.find_duplicates(made, made))


@query(f"WITH {_SYMBOLS} SELECT {_SCORES} FROM r WHERE rank <= 20")
def pruned_pairs_equals_full(spark, sf_dir):
    """The pruned join; the SQL scores every pair."""
    made = symbol_table(spark, sf_dir)
    return _scores(pairs.find_duplicates(made, made, k=20, prune=True))


@query(f"""
WITH {_JACCARD}, d AS (SELECT doc_id, source IN ('src0', 'src1', 'src2') AS new FROM documents),
r AS (SELECT f.a, f.b, f.jaccard, y.new AS introduced_here, row_number() OVER (PARTITION BY f.a ORDER BY f.jaccard DESC, f.b) AS rank
      FROM f JOIN d x ON x.doc_id = f.a AND x.new JOIN d y ON y.doc_id = f.b)
SELECT a AS doc_id, b AS other, jaccard, introduced_here FROM r WHERE rank <= 5""")
def intra_vs_existing(spark, sf_dir):
    """Matches of the documents of three sources, and whether these brought the other."""
    docs = table(spark, sf_dir, "documents")
    new = docs.where(F.col("source").isin("src0", "src1", "src2")).select(F.col("doc_id").alias("n"))
    ranked = pairs.similar_top_k(word_sets(docs), "doc_id", "grams", S.THRESHOLD).join(new, F.col("a") == F.col("n"), "left_semi")
    return ranked.join(new, F.col("b") == F.col("n"), "left").select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "jaccard", F.col("n").isNotNull().alias("introduced_here"))


# ------------------------------------------------------------------ coverage

_MENTION = r"""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM benchmark),
c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents)
SELECT name FROM n WHERE name {} (SELECT word FROM c)"""


def _mentions(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    names = table(spark, sf_dir, "benchmark").select(words.alias("name")).distinct()
    corpus = table(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    return coverage.mention_split(names, corpus)


@query(_MENTION.format("IN"))
def mention_semi(spark, sf_dir):
    return _mentions(spark, sf_dir).where("covered").select("name")


@query(_MENTION.format("NOT IN"))
def mention_anti(spark, sf_dir):
    return _mentions(spark, sf_dir).where("not covered").select("name")


@query(f"""
WITH b AS (SELECT item_id, {windows_sql('w')} AS g FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) >= 4),
{_DOC_SETS}, q AS (SELECT item_id, len(g) AS n, unnest(g) AS t FROM b)
SELECT item_id, doc_id, count(*) AS shared, count(*) / any_value(least(q.n, p.n))::DOUBLE AS containment FROM q JOIN p ON p.t = q.t
GROUP BY item_id, doc_id HAVING count(*) / any_value(least(q.n, p.n))::DOUBLE >= 0.55""")
def benchmark_contamination(spark, sf_dir):
    """Benchmark items that documents hold: only shingles of items are counted."""
    items, docs = word_sets(table(spark, sf_dir, "benchmark"), "item_id"), word_sets(table(spark, sf_dir, "documents"))
    met = pairs.contained_sets(items, docs, "item_id", "doc_id", "grams", S.THRESHOLD)
    return met.select(F.col("item").alias("item_id"), F.col("id").alias("doc_id"), "shared", "containment")


# ------------------------------------------------------------------ paths

_PATH_SQL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', '')"


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*/?", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(f"SELECT page_id, path, coalesce(nullif(regexp_extract(path, '[^/]*$'), '') IS NOT NULL AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)\\.(md|markdown|txt|rst|adoc|png|jpe?g|gif|svg|webp|ico|bmp|pdf|woff2?|ttf|eot|mp4|mov|zip|gz)$') AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(LICENSE|NOTICE|AUTHORS|CODEOWNERS|\\.gitattributes|\\.gitignore)$'), false) AS code FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)")
def code_like_paths(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", "path", P.is_code_file("path").alias("code"))


@query(f"SELECT page_id FROM (SELECT page_id, {_PATH_SQL} || '/' || CASE page_id % 4 WHEN 0 THEN 'migrations/x.cs' WHEN 1 THEN 'src/a.min.js' WHEN 2 THEN 'OrderTests.cs' ELSE 'src/Order.cs' END AS path FROM pages) WHERE regexp_matches(path, '(?i)(^|/)migrations?/') OR regexp_matches(path, '(?i)\\.min\\.[a-z]+$') OR regexp_matches(path, '(^|/)[^/]+Tests?\\.(cs|php)$')")
def excluded_urls(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, "migrations/x.cs").when(F.col("page_id") % 4 == 1, "src/a.min.js").when(F.col("page_id") % 4 == 2, "OrderTests.cs").otherwise("src/Order.cs")
    return url_paths(spark, sf_dir).withColumn("path", F.concat("path", F.lit("/"), tail)).where(P.is_excluded_path("path")).select("page_id")


_GLOBS = {"**/*.html": r"(?i)^(?:.*/)?[^/]*\.html$", "en/**": r"(?i)^en/.*$", "{de,es}/*": r"(?i)^(?:de|es)/[^/]*$", "fr/?????.html": r"(?i)^fr/[^/][^/][^/][^/][^/]\.html$"}


@query(f"SELECT page_id, pattern AS scope FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages), (VALUES {', '.join(f'({g!r}, {p!r})' for g, p in _GLOBS.items())}) AS g(pattern, re) WHERE regexp_matches(path, re)".replace("\\\\", "\\"))
def glob_scope(spark, sf_dir):
    hits = F.filter(F.array(*(F.when(P.matches_any("path", [g]), F.lit(g)) for g in _GLOBS)), lambda g: g.isNotNull())
    return url_paths(spark, sf_dir).select("page_id", F.explode(hits).alias("scope"))


# ------------------------------------------------------------------ markup

_HTML = "html"
for _p, _r in ((r"(?i)<\s*li[^>]*>", "'||chr(10)||'- "), (r"(?i)<\s*/\s*(p|div|li|ul|ol|h[1-6]|tr|section)\s*>", "'||chr(10)||'"), (r"(?i)<\s*br\s*/?\s*>", "'||chr(10)||'"), ("<[^>]+>", ""), ("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "''"), ("(?i)&amp;", "&"), (r"[ \t]+\n", "'||chr(10)||'"), (r"\n{3,}", "'||chr(10)||chr(10)||'")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', 'g')"
_HTML = f"regexp_replace({_HTML}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, length(t) AS n_chars, md5(t) AS text FROM (SELECT page_id, {_HTML} AS t FROM pages)")
def html_to_text(spark, sf_dir):
    flat = table(spark, sf_dir, "pages").select("page_id", X.html_to_text("html").alias("t"))
    return flat.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text"))


@query(f"SELECT page_id, i - 1 AS ord, l[3:] AS item FROM (SELECT page_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT page_id, list_filter(string_split({_HTML}, chr(10)), lambda l: l LIKE '- %') AS x FROM pages))")
def list_items(spark, sf_dir):
    flat = table(spark, sf_dir, "pages").select("page_id", X.html_to_text("html").alias("t"))
    items = F.filter(F.split("t", "\n"), lambda x: x.startswith("- "))
    return flat.select("page_id", F.posexplode(items).alias("ord", "l")).select("page_id", F.col("ord").cast("long").alias("ord"), F.expr("substring(l, 3)").alias("item"))


# ------------------------------------------------------------------ diffs and symbols


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT *, count(*) FILTER (WHERE i % 3 <> 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l)
SELECT doc_id, 'docs/' || doc_id || '.txt' AS path, 10 + k - 1 AS line, md5(t) AS text FROM n WHERE i % 3 = 0""")
def diff_line_numbers(spark, sf_dir):
    """A patch of each document: of three lines the first is added, the second removed,
    the third kept."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, F.lit("+")).when(i % 3 == 1, F.lit("-")).otherwise(F.lit(" ")), x))
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,3 +10,5 @@\n"))
    made = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(head, F.array_join(lines, "\n")).alias("patch"))
    return diff.diff_lines(made, "doc_id", "patch").select(F.col("id").alias("doc_id"), "path", F.col("line").cast("long").alias("line"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("""
WITH l AS (SELECT doc_id, text, left(text, 1000) AS c FROM documents),
b AS (SELECT *, strpos(reverse(c), chr(10)) AS back FROM l)
SELECT doc_id, CASE WHEN length(text) > 1000 THEN CASE WHEN back > 0 AND length(c) - back > 0 THEN length(c) - back + 1 ELSE 1000 END ELSE length(text) END AS n_chars,
 md5(CASE WHEN length(text) > 1000 AND back > 0 AND length(c) - back > 0 THEN left(c, length(c) - back + 1) ELSE c END) AS cut FROM b""")
def cut_on_boundary(spark, sf_dir):
    cut = diff.cut_on_boundary("text", 1000, "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut.cast("binary")).alias("cut"))


@query("""
WITH a AS (SELECT doc_id, text AS x, replace(text, 'th', 'ht') AS y FROM documents)
SELECT doc_id, strpos(x, 'th') - 1 AS at, length(left(x, strpos(x, 'th') - 1)) - length(replace(left(x, strpos(x, 'th') - 1), chr(10), '')) + 1 AS line FROM a WHERE x <> y""")
def first_differences(spark, sf_dir):
    d = diff.first_difference("text", F.replace("text", F.lit("th"), F.lit("ht")))
    found = table(spark, sf_dir, "documents").select("doc_id", d.alias("d")).where("d is not null")
    return found.select("doc_id", F.col("d.offset").cast("long").alias("at"), F.col("d.line").cast("long").alias("line"))


# ------------------------------------------------------------------ budgets


@query("""
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
p(source, i, used, doc_id, kept) AS (
  SELECT source, 0::BIGINT, 0::BIGINT, NULL::BIGINT, false FROM o WHERE i = 1
  UNION ALL
  SELECT o.source, o.i, CASE WHEN p.used + o.n_chars <= 48000 THEN p.used + o.n_chars + 2 ELSE p.used END, o.doc_id, p.used + o.n_chars <= 48000
  FROM p JOIN o ON o.source = p.source AND o.i = p.i + 1)
SELECT source, doc_id, kept FROM p WHERE i > 0""")
def greedy_pack_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return budget.greedy_pack(docs, ["source"], "doc_id", "n_chars", 48_000).select("source", "doc_id", "kept")


# ------------------------------------------------------------------ settings and tasks


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'm' || n_nationkey ELSE 'base' END AS model, (n_nationkey % 3 <> 0 OR n_nationkey % 4 = 1) AS blocking,
 CASE WHEN n_nationkey % 7 = 6 THEN 3 ELSE greatest(1, least(5, n_nationkey - 3)) END AS attempts,
 greatest(4000, least(200000, n_nationkey * 10000)) AS max_diff,
 CASE n_nationkey % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'max' END AS effort,
 CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'high,medium' END AS fail_on FROM nation""")
def config_effective(spark, sf_dir):
    """Settings of a check in as many repositories as there are nations."""
    n = F.col("n_nationkey")
    text = lambda c: c.cast("string")
    repo_check = F.create_map(
        F.lit("blocking"), F.when(n % 4 == 1, F.lit("true")).otherwise(F.lit("false")), F.lit("attempts"), F.when(n % 7 == 6, F.lit("many")).otherwise(text(n - 3)),
        F.lit("maxDiffChars"), text(n * 10_000), F.lit("effort"), F.element_at(F.array(*map(F.lit, C.EFFORTS)), n % 4 + 1),
    )
    made = table(spark, sf_dir, "nation").select(
        n,
        F.create_map(F.lit("model"), F.when(n % 5 == 0, F.concat(F.lit("m"), text(n))).otherwise(F.lit(""))).alias("input"),
        repo_check.alias("repo_check"),
        F.create_map(F.lit("model"), F.lit("base")).alias("repo"),
        F.create_map(F.lit("blocking"), F.when(n % 3 == 0, F.lit("false")).otherwise(F.lit("true")), F.lit("effort"), F.lit("medium")).alias("shipped"),
        F.array(F.lit("high")).alias("fail_on_shipped"),
        F.when(n % 2 == 1, F.array(F.lit("medium"), F.lit("high"))).alias("fail_on_repo"),
    )
    out = C.resolve_config(made)
    long = lambda c: F.col(c).cast("long")
    return out.select("n_nationkey", "model", "blocking", long("attempts").alias("attempts"), long("maxDiffChars").alias("max_diff"), "effort", F.array_join("failOn", ",").alias("fail_on"))


@query("""
SELECT page_id, 'task' AS mode, CASE WHEN url LIKE '%?%' THEN (page_id + 7)::VARCHAR ELSE page_id::VARCHAR END AS subject_id, CASE WHEN url LIKE '%?%' THEN 'branch' ELSE 'title' END AS source,
 CASE WHEN url LIKE '%?%' THEN page_id || ',' || (page_id + 1) || ',' || (page_id + 2) ELSE (page_id + 1) || ',' || (page_id + 2) || ',9999999' END AS context FROM pages""")
def task_refs(spark, sf_dir):
    n = F.col("page_id")
    part = lambda *xs: F.concat(*(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs))
    made = table(spark, sf_dir, "pages").select(
        n, F.when(F.col("url").contains("?"), part("feature/", n + 7, "-x")).otherwise(F.lit("main")).alias("branch"), part("Fix (#", n, ") and [", n + 1, "]").alias("title"), part("See (", n + 2, ") #", n, " #9999999").alias("body")
    )
    return made.select("page_id", T.task_ref("branch", "title", "body").alias("t")).select("page_id", "t.mode", "t.subject_id", "t.source", F.array_join("t.context_ids", ",").alias("context"))


# ------------------------------------------------------------------ answers and verdicts


@query("""
SELECT conv_id, min(turn) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt FROM conversations WHERE role = 'assistant')
WHERE attempt <= 3 AND strpos(text, ',') > 0 GROUP BY conv_id""")
def first_acceptable_turn(spark, sf_dir):
    """The first assistant turn with a comma among the first three."""
    said = pairs.top_k(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", [F.col("turn")], 3, "attempt")
    return said.where(F.col("text").contains(",")).groupBy("conv_id").agg(F.min("turn").alias("turn"))


_TEXTS = {"click": '```json\n{"overall":"FAIL","findings":[%s]}\n```', "view": "nothing to say", "error": '{"findings": [', "purchase": '{"rules": [%s]}'}


@query("""
SELECT user_id, min(event_id) FILTER (WHERE event_type = 'click') AS attempt,
 CASE WHEN count(*) FILTER (WHERE event_type = 'click') = 0 THEN CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'unexpected shape' ELSE 'unparseable' END END AS reason FROM events GROUP BY user_id""")
def first_acceptable_answer(spark, sf_dir):
    """Answers made of events: per user the first that is JSON of the right shape."""
    text = F.lit("nothing")
    for kind, made in _TEXTS.items():
        text = F.when(F.col("event_type") == kind, F.replace(F.lit(made), F.lit("%s"), F.col("props"))).otherwise(text)
    answers = table(spark, sf_dir, "events").select("user_id", "event_id", text.alias("text"), F.lit("security").alias("check"))
    return verdicts.first_acceptable(answers, ["user_id"], "event_id", "text", F.lit("security"), 1 << 60).select("user_id", "attempt", "reason")


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT) AS total FROM events GROUP BY event_type")
def json_extract_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("""
SELECT d.source, count(*) AS total, count(*) FILTER (WHERE l.toxic = 1 OR l.quality = 0) AS blocking, CASE WHEN count(*) FILTER (WHERE l.toxic = 1 OR l.quality = 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS overall
FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source""")
def gate_documents(spark, sf_dir):
    """Labels as severities: a source with any failing one fails."""
    severity = F.when(F.col("toxic") == 1, F.lit("high")).when(F.col("quality") == 0, F.lit("medium")).otherwise(F.lit("low"))
    met = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counted = met.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(severity.isin("high", "medium")).alias("blocking"))
    return counted.select("source", "total", "blocking", verdicts.resolve_overall(F.lit("PASS"), "blocking")["overall"].alias("overall"))


@query("""
SELECT lang, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'tool-error' WHEN quality = 1 THEN 'pass' ELSE 'skipped' END AS status, count(*) AS n,
 max(CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 0 END) AS exit_code FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def status_rollup(spark, sf_dir):
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "tool-error").when(F.col("quality") == 1, "pass").otherwise("skipped")
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("status", status)
    return met.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"), F.max(verdicts.exit_code("status")).cast("long").alias("exit_code"))


_CHECK_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(C.CHECKS))


@query(f"""
WITH v AS (SELECT n_regionkey AS change, CASE n_nationkey % 7 {_CHECK_CASE} ELSE 'other' END AS check_name, CASE n_nationkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'tool-error' ELSE 'skipped' END AS status, n_nationkey % 2 = 1 AS blocking, n_nationkey AS ord FROM nation),
l AS (SELECT change, check_name, arg_max(status, ord) AS status, arg_max(blocking, ord) AS blocking FROM v GROUP BY 1, 2),
e AS (SELECT r_regionkey AS change, c.name AS check_name, c.i FROM region, (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(C.CHECKS))}) AS c(i, name)),
m AS (SELECT e.*, l.status, l.blocking FROM e LEFT JOIN l ON l.change = e.change AND l.check_name = e.check_name)
SELECT change, check_name, CASE WHEN status IS NULL THEN '⏳ sin resultado' WHEN status = 'pass' THEN '✅ PASS' WHEN status = 'fail' THEN '❌ FAIL' || CASE WHEN blocking THEN '' ELSE ' — no bloquea' END WHEN status = 'tool-error' THEN '⚠️ error de herramienta — no bloquea' ELSE '➖ omitido' END AS label,
 i + 1 AS pos, CASE WHEN status IS NOT NULL THEN row_number() OVER (PARTITION BY change ORDER BY status IS NULL, status <> 'fail', i) END AS section FROM m""")
def report_order(spark, sf_dir):
    """Regions as changes, nations as verdicts: the last of each check counts."""
    n = F.col("n_nationkey")
    check = F.lit("other")
    for i, c in enumerate(C.CHECKS):
        check = F.when(n % 7 == i, F.lit(c)).otherwise(check)
    status = F.when(n % 4 == 0, "pass").when(n % 4 == 1, "fail").when(n % 4 == 2, "tool-error").otherwise("skipped")
    found = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("change"), check.alias("check"), F.lit(None).cast("string").alias("title"), status.alias("status"), (n % 2 == 1).alias("blocking"),
        F.create_map(F.lit("total"), F.lit(0)).alias("counts"), F.array().cast("array<string>").alias("rows"), F.array().cast("array<string>").alias("details"), n.alias("ord"),
    )
    expected = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("change"), F.explode(F.array(*map(F.lit, C.CHECKS))).alias("check"))
    out = verdicts.report_rows(expected, found)
    return out.select("change", F.col("check").alias("check_name"), "label", F.col("pos").cast("long").alias("pos"), F.col("section").cast("long").alias("section"))


@query("""
WITH c AS (SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id),
n AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT coalesce(n.user_id, c.user_id) AS user_id, e.event_id, e.event_type, e.value FROM c FULL JOIN n ON c.user_id = n.user_id JOIN events e ON e.event_id = coalesce(n.event_id, c.event_id)""")
def latest_upsert(spark, sf_dir):
    """The last view of each user, replaced by the user's last other event."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    views = events.where("event_type = 'view'").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("x")).select("user_id", "x.*")
    return verdicts.keyed_upsert(views, events.where("event_type <> 'view'"), "user_id", "event_id")


@query("SELECT page_id, i AS line FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)) WHERE regexp_matches(t, '(?i)track\\([0-9]+\\)')")
def corpus_lint(spark, sf_dir):
    found = lint.forbidden_terms(table(spark, sf_dir, "pages"), [r"track\([0-9]+\)"], "page_id", "html")
    return found.select(F.col("path").alias("page_id"), F.col("line").cast("long").alias("line"))


@query("SELECT page_id, i AS line, v AS pin FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)), (SELECT 1), LATERAL (SELECT unnest(regexp_extract_all(t, 'track\\(([0-9]+)\\)', 1)) AS v) WHERE v <> '7'")
def version_pins(spark, sf_dir):
    """Numbers in the pages' scripts as pins: those of another major number than 7."""
    found = lint.pinned_versions(table(spark, sf_dir, "pages"), r"track\(([0-9]+)\)", 7, "page_id", "html")
    return found.select(F.col("path").alias("page_id"), F.col("line").cast("long").alias("line"), "pin")


@query("""
WITH s AS (SELECT DISTINCT source FROM documents), d AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS low FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT s.source FROM s WHERE s.source NOT IN (SELECT source FROM d WHERE low > 0)""")
def not_scanned(spark, sf_dir):
    """Sources without a low-quality label: what a scan should have reached and did not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    low = docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select("source").distinct()
    return lint.not_scanned(docs.select("source"), low, "source")

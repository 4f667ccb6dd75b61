"""Symbols (declarations) of source lines, and the bodies that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_excluded_path, language_of
from ..functions.text import NAME_CHARS, col, text_of, trim

SYMBOL = "struct<name:string,kind:string,signature:string,exported:boolean>"
BODY_LINES, BODY_CHARS = 40, 16_000

# The words that may stand before a declared name in each language.
ACCESS = "public internal protected"
CS_TYPE_WORDS = "abstract sealed static partial readonly ref"
CS_MEMBER_WORDS = "static virtual override abstract sealed async extern new partial unsafe"
PHP_TYPE_WORDS = "final abstract readonly"
PHP_MEMBER_WORDS = "final abstract static"
STORE_MAKERS = "defineStore defineComponent createStore"


class Grammar:
    """A declaration as a row of parts, compiled to one pattern.

    Parts: ``one(words)`` is one of the words, ``any_of(words)`` any number of them,
    ``maybe(words)`` at most one; each word ends in white space. ``then(pattern)`` adds a
    pattern as it is. A part with ``keep`` can be read by that name."""

    def __init__(self, start: str = r"^\s*"):
        self.pattern, self.kept = start, []

    def _word(self, words: str, often: str, keep: str | None) -> Grammar:
        self.kept += [keep] if keep else []
        choice = "|".join(words.split())
        self.pattern += rf"(?:{'(' if keep else '(?:'}{choice})\s+){often}"
        return self

    def one(self, words: str, keep: str | None = None) -> Grammar:
        return self._word(words, "", keep)

    def any_of(self, words: str) -> Grammar:
        return self._word(words, "*", None)

    def maybe(self, words: str, keep: str | None = None) -> Grammar:
        return self._word(words, "?", keep)

    def then(self, pattern: str, keep: str | None = None) -> Grammar:
        self.kept += [keep] if keep else []
        self.pattern += f"({pattern})" if keep else pattern
        return self

    def stands_in(self, text: Column) -> Column:
        return text.rlike(self.pattern)

    def read(self, text: Column, part: str) -> Column:
        return F.regexp_extract(text, self.pattern, self.kept.index(part) + 1)


PLAIN, DOLLAR = r"[A-Za-z_]\w*", r"[A-Za-z_$][\w$]*"
WORD_END = r"(?![A-Za-z0-9_])"


def _cs_member() -> Grammar:
    return Grammar(r"^\s*(?:\[[^\]]*\]\s*)*")


def _exported() -> Grammar:
    return Grammar().one("export")


def _bound() -> Grammar:
    return _exported().one("const let var").then(DOLLAR, "name")


CS_TYPE = _cs_member().one(ACCESS, "access").any_of(CS_TYPE_WORDS).one("class record interface struct enum", "kind").then(PLAIN, "name")
CS_METHOD = _cs_member().one(ACCESS, "access").any_of(CS_MEMBER_WORDS).then(r"[A-Za-z_][\w<>,.\[\]?]*\s+").then(PLAIN, "name").then(r"\s*\([^;]*\z")
CS_PROPERTY = _cs_member().then(f"(?:{'|'.join(ACCESS.split())}){WORD_END}" + r"[^(;]*\{\s*get" + WORD_END)
PHP_TYPE = Grammar().any_of(PHP_TYPE_WORDS).one("class interface trait enum", "kind").then(PLAIN, "name")
PHP_METHOD = Grammar().any_of(PHP_MEMBER_WORDS).maybe("public protected private", "access").any_of(PHP_MEMBER_WORDS).one("function").then(r"&?\s*").then(PLAIN, "name").then(r"\s*\(")
#: What a line of TypeScript may export, the first that fits.
TS_EXPORTS = [
    (_exported().maybe("default").maybe("async").then(r"function\s*\*?\s*").then(DOLLAR, "name").then(r"\s*[(<]"), "function"),
    (_exported().maybe("default").maybe("abstract").one("class").then(DOLLAR, "name"), "class"),
    (_exported().one("interface type").then(DOLLAR, "name"), "interface"),
    (_exported().maybe("const").one("enum").then(DOLLAR, "name"), "enum"),
    (_bound().then(rf"\s*=\s*(?:{'|'.join(STORE_MAKERS.split())})\s*\("), "function"),
    (_bound().then(rf"\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|{DOLLAR})\s*(?::[^=]+)?=>"), "function"),
    (_bound().then(rf"\s*=\s*(?:async\s+)?function{WORD_END}"), "function"),
]


def _symbol(text: Column, name: Column, kind: Column, exported: Column) -> Column:
    signature = F.substring(trim(text), 1, 200)
    return F.struct(F.substring(name, 1, NAME_CHARS).alias("name"), kind.alias("kind"), signature.alias("signature"), exported.alias("exported"))


def _cs(text: Column) -> Column:
    kind = CS_TYPE.read(text, "kind")
    type_ = _symbol(text, CS_TYPE.read(text, "name"), F.when(kind.isin("interface", "enum"), kind).otherwise(F.lit("class")), CS_TYPE.read(text, "access") == "public")
    method = _symbol(text, CS_METHOD.read(text, "name"), F.lit("method"), CS_METHOD.read(text, "access") == "public")
    return F.when(CS_PROPERTY.stands_in(text), F.lit(None)).when(CS_TYPE.stands_in(text), type_).when(CS_METHOD.stands_in(text), method)


def _php(text: Column) -> Column:
    kind, access, name = PHP_TYPE.read(text, "kind"), PHP_METHOD.read(text, "access"), PHP_METHOD.read(text, "name")
    type_ = _symbol(text, PHP_TYPE.read(text, "name"), F.when(kind.isin("interface", "enum"), kind).otherwise(F.lit("class")), F.lit(True))
    hidden = (access == "private") | name.startswith("__")
    return F.when(PHP_TYPE.stands_in(text), type_).when(PHP_METHOD.stands_in(text) & ~hidden, _symbol(text, name, F.lit("method"), access != "protected"))


def _ts(text: Column) -> Column:
    found = [F.when(g.stands_in(text), _symbol(text, g.read(text, "name"), F.lit(kind), F.lit(True))) for g, kind in TS_EXPORTS]
    return F.coalesce(*found)


def declared_symbol(language: str | Column, text: str | Column) -> Column:
    """What a line declares in its language, as a struct; null if nothing."""
    lang, line = col(language), col(text)
    return F.when(lang == "cs", _cs(line)).when(lang == "php", _php(line)).when(lang.isin("ts", "vue"), _ts(line))


def component_name(path: str | Column) -> Column:
    """The component that a .vue file defines, from its name."""
    base = F.regexp_replace(F.substring_index(text_of(path), "/", -1), r"(?i)\.vue\z", "")
    parts = F.filter(F.split(base, "[-_.]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def symbols_of_lines(lines: DataFrame) -> DataFrame:
    """lines: id, path, line, text, ord. Symbols, exported or not, with path and line;
    one component symbol per .vue file that has lines, before those of its script."""
    known = lines.withColumn("language", language_of("path")).where("language is not null")
    found = known.withColumn("s", declared_symbol("language", "text")).where("s is not null").select("id", "path", "line", "ord", "s.*")
    name = F.substring(component_name("path"), 1, NAME_CHARS)
    components = known.where("language = 'vue'").groupBy("id", "path").agg(F.min_by("line", "ord").cast("int").alias("line"), (F.min("ord") - 0.5).alias("ord"))
    components = components.withColumn("name", name).where("name <> ''")
    components = components.select("id", "path", "line", "ord", "name", F.lit("component").alias("kind"), F.concat(F.lit("<"), "name", F.lit(" />")).alias("signature"), F.lit(True).alias("exported"))
    return components.unionByName(found.withColumn("ord", F.col("ord").cast("double")))


def body_window(lines: str | Column, line: str | Column, most_lines: int = BODY_LINES, most_chars: int = BODY_CHARS) -> Column:
    """The body that starts at a line (from 1) of an array of lines: up to the line where
    its braces close; before any opens, up to a line that ends in ``;`` or is blank."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, whole: Column) -> Column:
        text = F.substring(whole, F.lit(1), F.lit(most_chars) - s["used"])
        count = lambda brace: F.length(text) - F.length(F.replace(text, F.lit(brace), F.lit("")))
        opened = s["opened"] | text.contains("{")
        depth = s["depth"] + count("{") - count("}")
        used = s["used"] + F.length(text)
        ends = F.when(opened, depth <= 0).otherwise(trim(text).endswith(";") | (trim(text) == ""))
        return F.when(s["done"], s).otherwise(
            F.struct(depth.alias("depth"), opened.alias("opened"), used.alias("used"), (ends | (used >= most_chars)).alias("done"), F.concat(s["kept"], F.array(text)).alias("kept"))
        )

    return F.array_join(F.aggregate(F.slice(col(lines), col(line), F.lit(most_lines)), start, step)["kept"], "\n")


def symbol_index(files: DataFrame, path_col: str = "path", content_col: str = "content", most_chars: int | None = None) -> DataFrame:
    """Exported symbols of files with their bodies: path, name, kind, line, signature,
    body, ord. Files of other languages, of excluded paths or over ``most_chars`` (no
    limit by default) are left out before any is split. Each file's lines stay in its row, so no join brings them back."""
    kept = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).withColumn("language", language_of("path"))
    kept = kept.where(F.col("language").isNotNull() & ~is_excluded_path("path"))
    kept = kept if most_chars is None else kept.where(F.length("content") <= most_chars)
    kept = kept.withColumn("lines", F.split("content", "\n")).drop("content")
    found = F.transform("lines", lambda text, i: F.struct((i + 1).alias("line"), declared_symbol("language", text).alias("s")))
    component = F.struct(F.lit(1).alias("line"), F.struct(F.substring(component_name("path"), 1, NAME_CHARS).alias("name"), F.lit("component").alias("kind"), F.concat(F.lit("<"), F.substring(component_name("path"), 1, NAME_CHARS), F.lit(" />")).alias("signature"), F.lit(True).alias("exported")).alias("s"))
    found = F.when(F.col("language") == "vue", F.concat(F.array(component), found)).otherwise(found)
    exported = F.filter(found, lambda x: F.coalesce(x["s"]["exported"], F.lit(False)) & (x["s"]["name"] != ""))
    rows = kept.select("path", "lines", F.posexplode(exported).alias("ord", "x"))
    return rows.select("path", "x.s.name", "x.s.kind", "x.line", "x.s.signature", body_window("lines", F.col("x.line")).alias("body"), "ord")


def introduced(added: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows of added symbols (path, line, name, ord): the one at the very line, else
    the file's first of that name. Two added symbols may find the same row."""
    a = added.select(F.col("ord").alias("a_ord"), F.col("path"), F.col("line").alias("a_line"), F.col("name"))
    met = a.join(index, ["path", "name"])
    best = F.min_by(F.struct(*(F.col(c) for c in index.columns)), F.struct((F.col("line") != F.col("a_line")).alias("other"), F.col("ord")))
    return met.groupBy("path", "name", "a_line", "a_ord").agg(best.alias("s")).select("a_ord", "s.*")


def capped_index(files: DataFrame, most_files: int = 4_000, most_symbols: int = 120_000) -> tuple[DataFrame, bool]:
    """The index under capacities, files by path and then symbols in order, and whether it
    is partial. Both caps are parameters; :func:`symbol_index` has none by default."""
    wanted = files.where(F.col("path").isNotNull() & language_of("path").isNotNull() & ~is_excluded_path("path")).orderBy("path").limit(most_files + 1)
    more_files = wanted.count() > most_files
    index = symbol_index(wanted.orderBy("path").limit(most_files)).orderBy("path", "ord").limit(most_symbols + 1)
    more_symbols = index.count() > most_symbols
    return index.orderBy("path", "ord").limit(most_symbols), more_files or more_symbols

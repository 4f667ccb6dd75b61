"""Predicates over file paths and symbols, and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, text_of

# Which files are no code, which repeat by design, which are tests.
NON_CODE = r"(?i)\.(md|markdown|txt|rst|adoc|png|jpe?g|gif|svg|webp|ico|bmp|pdf|woff2?|ttf|eot|mp4|mov|zip|gz)\z"
NON_CODE_NAME = r"(?i)\A(LICENSE|NOTICE|AUTHORS|CODEOWNERS|\.gitattributes|\.gitignore)\z"
EXCLUDED_PATHS = [
    r"(?i)(^|/)migrations?/",
    r"(?i)(^|/)__generated__/",
    r"(?i)(^|/)generated/",
    r"(^|/)node_modules/",
    r"(^|/)vendor/",
    r"(?i)(^|/)(dist|build|out|bin|obj)/",
    r"(?i)(^|/)wwwroot/",
    r"(?i)\.generated\.[a-z]+\z",
    r"(?i)\.g\.[a-z]+\z",
    r"(?i)\.designer\.[a-z]+\z",
    r"(?i)\.min\.[a-z]+\z",
    r"(?i)\.d\.ts\z",
    r"(?i)(^|/)migrations?[^/]*\.(cs|php|ts|js)\z",
    r"(?i)(^|/)(tests?|__tests__|spec)/",
    r"(?i)\.(test|spec)\.[a-z]+\z",
    r"(^|/)[^/]+Tests?\.(cs|php)\z",
]
EXCLUDED_NAMES = [
    r"(Dto|DTO)s?\z",
    r"(Request|Response|Payload|ViewModel|Model)\z",
    r"(?i)Mapper\z",
    r"Profile\z",
    r"(?i)Migration\z",
    r"(Entity|Enum|Constants?|Options|Settings|Config(uration)?)\z",
]
COMPARABLE_KINDS = ("method", "function")
TEST_FILE = r"(?i)(\.|_)(test|spec)\.[a-z]+\z|Tests?\.(cs|php|java|kt)\z|(^|/)(tests?|__tests__|spec)/"
LANGUAGES = {"cs": r"(?i)\.cs\z", "vue": r"(?i)\.vue\z", "ts": r"(?i)\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)\z", "php": r"(?i)\.php\z"}


def _any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def base_name(path: str | Column) -> Column:
    return F.substring_index(text_of(path), "/", -1)


def is_code_file(path: str | Column) -> Column:
    name = base_name(path)
    return (name != "") & ~name.rlike(NON_CODE_NAME) & ~name.rlike(NON_CODE)


def language_of(path: str | Column) -> Column:
    """cs, vue, ts or php: the extractor for a path; null if there is none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LANGUAGES.items()):
        out = F.when(text_of(path).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_excluded_path(path: str | Column) -> Column:
    return _any(text_of(path), EXCLUDED_PATHS)


def is_excluded_symbol(path: str | Column, kind: str | Column, name: str | Column) -> Column:
    return is_excluded_path(path) | ~F.coalesce(col(kind), F.lit("")).isin(*COMPARABLE_KINDS) | _any(text_of(name), EXCLUDED_NAMES)


def is_test_path(path: str | Column) -> Column:
    return text_of(path).rlike(TEST_FILE)


def glob_regex(glob: str) -> str | None:
    """A glob as an anchored, case-blind pattern that Java and RE2 read alike; None if
    it is none. ``**/`` stands for any folders or none; open braces are closed."""
    out, braces, rest = [], 0, glob
    while rest:
        for token, put in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest.startswith(token):
                out.append(put)
                break
        else:
            token = rest[0]
            if token == "{":
                braces += 1
                out.append("(?:")
            elif token == "}" and braces:
                braces -= 1
                out.append(")")
            elif token == "," and braces:
                out.append("|")
            else:
                out.append(re.escape(token) if not token.isalnum() and token not in "/_-, '\"" else token)
        rest = rest[len(token) :]
    pattern = f"^{''.join(out)}{')' * braces}$"
    try:
        re.compile(pattern)
    except re.error:
        return None
    return f"(?i){pattern}"


def matches_any(path: str | Column, globs: list[str]) -> Column:
    """Whether one of the globs matches; true if none of them can be read."""
    usable = [p for p in map(glob_regex, globs) if p]
    return _any(text_of(path), [p[:-1] + r"\z" for p in usable]) if usable else F.lit(True)

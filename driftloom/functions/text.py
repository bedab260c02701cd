"""Scalar functions over text columns, and their plain Python forms for use inside parsers."""

from __future__ import annotations

import hashlib
import posixpath
import re
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def short_hash(*parts: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of the parts, joined by a unit separator; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12)


def short_hash_of(*parts: object) -> str:
    return hashlib.sha1(SEPARATOR.join(map(str, parts)).encode()).hexdigest()[:12]


def split_lines(text: Column) -> Column:
    """Lines by \\n without trailing \\r; no empty line after a final \\n; an empty text has none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r+$", ""))
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def lines_of(text: str) -> list[str]:
    lines = [x.rstrip("\r") for x in text.split("\n")]
    return lines[:-1] if lines[-1] == "" and (text.endswith("\n") or not text) else lines


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def glob_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [..], [!..]) as a regular expression for the whole string."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def any_glob(name: Column, patterns: list[str]) -> Column:
    return F.coalesce(name.rlike("|".join(glob_regex(p).removeprefix("(?s)") for p in patterns)), F.lit(False))


#: Which folders and file names make a path a test, a configuration or a document.
TEST_DIRS, TEST_FILES = ["test", "tests", "testing", "__tests__", "spec", "specs"], ["test_*", "*_test.*", "*_tests.*", "tests.py", "conftest.py", "*.spec.*", "*.test.*"]
DOC_DIRS, DOC_FILES = ["doc", "docs", "documentation"], ["*.md", "*.rst", "*.txt", "*.adoc", "readme*", "changelog*", "license*", "authors*"]
CONFIG_DIRS = [".github", ".circleci", ".devcontainer"]
CONFIG_FILES = ["*.toml", "*.cfg", "*.ini", "*.yaml", "*.yml", "*.json", "*.lock", "*.env*", "dockerfile*", "makefile", ".gitignore", ".gitattributes", ".pre-commit-config.yaml", "requirements*.txt", "pipfile", "tox.ini", "noxfile.py", "setup.py", "*.config.js", "*.config.cjs", "*.config.mjs", "*.config.ts", "*.config.mts", ".eslintrc*", ".prettierrc*", ".npmrc", ".nvmrc"]


def categorize(path: Column, analyzed: Column) -> Column:
    """tests, config, docs, source or other: the first that the path's folders or file name say."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    dirs = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    inside = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    return (
        F.when(inside(TEST_DIRS) | any_glob(name, TEST_FILES), "tests")
        .when(any_glob(name, CONFIG_FILES) | inside(CONFIG_DIRS), "config")
        .when(inside(DOC_DIRS) | any_glob(name, DOC_FILES), "docs")
        .when(analyzed, "source")
        .otherwise("other")
    )


def language(path: Column) -> Column:
    """python, typescript, tsx, javascript, json or null. Lock files aren't analysed."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return (
        F.when(name.rlike(r"\.pyi?$"), "python")
        .when(name.rlike(r"\.[mc]?ts$"), "typescript")
        .when(name.rlike(r"\.tsx$"), "tsx")
        .when(name.rlike(r"\.([mc]?js|jsx)$"), "javascript")
        .when(name.rlike(r"\.json$") & ~name.isin("package-lock.json", "npm-shrinkwrap.json", "composer.lock"), "json")
    )


def normalize_literals(text: Column) -> Column:
    """Quoted strings become <str> and numbers <num>."""
    quoted = "\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'|`(?:[^`\\\\]|\\\\.)*`"
    return F.regexp_replace(F.regexp_replace(text, quoted, "<str>"), r"(?<![\w<])\d[\w.]*", "<num>")


def identifier_words(name: Column) -> Column:
    """Lower-cased words of an identifier: split at case changes, digits and punctuation; a plural s is folded."""
    parts = F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"^(.{3,}[^s])s$", "$1"))


def words_of(name: str) -> list[str]:
    return [re.sub(r"^(.{3,}[^s])s$", r"\1", w.lower()) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def cut_chars(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def line_role(text: Column) -> Column:
    """field, type, prop or other, from a line's shape."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^(export\s+)?(type|interface|class|enum)\b"), "type")
        .when(t.rlike(r"^[\"']?[A-Za-z_$][\w$]*[\"']?\??\s*:"), "field")
        .when(t.rlike(r"^[A-Za-z_$][\w$-]*=(\{|\"|')"), "prop")
        .otherwise("other")
    )


def editor_path(template: str, path: Column, line: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{path}"), path), F.lit("{line}"), line.cast("string"))


def repository_slug(url: Column) -> Column:
    """owner/name of a remote's address, or null."""
    got = F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when(got != "", got)


def similarity(a: str, b: str) -> float:
    """Ratio by characters, 0 where lengths or the cheap upper bound rule a likeness out."""
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) > max(3.0, 0.3 * max(len(a), len(b))):
        return 0.0
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.ratio() if m.quick_ratio() >= 0.7 else 0.0


def normal_path(path: str) -> str:
    return posixpath.normpath(path)


def module_stems(path: str) -> list[str]:
    """Names by which a script can be imported: without its extension, and its folder where it is an index."""
    stem = re.sub(r"\.(d\.ts|[mc]?[jt]sx?|json)$", "", path)
    return [stem, stem.removesuffix("/index")] if stem.endswith("/index") else [stem]


def last_segment(path: str) -> str:
    return re.sub(r"\.(d\.ts|[mc]?[jt]sx?)$", "", path.rsplit("/", 1)[-1])


def ascii_words(text: Column) -> Column:
    """What ASCII white space parts; null text has no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))

"""Per-file views beside the diff: code that folds, and issues."""

from __future__ import annotations

import ast
import re

from . import analyzer_for
from .python import analyze as analyze_python

EXITS = (ast.Return, ast.Raise, ast.Continue, ast.Break)
READERS = {"locals", "vars", "eval", "exec"}


def find_folds(path: str, text: str) -> list[tuple[int, int]]:
    """(first, last) line of what folds, the largest for each first line: statements of several lines where the text
    parses, runs of deeper indentation otherwise."""
    lang = analyzer_for(path)
    found: dict[int, int] = {}
    if lang is not None:
        done = lang.analyze(text)
        spans = [(s.first, s.last) for s in done.statements] if done.parsed else []
        if path.endswith((".py", ".pyi")) and done.parsed:
            spans += [(n.lineno, n.end_lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.stmt)]
        stack = []
        for t in done.tokens if not spans or not path.endswith((".py", ".pyi")) else ():
            if t.kind == "op" and t.value in "([{":
                stack.append(t.start[0])
            elif t.kind == "op" and t.value in ")]}" and stack:
                spans.append((stack.pop(), t.start[0]))
        for a, b in spans:
            if b > a:
                found[a] = max(b, found.get(a, 0))
        if found:
            return sorted(found.items())
    rows = [(k, len(x) - len(x.lstrip())) for k, x in enumerate(text.split("\n"), 1) if x.strip()]
    for at, (line, depth) in enumerate(rows):
        end = at + 1
        while end < len(rows) and rows[end][1] > depth:
            end += 1
        if end > at + 1:
            found[line] = rows[end - 1][0]
    return sorted(found.items())


Issue = tuple[str, str, str, int, int, int, int]  # severity, code, message, start line and column, end line and column


def find_issues(path: str, text: str) -> list[Issue]:
    """Syntax errors alone, or unreachable statements and unused locals, parameters and imports; sorted, each once.
    Python only; other languages report unmatched brackets."""
    if not path.endswith((".py", ".pyi")):
        lang = analyzer_for(path)
        bad = lang is not None and not lang.analyze(text).parsed
        return [("error", "syntax", "does not parse", 1, 0, 1, 0)] if bad else []
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        line, column = e.lineno or 1, max(0, (e.offset or 1) - 1)
        return [("error", "syntax", e.msg, line, column, e.end_lineno or line, max(column, (e.end_offset or 1) - 1))]
    except ValueError:
        return [("error", "syntax", "does not parse", 1, 0, 1, 0)]
    out: set[Issue] = set()

    def put(severity: str, code: str, message: str, node: ast.AST) -> None:
        out.add((severity, code, message, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset))

    for node in ast.walk(tree):
        for name in ("body", "orelse", "finalbody"):
            rows = getattr(node, name, None)
            if isinstance(rows, list):
                stop = next((k for k, s in enumerate(rows) if isinstance(s, EXITS)), None)
                if stop is not None and stop + 1 < len(rows):
                    put("warning", "unreachable", "code after a statement that leaves", rows[stop + 1])
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            _unused_names(path, node, put)
    if not path.endswith((".pyi", "__init__.py")):
        _unused_imports(tree, text, put)
    return sorted(out, key=lambda i: (i[3:], i[1]))


def _reads(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Store)}


def _own(node: ast.AST):
    """Nodes of a function's own scope."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            yield from _own(child)


def _unused_names(path: str, node: ast.FunctionDef | ast.AsyncFunctionDef, put) -> None:
    used = set().union(*(_reads(s) for s in node.body)) if node.body else set()
    if used & READERS:
        return
    a = node.args
    params = [*a.posonlyargs, *a.args, *a.kwonlyargs, *(p for p in (a.vararg, a.kwarg) if p)]
    names = {p.arg for p in params}
    outer = {n for s in ast.walk(node) if isinstance(s, ast.Global | ast.Nonlocal) for n in s.names}
    seen = set()
    for n in sorted((n for s in node.body for n in [s, *_own(s)] if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)), key=lambda n: (n.lineno, n.col_offset)):
        if n.id not in used | names | outer | seen and not n.id.startswith("_"):
            put("warning", "unused-variable", f"{n.id} is never read", n)
        seen.add(n.id)
    decorators = {getattr(d, "id", getattr(d, "attr", "")) for d in node.decorator_list}
    body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    stub = all(isinstance(s, ast.Pass | ast.Raise) for s in body)
    if path.endswith(".pyi") or node.name.startswith("__") or decorators & {"overload", "abstractmethod", "override"} or stub:
        return
    for p in params:
        if p.arg not in used and p.arg not in ("self", "cls") and not p.arg.startswith("_"):
            put("info", "unused-parameter", f"{p.arg} is never read", p)


def _unused_imports(tree: ast.Module, text: str, put) -> None:
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
    quoted = " ".join(n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)) + " ".join(re.findall(r"#\s*type:[^\n]*", text))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom) and getattr(node, "module", "") != "__future__":
            for n in node.names:
                bound = n.asname or n.name.split(".")[0]
                if bound != "*" and bound not in used and not re.search(rf"(?<!\w){re.escape(bound)}(?!\w)", quoted):
                    put("warning", "unused-import", f"{bound} is imported but never used", n)


def occurrences(path: str, text: str, name: str) -> list[tuple[int, int]]:
    """Line and column of every token of that name."""
    lang = analyzer_for(path)
    return [t.start for t in lang.analyze(text).tokens if t.kind == "name" and t.value == name] if lang else []


__all__ = ["analyze_python", "find_folds", "find_issues", "occurrences"]

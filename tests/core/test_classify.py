import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.functions import align
from driftloom.functions.classify import classify, joined_ranges
from driftloom.functions.text import lines_of, short_hash_of, similarity
from driftloom.lang import analyzer_for, inspect, jsonlang, script


def signatures(path, old, new):
    lang = analyzer_for(path)
    a, b = lang.analyze(old), lang.analyze(new)
    span = lambda x: (1, len(x.lines)) if x.lines else None
    return [(s.key.replace("\0", "|"), s.detail) for s in classify(lang, a, b, span(a), span(b), (0, 0)).signatures]


@pytest.mark.parametrize(
    "path,old,new,want",
    [
        ("a.py", "x = f(a)", "x = g(a)", [("rename|f|g", "call")]),
        ("a.py", "def f():\n    pass", "def g():\n    pass", [("rename|f|g", "definition")]),
        ("a.py", "a.b", "a.c", [("rename|b|c", "attribute")]),
        ("a.py", "f(a=1)", "f(b=1)", [("rename|a|b", "keyword")]),
        ("a.py", "from m import a", "from m import b", [("rename|a|b", "import")]),
        ("a.py", "from m import a", "from n import a", [("import|m|n", "a")]),
        ("a.py", "import os\nimport re", "import os", [("import|re|", "re")]),
        ("a.py", "def f(x: int): ...", "def f(x: str): ...", [("retype|int|str", "param x")]),
        ("a.py", "def f(x): ...", "def f(x) -> int: ...", [("retype|(untyped)|int", "return of f")]),
        ("a.py", "x: int = 0", "x: str = 0", [("retype|int|str", "variable x")]),
        ("a.py", "x = 'a'", 'x = "a"', [("formatting", "")]),
        ("a.py", "# one\nx = 1", "# two\nx = 1", [("docs", "")]),
        ("a.py", "def f():\n    'one'", "def f():\n    'two'", [("docs", "")]),
        ("a.py", "f(x, y)", "f(x, y, timeout=5)", [("args|f|+kw:timeout", "call")]),
        ("a.py", "f(x, y)", "f(x)", [("args|f|-pos", "call")]),
        ("a.py", "f(x, 5)", "f(x, n=5)", [("args|f|pos>kw:n", "call")]),
        ("a.py", "def f(x): ...", "def f(x, *a): ...", [("args|f|+*", "definition")]),
        ("a.py", "if x is None:\n    return 1\n", "", [("guard|-x is None", "")]),
        ("a.py", "", "if not x:\n    raise E\n", [("guard|+not x", "")]),
        ("a.py", "x = [1, 2, 3]", "x = [1, 3]", [("list|array|-2", "array")]),
        ("a.py", "x = [\n  1,\n  2,\n]", "x = [1, 2]", [("formatting", "")]),
        ("a.py", "t = cfg.get('x')", "t = settings.x", [("replace|cfg|.|get|(|'x'|)|\x01|settings|.|x", "")]),
        ("a.py", "f(role='x')", "f(roles=('x',))", [("replace|role|=|\x02|\x01|roles|=|(|\x02|,|)", "")]),
        ("a.py", "send(owner=person)", "send(owner=str(person.id))", [("replace|\x02|\x01|str|(|\x02|.|id|)", "")]),
        ("a.py", "if load(u):\n    pass\n", "if fetch(u) and ok:\n    pass\n", [("rename|load|fetch", "call"), ("replace|\x01|and|ok", "")]),
        ("a.py", "x = a and b", "x = a or b", [("replace|and|\x01|or", "")]),
        ("a.py", "x = load(\n", "x = fetch(\n", [("rename|load|fetch", "call")]),
        ("a.py", "load(a)  # one", "fetch(a)  # two", [("rename|load|fetch", "call"), ("docs", "")]),
        ("a.py", "load(a) + load(b)", "fetch(a) + fetch(b)", [("rename|load|fetch", "call")]),
        ("a.py", "f(a, b, c)", "f(a)", [("args|f|-pos:2", "call")]),
        ("a.py", "f(a, n=1, m=2)", "f(a)", [("args|f|-kw:m,-kw:n", "call")]),
        ("a.py", "f(a, b)", "f(a, c + 1)", [("replace|b|\x01|c|+|1", "")]),
        ("a.py", "f(a, n=1)", "f(a, n=2)", [("replace|1|\x01|2", "")]),
        ("a.py", "f(a, *rest)", "f(a)", [("args|f|-*", "call")]),
        ("a.py", "def f(a): ...", "def f(a, b=None): ...", [("args|f|+kw:b", "definition")]),
        ("a.py", "if a:\n    return 1\nelse:\n    x()\n", "", [("replace|if|a|:|NEWLINE|INDENT|return|1|NEWLINE|DEDENT|else|:|NEWLINE|INDENT|x|(|)|NEWLINE|\x01", "")]),
        ("a.py", "if a(b[1:2]):\n    raise E(1)\n", "", [("guard|-a ( b [ 1 : 2 ] )", "")]),
        ("a.ts", "if (!x) { throw new E(1); }\n", "", [("guard|-! x", "")]),
        ("a.ts", "if (x) { y(); }\n", "", [("replace|if|(|x|)|{|y|(|)|NEWLINE|}|NEWLINE|\x01", "")]),
        ("a.ts", "const x: number = a();", "const x: string = b();", [("retype|number|string", "variable x"), ("rename|a|b", "call")]),
        ("a.ts", "import { a, b } from './m'", "import { a } from './m'", [("import|./m.b|", "b")]),
        ("a.ts", "const o = { a: 1, b: 'x' };", "const o = { a: 1 };", [("list|object|-b : <str>", "object")]),
        ("a.ts", "type T = 'a' | 'b' | 'c'", "type T = 'a' | 'c'", [("list|union|-'b'", "union")]),
        ("a.ts", "if (!x) return;\n", "", [("guard|-! x", "")]),
        ("a.ts", "const a = 'x';", 'const a = "x"', [("formatting", "")]),
    ],
)
def test_signatures(path, old, new, want):
    assert signatures(path, old, new) == want


def test_alignment_is_the_standard_matcher():
    rnd = random.Random(0)
    for _ in range(50):
        a, b = ([rnd.choice(["x", "y", "", " ", "z"]) for _ in range(rnd.randrange(12))] for _ in range(2))
        want = [tuple(op) for op in SequenceMatcher(lambda x: not x.strip(), a, b, autojunk=False).get_opcodes() if op[0] != "equal"]
        assert [tuple(op) for group in align.line_hunks(a, b) for op in group if op.tag != "equal"] == want
    assert align.map_line(["a", "b", "c"], ["x", "a", "b", "c"], 2) == 3 and align.map_line(["a"], ["b"], 1) is None


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 10)).map(lambda t: (t[0], t[0] + t[1])), max_size=20))
@settings(max_examples=60, deadline=None)
def test_joined_ranges_cover_the_same_points(ranges):
    got = joined_ranges(ranges)
    points = lambda rs: {2 * p + h for a, b in rs for p in range(a, b + 1) for h in ((0, 1) if p < b else (0,))}
    assert points(got) == points(ranges) and all(a[1] < b[0] for a, b in zip(got, got[1:]))


def test_text_helpers():
    assert lines_of("") == [] and lines_of("a\r\nb\n") == ["a", "b"] and lines_of("a\n\n") == ["a", ""] and lines_of("a") == ["a"]
    assert short_hash_of("api.py", 0, 2) == "2362274b0e98" and short_hash_of("a", 1, "xé") == "bfa2f3f7e985"
    assert similarity("abc", "abc") == 1 and similarity("a", "abcdefgh") == 0


def test_analyzers_hold_broken_texts():
    for path in ("a.py", "a.ts", "a.json", "a.tsx", "a.js"):
        lang = analyzer_for(path)
        for text in ("", "(", "def f(:\n  x", "'unclosed", "\"", "/* open", "`${", "{\"a\": ", "\x00", "é" * 10, "a\r\nb", "]]]", "if (", "import {", "class"):
            lang.analyze(text)
    assert analyzer_for("a.txt") is None and analyzer_for("x/package-lock.json") is None
    assert not analyzer_for("a.py").analyze("def f(:").parsed and not analyzer_for("a.ts").analyze("f((").parsed


def test_script_structure():
    text = "import React, { a as b, type C } from './m';\nimport * as ns from \"lib\";\nimport './side';\nexport const f = (x: number): string => {\n  return `a${x}`;\n};\nclass K extends B {\n  m(y?: T) { return /re/.test(y); }\n}\n"
    got = script.analyze(text)
    assert got.parsed
    assert [(x.module, x.name, x.alias) for i in got.imports for x in i.bindings] == [("./m", "default", "React"), ("./m", "a", "b"), ("./m", "C", "C"), ("lib", None, "ns"), ("./side", None, "./side")]
    assert [(s.kind, s.qualname) for s in got.statements if s.qualname] == [("def", "f"), ("class", "K"), ("def", "K.m")]
    assert {(n.text, n.target) for n in got.annotations} >= {("number", "param x"), ("string", "return of f"), ("T", "param y")}


def test_json_members():
    got = jsonlang.members('{"a": [{"id": 1}, {"id": 2}], "b": {"c": "x"}}')
    assert [(m.path, m.normal, m.value) for m in got] == [("a", "a", None), ("a[0]", "a[]", None), ("a[0].id", "a[].id", "1"), ("a[1]", "a[]", None), ("a[1].id", "a[].id", "2"), ("b", "b", None), ("b.c", "b.c", '"x"')]
    assert jsonlang.members("{") == []


def test_folds_and_issues():
    text = "import os\nimport re\n\n\ndef f(a, b):\n    c = 1\n    return re.sub(a, '', '')\n    d = 2\n\n\nclass K:\n    def m(self, x):\n        pass\n"
    assert inspect.find_folds("a.py", text) == [(5, 8), (11, 13), (12, 13)]
    assert {(i[1], i[2].split()[0]) for i in inspect.find_issues("a.py", text)} == {("unused-import", "os"), ("unused-parameter", "b"), ("unused-variable", "c"), ("unused-variable", "d"), ("unreachable", "code")}
    assert [i[1] for i in inspect.find_issues("a.py", "def f(:")] == ["syntax"]
    assert inspect.find_folds("a.txt", "a\n  b\n  c\nd") == [(1, 3)]
    assert inspect.occurrences("a.py", "x = y\ny.x", "x") == [(1, 0), (2, 2)]

"""JSON by an own scanner that keeps positions: tokens, and members with their key paths."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from .base import Analysis, Language, Pos, Token

#: A longer text is one token for each line.
LONGEST = 2 << 20
PIECE = re.compile(r"(?P<ws>\s+)|(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<number>-?\d[\d.eE+-]*)|(?P<name>[A-Za-z_]\w*)|(?P<op>[\s\S])")
#: Lock files aren't analysed.
LOCKS = ("package-lock.json", "npm-shrinkwrap.json", "composer.lock")


class Member(NamedTuple):
    path: str  # items[2].id
    normal: str  # items[].id
    parent: str
    start: Pos
    end: Pos
    value: str | None  # of a scalar


def scan(text: str) -> list[Token]:
    out, line, begin = [], 1, 0
    for m in PIECE.finditer(text):
        piece, at = m.group(), m.start()
        start = (line, at - begin)
        if piece.count("\n"):
            line += piece.count("\n")
            begin = at + piece.rindex("\n") + 1
        if m.lastgroup != "ws":
            out.append(Token(m.lastgroup, piece, piece, start, (line, m.end() - begin)))
    return out


def members(text: str) -> list[Member]:
    """All members and elements, depth first; none where the text doesn't parse."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return []
    tokens, out = scan(text), []

    def value(k: int, path: str, normal: str) -> int:
        """Reads the value at token k; the token after it."""
        head = tokens[k].value
        if head not in "{[":
            return k + 1
        k, n = k + 1, 0
        while tokens[k].value not in "}]":
            begin = tokens[k].start
            if head == "{":
                key = json.loads(tokens[k].value)
                own, norm, k = f"{path}.{key}" if path else key, f"{normal}.{key}" if normal else key, k + 2
            else:
                own, norm = f"{path}[{n}]", f"{normal}[]"
            scalar = tokens[k].value if tokens[k].value not in "{[" else None
            place = len(out)
            out.append(None)
            k = value(k, own, norm)
            out[place] = Member(own, norm, path, begin, tokens[k - 1].end, scalar)
            n += 1
            if tokens[k].value == ",":
                k += 1
        return k + 1

    if tokens:
        value(0, "", "")
    return out


def analyze(text: str) -> Analysis:
    """Commas between members are dropped, and each member ends with a structural token."""
    out = Analysis.of(text)
    if len(text.encode("utf-8", "replace")) > LONGEST:
        out.tokens = [Token("other", x, x, (i, 0), (i, len(x))) for i, x in enumerate(out.lines, 1) if x.strip()]
        return out
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        out.parsed = not text.strip()
    for t in scan(text):
        if t.value == ",":
            out.tokens.append(Token("structural", "NEWLINE", ",", t.start, t.end))
        else:
            value = repr(json.loads(t.value, strict=False)) if t.kind == "string" and _sound(t.value) else t.value
            out.tokens.append(t._replace(value=value))
    return out


def _sound(text: str) -> bool:
    try:
        json.loads(text, strict=False)
    except ValueError:
        return False
    return True


LANGUAGE = Language("json", lambda p: p.endswith(".json") and p.rsplit("/", 1)[-1] not in LOCKS, analyze, frozenset(("true", "false", "null")))

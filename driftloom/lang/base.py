"""What an analyzer yields. Positions are (line from 1, column from 0 in code points)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from ..functions.text import lines_of

Pos = tuple[int, int]


class Token(NamedTuple):
    kind: str  # name op string number comment structural other
    value: str  # as compared
    text: str  # as written
    start: Pos
    end: Pos


class Annotation(NamedTuple):
    start: Pos
    end: Pos
    text: str
    target: str


class Argument(NamedTuple):
    start: Pos
    end: Pos
    passed: str  # pos, *, ** or kw:name


class Site(NamedTuple):
    """A call, or a definition with its parameters."""

    name: str  # the last part of what is called
    start: Pos
    end: Pos
    open: Pos  # of the argument list, brackets included
    close: Pos
    args: list[Argument]
    is_def: bool


class Binding(NamedTuple):
    module: str
    name: str | None
    alias: str

    def dotted(self) -> str:
        return self.module if self.name is None else f"{self.module}.{self.name}" if self.module else self.name


class Import(NamedTuple):
    first: int
    last: int
    bindings: list[Binding]


class Statement(NamedTuple):
    first: int
    last: int
    kind: str  # def, class or stmt
    qualname: str
    parent: int  # place in the list, -1 at the top


@dataclass
class Analysis:
    lines: list[str]
    tokens: list[Token] = field(default_factory=list)
    annotations: list[Annotation] = field(default_factory=list)
    docstrings: list[tuple[Pos, Pos]] = field(default_factory=list)
    parsed: bool = True
    statements: list[Statement] = field(default_factory=list)
    sites: list[Site] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)

    _lines: tuple[list[int], list[int]] | None = None

    @classmethod
    def of(cls, text: str) -> Analysis:
        return cls(lines_of(text))

    def token_lines(self) -> tuple[list[int], list[int]]:
        """First and last line of each token."""
        if self._lines is None:
            self._lines = [t.start[0] for t in self.tokens], [t.end[0] for t in self.tokens]
        return self._lines


@dataclass
class Language:
    """The plug-in surface: another language is another instance."""

    name: str
    handles: Callable[[str], bool]
    analyze: Callable[[str], Analysis]
    keywords: frozenset[str] = frozenset()
    builtins: frozenset[str] = frozenset()
    import_words: tuple[str, ...] = ()
    definition_words: tuple[str, ...] = ()
    #: (text, lines first..last, renames, strip annotations) -> a normal form, or None without a verifier
    normal_form: Callable[..., str | None] | None = None
    #: lines, statements and `parsed` of an analysis alone, where that is cheaper
    structure: Callable[[str], Analysis] | None = None

"""Language analyzers: plain Python, one text in, one Analysis out. `analyzer_for` picks by path."""

from __future__ import annotations

from . import jsonlang, python, script
from .base import Analysis, Language

LANGUAGES: list[Language] = [python.LANGUAGE, *script.LANGUAGES, jsonlang.LANGUAGE]


def analyzer_for(path: str) -> Language | None:
    """The first language that handles the path; add to LANGUAGES to plug another in."""
    return next((x for x in LANGUAGES if x.handles(path)), None)


__all__ = ["LANGUAGES", "Analysis", "Language", "analyzer_for"]

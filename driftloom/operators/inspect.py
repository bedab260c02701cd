"""Folds, issues, JSON members and symbol occurrences as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..lang import jsonlang
from ..lang.inspect import find_folds, find_issues
from ..sources.scratch import spread


def _rows(texts: DataFrame, of, schema: str) -> DataFrame:
    """Rows of of(path, text) for each of texts (path, text); null texts are empty."""
    names = ["path", *(x.split()[0] for x in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *row) for p, t in zip(frame["path"], frame["text"], strict=True) for row in of(p or "", t or "")], columns=names)

    return spread(texts.select("path", "text")).mapInPandas(run, f"path string, {schema}")


def folds(texts: DataFrame) -> DataFrame:
    return _rows(texts, find_folds, "first int, last int")


def issues(texts: DataFrame) -> DataFrame:
    return _rows(texts, find_issues, "severity string, code string, message string, line int, col int, end_line int, end_col int")


def json_members(texts: DataFrame) -> DataFrame:
    return _rows(texts, lambda p, t: [(m.path, m.normal, m.parent, m.start[0], m.end[0], m.value) for m in jsonlang.members(t)], "key string, normal string, parent string, first int, last int, value string")

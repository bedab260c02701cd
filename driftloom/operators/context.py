"""Pieces of text that put a hunk before a reviewer: the numbered hunk, its function, references, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import innermost


def hunk_piece(hunk_lines: DataFrame) -> DataFrame:
    """change_set_id, hunk_id, text: each line with its sign and numbers."""
    number = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 5, " ")
    line = F.concat(F.col("type"), number("old_no"), number("new_no"), F.lit("  "), F.col("text"))
    got = hunk_lines.groupBy("change_set_id", "hunk_id").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("l")))).alias("x"))
    return got.select("change_set_id", "hunk_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("text"))


def unexplained(hunk_lines: DataFrame, units: DataFrame) -> DataFrame:
    """Changed lines whose unit isn't explained."""
    return hunk_lines.join(units.filter("NOT explained").select("change_set_id", F.col("unit_id").alias("unit")), ["change_set_id", "unit"], "left_semi")


def hunk_of(points: DataFrame, hunk_lines: DataFrame, point: str = "line") -> DataFrame:
    """The hunk that shows a comment's line: points have change_set_id, path, side ('old' or 'new') and line."""
    side = lambda s, c: hunk_lines.filter(F.col(c).isNotNull()).select("change_set_id", "path", F.lit(s).alias("side"), F.col(c).alias(point), "hunk_id")
    return points.join(side("old", "old_no").unionByName(side("new", "new_no")), ["change_set_id", "path", "side", point], "left")


def function_of(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """The innermost definition around a line. definitions: change_set_id, path, first, last."""
    return innermost(lines, definitions, ["change_set_id", "path"], "line", "first", "last", ["line"])


def patterns(groups: DataFrame, most: int = 20) -> DataFrame:
    """The largest mechanical groups of each change set as one text."""
    item = F.struct("place", F.format_string("%s (×%d)", "label", "count").alias("l"))
    got = groups.filter("mechanical").groupBy("change_set_id").agg(F.slice(F.array_sort(F.collect_list(item)), 1, most).alias("x"))
    return got.select("change_set_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("patterns"))

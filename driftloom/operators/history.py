"""File histories over captured logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import views


def trail(commits: DataFrame, by: list[str]) -> DataFrame:
    """commits: by, ord (newest first), name (null where a commit has no file row): the file's name at each commit is the
    next newer one's."""
    return views.filled(commits, by, ["ord"], "name")


def more_than(commits: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first `limit` commits of each history, and whether there are more."""
    w = Window.partitionBy(*by).orderBy("ord")
    return commits.withColumn("k", F.row_number().over(w)).withColumn("more", F.count(F.lit(1)).over(Window.partitionBy(*by)) > limit).filter(F.col("k") <= limit).drop("k")


def blame_index(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines with the number of their commit in order of first sight, from 0."""
    first = lines.groupBy(*by, "commit").agg(F.min("line").alias("first"))
    numbered = first.withColumn("commit_no", F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1).drop("first")
    return lines.join(numbered, [*by, "commit"])


def in_range(commits: DataFrame, chosen: DataFrame) -> DataFrame:
    return commits.join(chosen.select("sha").distinct(), "sha", "left_semi")

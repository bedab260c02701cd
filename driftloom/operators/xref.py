"""Cross-reference checks of a change against all files at head."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import categorize, identifier_words, language
from . import concepts
from .inspect import json_members
from .warnings import named

#: The most checks that are listed, lines that are too long to look at.
MOST, LONGEST = 200, 1000
CHECK = ["change_set_id", "code", "severity", "path", "line", "message"]


def deleted_names(unit_rows: DataFrame) -> DataFrame:
    """change_set_id, name: identifiers that changed lines lose more often than they gain."""
    ids = concepts.changed_lines(unit_rows).select("change_set_id", F.when(F.col("side") == "old", 1).otherwise(-1).alias("sign"), F.explode(concepts.names(F.col("text"))).alias("name"))
    return ids.groupBy("change_set_id", "name").agg(F.sum("sign").alias("net")).filter("net > 0").drop("net")


def dangling(unit_rows: DataFrame, head: DataFrame, stems: DataFrame) -> DataFrame:
    """Lines at head that still name what the change deleted, for names that hold a concept's stem."""
    gone = deleted_names(unit_rows).join(stems.select("change_set_id", "stem"), "change_set_id").filter(F.array_contains(identifier_words(F.col("name")), F.col("stem"))).select("change_set_id", "name").distinct()
    met = named(head, gone).filter(F.length("text") <= LONGEST)
    source = categorize(F.col("path"), language(F.col("path")).isNotNull())
    severity = F.when(source == "source", "error").when(source == "tests", "warning").otherwise("info")
    return met.select("change_set_id", F.lit("dangling").alias("code"), severity.alias("severity"), "path", "line", F.concat(F.lit("still names "), F.col("name")).alias("message")).distinct()


def orphan_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Translation keys that code at head uses and the locales lost, and keys that nothing uses any more.
    before and after: change_set_id, path, text."""
    is_locale = F.col("path").rlike(r"(^|/)(i18n|locales)/.*\.json$")

    def keys(texts: DataFrame) -> DataFrame:
        named = texts.filter(is_locale).select(F.concat_ws("\x1f", "change_set_id", "path").alias("path"), "text")
        return json_members(named).filter("value IS NOT NULL").select(F.split("path", "\x1f")[0].alias("change_set_id"), F.split("path", "\x1f")[1].alias("file"), "key", F.col("first").alias("line"))

    def uses(texts: DataFrame) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit(r"(?:\bt|i18nKey)\s*[(=]\s*[\"'`]([\w.:-]+)[\"'`]"), F.lit(1))
        return texts.filter(~is_locale).select("change_set_id", "path", F.explode(F.array_distinct(found)).alias("k")).select("change_set_id", "path", F.regexp_replace("k", "^[^:]*:", "").alias("key"))

    old, new, now, then = keys(before), keys(after), uses(after), uses(before)
    lost = now.join(old.select("change_set_id", "key").distinct(), ["change_set_id", "key"], "left_semi").join(new, ["change_set_id", "key"], "left_anti")
    missing = lost.select("change_set_id", F.lit("missing-key").alias("code"), F.lit("error").alias("severity"), "path", F.lit(1).alias("line"), F.concat(F.lit("uses the deleted key "), F.col("key")).alias("message"))
    idle = new.join(then, ["change_set_id", "key"], "left_semi").join(now, ["change_set_id", "key"], "left_anti")
    unused = idle.select("change_set_id", F.lit("unused-key").alias("code"), F.lit("warning").alias("severity"), F.col("file").alias("path"), "line", F.concat(F.lit("nothing uses the key "), F.col("key")).alias("message"))
    return missing.unionByName(unused)


#: The order of checks of one severity.
CODES = ["dangling", "missing-key", "unused-key", "lost-key"]


def listed(checks: DataFrame, codes: list[str] = CODES) -> DataFrame:
    """The first checks of each change set by severity, code (in the order of codes), path and line, with their place and the
    total: a report's first page. Ranks are cut off in the tasks before the shuffle."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, codes)), F.col("code")), F.lit(0)), F.lit(len(codes) + 1))
    total = checks.groupBy("change_set_id").agg(F.count(F.lit(1)).alias("total"))
    top = checks.withColumn("place", F.row_number().over(Window.partitionBy("change_set_id").orderBy(rank, order, "code", "path", "line"))).filter(F.col("place") <= MOST)
    return top.join(total, "change_set_id")


def counts_by_code(checks: DataFrame) -> DataFrame:
    """change_set_id, code, n: before the list is cut."""
    return checks.groupBy("change_set_id", "code").agg(F.count(F.lit(1)).alias("n"))

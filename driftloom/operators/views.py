"""Window, ranking, filter and set operators behind the review views, on column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def top_by(rows: DataFrame, key: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key with their rank. Spark filters ranks before the shuffle (a group limit), so a hot
    key sends n rows a task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def filled(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def islands(rows: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of equal flags: by, island, flag, rows, start and end (of the first order column)."""
    w = Window.partitionBy(*by).orderBy(*order)
    turn = rows.withColumn("_t", F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1))
    out = turn.withColumn("island", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*by, "island").agg(F.first(flag).alias(flag), F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))


def merged_ranges(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Ranges that touch or overlap, joined. Ranges without an end come last of those with their start and are joined with them; ranges without a start are each one."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_n", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def running_depth(rows: DataFrame, by: list[str], order: list[str], delta: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("depth", F.sum(delta).over(w))


def without_repeats(rows: DataFrame, by: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Rows whose value is that of the row before them are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_s", F.struct(*value).eqNullSafe(F.lag(F.struct(*value)).over(w)) & (F.row_number().over(w) > 1)).filter("NOT _s").drop("_s")


def samples(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first, middle and last row of each key."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return out.filter((F.col("_i") == 0) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def side_by_side(lines: DataFrame, by: list[str], no: str, kind: str, text: str) -> DataFrame:
    """Removed and added lines of each run of changes, the k-th beside the k-th."""
    w = Window.partitionBy(*by).orderBy(no)
    change = lines.withColumn("_c", F.col(kind) != " ")
    run = change.withColumn("run", F.sum(F.when(F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False)), 1).otherwise(0)).over(w)).filter("_c")
    nth = run.withColumn("k", F.row_number().over(Window.partitionBy(*by, "run", kind).orderBy(no)))
    side = lambda s, n: nth.filter(F.col(kind) == s).select(*by, "run", "k", F.col(text).alias(n))
    return side("-", "old").join(side("+", "new"), [*by, "run", "k"], "full_outer")


def delta(seen: DataFrame, now: DataFrame, marked: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, key, what: 'new' for keys of now that weren't seen, 'changed' for marked keys that are gone."""
    fresh = now.join(seen, [*by, key], "left_anti").select(*by, key, F.lit("new").alias("what"))
    lost = marked.join(now, [*by, key], "left_anti").select(*by, key, F.lit("changed").alias("what"))
    return fresh.unionByName(lost)


def marks_after(marks: Column, remove: Column, add: Column) -> Column:
    """An ordered set without `remove` and then with `add`."""
    return F.array_union(F.array_except(marks, remove), add)


def is_sub_multiset(a: Column, b: Column) -> Column:
    return F.forall(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) <= F.size(F.filter(b, lambda y: y == x)))


def changed_lines(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """by, lines (sorted set of line numbers): which lines of each file a change touches."""
    return lines.groupBy(*by).agg(F.array_sort(F.collect_set(line)).alias("lines"))


def explorer(units: DataFrame, path: str, hunk: str, explained: str = "explained") -> DataFrame:
    """path, hunks, open_hunks: how many hunks a file has, and how many of them have an unexplained unit."""
    each = units.groupBy(path, hunk).agg(F.bool_or(~F.col(explained)).alias("open"))
    return each.groupBy(path).agg(F.count(F.lit(1)).alias("hunks"), F.count_if("open").alias("open_hunks"))


def risk_order(hunks: DataFrame, path: str, risk: str, place: str) -> DataFrame:
    """Hunks with their file's highest risk, files and hunks by falling risk; what isn't scored comes last."""
    out = hunks.withColumn("file_risk", F.max(risk).over(Window.partitionBy(path)))
    return out.orderBy(F.desc_nulls_last("file_risk"), path, F.desc_nulls_last(risk), place)


def timeline(parts: dict[str, DataFrame], at: str) -> DataFrame:
    """Rows of several kinds (comments, reviews) by time, each with its kind as `what`."""
    every = [df.withColumn("what", F.lit(kind)) for kind, df in parts.items()]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.orderBy(at, "what")


def by_layer(files: DataFrame, layer_of: Column, share: Column, lines: Column) -> DataFrame:
    """Files in the order to read them: layer, then falling share of what is left, falling lines, path."""
    return files.withColumn("layer", layer_of).orderBy("layer", share.desc(), lines.desc(), "path")


def visible_groups(signatures: DataFrame, units: DataFrame, by: list[str], unit: list[str], place: str) -> DataFrame:
    """Groups by how many visible units they have (`visible`), most first; equal ones stay in the order of place."""
    seen = signatures.join(units.select(*unit).distinct(), unit, "left_semi").select(*by, *unit, place).distinct()
    return seen.groupBy(*by).agg(F.count_distinct(*unit).alias("visible"), F.min(place).alias(place)).orderBy(F.desc("visible"), place)


def chosen_hunks(hunks: DataFrame, explained: str, place: str, cap: int = 300) -> DataFrame:
    """At most `cap` hunks to score: those that no concept explains first, in order."""
    return hunks.orderBy(explained, place).limit(cap)


def newest(rows: DataFrame, by: list[str], at: str, key: str, cap: int = 5000) -> DataFrame:
    """Each store's newest rows, at most `cap`: what pruning leaves."""
    return top_by(rows, by, [F.desc(at), key], cap).drop("rank")


def collateral_first(hunks: DataFrame, rank: str, path: str, place: str) -> DataFrame:
    """Files by their best rank (0 collateral, 1 mixed, 2 concept), then hunks by theirs."""
    return hunks.withColumn("file_rank", F.min(rank).over(Window.partitionBy(path))).orderBy("file_rank", path, rank, place)


def flagged_first(hunks: DataFrame, flag: str, risk: str, place: str) -> DataFrame:
    """Flagged hunks by falling risk."""
    return hunks.filter(F.col(flag)).orderBy(F.desc_nulls_last(risk), place)


def threads_by_line(threads: DataFrame, at: str) -> DataFrame:
    """path, side, line, threads: what stands beside each line, in order."""
    return threads.groupBy("path", "side", "line").agg(F.array_sort(F.collect_list(F.struct(at, "id"))).alias("t")).select("path", "side", "line", F.col("t.id").alias("threads"))


def glob_regex(pattern: str) -> str:
    """A review's exclude pattern as a regular expression: without a slash it is matched with any segment of a path, with one
    with the whole path, where ** goes over slashes."""
    body, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        body += ".*" if two == "**" else "[^/]*" if pattern[i] == "*" else "[^/]" if pattern[i] == "?" else re.escape(pattern[i])
        i += 2 if two == "**" else 1
    return f"^{body}$" if "/" in pattern else f"(^|/){body}(/|$)"


def review_filter(units: DataFrame, hide_docs: bool = False, hide_renames: bool = False, near_only: bool = False, new_only: DataFrame | None = None, explained_by: DataFrame | None = None, globs: list[str] = (), search: str | None = None, regex: bool = False) -> DataFrame:
    """Units (with kinds, explained, near, pure_rename, fingerprint, unit_id, path, text, labels) that a review's filters leave.

    hide_docs: units whose every signature is docs. hide_renames: files that are only renamed. near_only: of unexplained
    units those that look like a group. new_only: fingerprints that are new; explained_by: unit ids that a concept explains.
    globs: patterns of paths that go. search: in path, text or labels, without regard to case; a pattern that isn't valid
    filters nothing."""
    out = units
    if hide_docs:
        out = out.filter(~((F.size("kinds") > 0) & F.forall("kinds", lambda k: k == "docs")))
    if hide_renames:
        out = out.filter(~F.col("pure_rename"))
    if near_only:
        out = out.filter(F.col("explained") | F.col("near"))
    for pattern in globs:
        out = out.filter(~F.col("path").rlike(glob_regex(pattern)))
    if new_only is not None:
        out = out.join(new_only.select("fingerprint").distinct(), "fingerprint", "left_semi")
    if explained_by is not None:
        out = out.join(explained_by.select("unit_id").distinct(), "unit_id", "left_anti")
    if search:
        try:
            re.compile(search)
        except re.error:
            return out if regex else _found(out, re.escape(search))
        out = _found(out, search if regex else re.escape(search))
    return out


def _found(units: DataFrame, pattern: str) -> DataFrame:
    hit = lambda c: c.rlike(f"(?i){pattern}")
    return units.filter(hit(F.col("path")) | hit(F.col("text")) | F.exists("labels", hit))


def shown_warnings(warnings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Warnings without locations, or with one in a file that isn't hidden."""
    at = warnings.select("id", F.explode("locations").alias("l")).select("id", F.col("l.path").alias("path"))
    seen = at.join(hidden.select("path"), "path", "left_anti").select("id").distinct()
    return warnings.filter(F.size("locations") == 0).unionByName(warnings.filter(F.size("locations") > 0).join(seen, "id", "left_semi"))


def unreviewed_files(hunks: DataFrame) -> DataFrame:
    """path of the files with a residual hunk that isn't marked."""
    return hunks.filter("residual AND NOT marked").select("path").distinct()


def dropped(old: Column, new: Column) -> Column:
    """What an object's keys, or a file's imported names, lose."""
    return F.array_except(old, new)


def visible(units: DataFrame, hide_categories: list[str] = (), exclude: str | None = None, hide_tags: list[str] = (), search: str | None = None, text: str = "text", path: str = "path", category: str = "category", tags: str = "tags") -> DataFrame:
    """Units that pass the review filters: category, path pattern (a regular expression), tags, and a case-insensitive search."""
    out = units
    if hide_categories:
        out = out.filter(~F.col(category).isin(*hide_categories))
    if exclude:
        out = out.filter(~F.col(path).rlike(exclude))
    if hide_tags:
        out = out.filter(~F.arrays_overlap(F.col(tags), F.array(*map(F.lit, hide_tags))))
    if search:
        low = search.lower()
        out = out.filter(F.lower(F.col(text)).contains(low) | F.lower(F.col(path)).contains(low))
    return out


def layer(category: Column, residual: Column, pure_rename: Column, status: Column) -> Column:
    """The story layer of a file, from 1: what to read first."""
    return (
        F.when((category == "source") & (residual > 0) & (status == "A"), 1)
        .when((category == "source") & (residual > 0), 2)
        .when((category == "config") & (residual > 0), 3)
        .when((category == "tests") & (residual > 0), 4)
        .when((category == "docs") & (residual > 0), 5)
        .when(residual > 0, 6)
        .when(pure_rename, 8)
        .otherwise(7)
    )


def fuzzy_score(query: str, text: str) -> float | None:
    """Score of a subsequence match: 1 a letter, 2 more if adjacent, 3 more at a word's start; longer texts a little less."""
    at, score, q, low = -1, 0.0, query.lower(), text.lower()
    for c in q:
        k = low.find(c, at + 1)
        if k < 0:
            return None
        score += 1 + (2 if k == at + 1 and at >= 0 else 0) + (3 if k == 0 or not text[k - 1].isalnum() else 0)
        at = k
    return score - len(text) / 100


def page(rows: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """A page of a history: limit between 1 and 1000."""
    return rows.orderBy(*order).offset(offset).limit(min(1000, max(1, limit)))

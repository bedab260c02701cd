"""Captured output of version-control tools -> rows. Pure parsers for one captured blob, and DataFrame forms of them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"
NO_NUL = "position(unhex('00'), content) = 0"


def lossy_text(content: Column) -> Column:
    """Bytes as UTF-8 text, with replacement characters where they aren't."""
    return F.make_valid_utf8(content.cast("string"))


def name_status(raw: bytes) -> list[tuple[str, str | None, str]]:
    """(status, old path of a rename, path) of NUL-separated records: copies count as added, what is unknown as modified."""
    parts = [p.decode("utf-8", "replace") for p in raw.split(b"\0")]
    out, k = [], 0
    while k + 1 < len(parts) and parts[k]:
        code = parts[k][0]
        if code in "RC" and k + 2 < len(parts):
            out.append(("R", parts[k + 1], parts[k + 2]) if code == "R" else ("A", None, parts[k + 2]))
            k += 3
        else:
            out.append((code if code in "AMD" else "M", None, parts[k + 1]))
            k += 2
    return out


def cat_file_batch(raw: bytes, names: list[str]) -> dict[str, bytes]:
    """Contents by requested name, in the order of the requests; missing ones are left out."""
    out, at = {}, 0
    for name in names:
        end = raw.find(b"\n", at)
        if end < 0:
            break
        head = raw[at:end].split(b" ")
        at = end + 1
        if head[-1] == b"missing":
            continue
        size = int(head[-1])
        out[name] = raw[at : at + size]
        at += size + 1
    return out


def numstat(raw: bytes) -> list[tuple[int, int, str | None, str]]:
    """(added, deleted, old path of a rename, path); binary files have 0 and 0."""
    out, parts, k = [], raw.split(b"\0"), 0
    while k < len(parts) and parts[k].strip():
        added, deleted, path = parts[k].lstrip(b"\n").decode("utf-8", "replace").split("\t", 2)
        number = lambda x: 0 if x == "-" else int(x)
        if path:
            out.append((number(added), number(deleted), None, path))
            k += 1
        else:
            out.append((number(added), number(deleted), parts[k + 1].decode("utf-8", "replace"), parts[k + 2].decode("utf-8", "replace")))
            k += 3
    return out


def blame_porcelain(raw: bytes) -> list[tuple[str, int, int, str]]:
    """(commit, line there, line here, file name there) for each line."""
    out, names, head = [], {}, None
    for line in raw.decode("utf-8", "replace").split("\n"):
        if line.startswith("\t"):
            if head:
                out.append((*head, names.get(head[0], "")))
        elif m := re.match(r"([0-9a-f]{40}) (\d+) (\d+)", line):
            head = m[1], int(m[2]), int(m[3])
        elif line.startswith("filename ") and head:
            names[head[0]] = line[9:]
    return out


def shortstat(text: Column) -> Column:
    """(files, insertions, deletions) of a summary line; 0 where a part is missing."""
    n = lambda word: F.coalesce(F.regexp_extract(text, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))
    return F.struct(n("file").alias("files"), n("insertion").alias("insertions"), n("deletion").alias("deletions"))


def log_records(captured: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """A row for each log record, with its fields; ord from 0."""
    rows = captured.select(*[c for c in captured.columns if c != column], F.posexplode(F.filter(F.split(column, RECORD), lambda x: F.trim(x) != "")).alias("ord", "_r"))
    parts = F.split(F.regexp_replace("_r", "^\n+", ""), FIELD)
    return rows.select(*[c for c in rows.columns if c != "_r"], *[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f) for k, f in enumerate(fields)])


def parsed(captured: DataFrame, column: str, parser, schema: str) -> DataFrame:
    """Rows that a parser yields for each captured blob, beside the blob's other columns."""
    rest = [c for c in captured.columns if c != column]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captured.schema if f.name != column)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = [{c: getattr(r, c) for c in rest} | dict(zip(names, got, strict=True)) for r in frame.itertuples() for got in parser(getattr(r, column))]
            yield pd.DataFrame(rows, columns=rest + names)

    return captured.mapInPandas(run, f"{kinds}, {schema}" if kinds else schema)


def resolve(base: Column, head: Column, number: Column) -> Column:
    """Identity of a comparison: a pull request before refs before the working tree."""
    return F.when(number.isNotNull(), F.concat(F.lit("pr:"), number.cast("string"))).when(head.isNull(), F.concat(F.lit("worktree:"), base)).otherwise(F.concat(F.lit("refs:"), base, F.lit(":"), head))


def default_base(branches: DataFrame, by: list[str]) -> DataFrame:
    """The first of main, master and their remote forms that there is, else the most recent branch. branches: by, name, date."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("main", "master", "origin/main", "origin/master"))), F.col("name")), F.lit(0))
    named = branches.filter(~F.col("name").endswith("/HEAD"))
    return named.groupBy(*by).agg(F.min_by("name", F.struct(F.when(rank == 0, 99).otherwise(rank).alias("r"), F.negative(F.unix_timestamp(F.col("date"))).alias("d"), "name")).alias("base"))


def blobs_of(tree: DataFrame, blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted (sha, path); missing and binary ones are left out."""
    met = wanted.select("sha", "path").distinct().join(tree.select("sha", "path", "oid"), ["sha", "path"]).join(blobs.select("oid", "content"), "oid")
    return met.filter(NO_NUL).select("sha", "path", lossy_text(F.col("content")).alias("text"))


def grep_lines(texts: DataFrame, word: str, path_globs: list[str] | None = None, regex: bool = False) -> DataFrame:
    """path, line, text of the lines that hold a whole word, or match a pattern."""
    from ..functions.text import any_glob

    pattern = word if regex else rf"(?<!\w)\Q{word}\E(?!\w)"
    rows = texts.filter(any_glob(F.col("path"), path_globs)) if path_globs else texts
    lines = rows.filter(F.col("text").rlike(pattern)).select("path", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.filter(F.col("text").rlike(pattern)).select("path", (F.col("k") + 1).alias("line"), "text")


def safe_path(path: Column) -> Column:
    """A relative path that stays below its root."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike(r"^[A-Za-z]:")


def conversation(page: str) -> dict:
    """Comments and threads of one captured page of a pull request's conversation; drafts of one's own review apart."""
    data = json.loads(page)
    pull = data.get("data", {}).get("repository", {}).get("pullRequest", {}) or {}
    nodes = lambda x: [n for n in (x or {}).get("nodes", []) if n]
    comments = [{"id": c.get("id"), "author": (c.get("author") or {}).get("login"), "body": c.get("body", ""), "at": c.get("createdAt")} for c in nodes(pull.get("comments"))]
    threads = [{"id": t.get("id"), "path": t.get("path"), "line": t.get("line"), "resolved": bool(t.get("isResolved")), "comments": [{"id": c.get("id"), "body": c.get("body", ""), "at": c.get("createdAt")} for c in nodes(t.get("comments"))]} for t in nodes(pull.get("reviewThreads"))]
    return {"comments": comments, "threads": threads, "next": ((pull.get("comments") or {}).get("pageInfo") or {}).get("endCursor")}


def load_changes(name_status_rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Change sets from captured name-status rows (change_set_id, base, head, status, old_path, path) and blobs (sha, path,
    content): two left joins on revision and path. Files with a NUL on either side are left out; a missing side is empty, and
    old_path stays with renames alone."""
    side = lambda name: blobs.select(F.col("sha").alias(name), F.col("path").alias(f"{name}_path"), F.col("content").alias(f"{name}_content"))
    rows = name_status_rows.withColumn("base_path", F.coalesce("old_path", "path")).withColumn("head_path", F.col("path"))
    met = rows.join(side("base"), ["base", "base_path"], "left").join(side("head"), ["head", "head_path"], "left")
    text = lambda name, absent: F.when(F.col("status") == absent, F.lit("")).otherwise(F.coalesce(lossy_text(F.col(f"{name}_content")), F.lit("")))
    clean = lambda name: F.coalesce(F.expr(f"position(unhex('00'), {name}_content) = 0"), F.lit(True))
    return met.filter(clean("base") & clean("head")).select("change_set_id", "path", F.when(F.col("status") == "R", F.col("old_path")).alias("old_path"), "status", text("base", "A").alias("old_text"), text("head", "D").alias("new_text"))


def paths_at(tree: DataFrame, sha: str) -> DataFrame:
    """All paths of one revision."""
    return tree.filter(F.col("sha") == sha).select("path")


def grep_files(texts: DataFrame, word: str, path_globs: list[str] | None = None) -> DataFrame:
    """path of the files that hold a whole word."""
    from ..functions.text import any_glob

    rows = texts.filter(any_glob(F.col("path"), path_globs)) if path_globs else texts
    return rows.filter(F.col("text").rlike(rf"(?<!\w)\Q{word}\E(?!\w)")).select("path")


def branch_list(branches: DataFrame, by: list[str]) -> DataFrame:
    """Branches by falling date, without the pointers to a default one."""
    return branches.filter(~F.col("name").endswith("/HEAD")).orderBy(*by, F.desc("date"), "name")


def resolved_ref(wanted: DataFrame, refs: DataFrame, remotes: list[str]) -> DataFrame:
    """wanted (ref) with its sha: a local branch before those of the remotes, in their order; null where there is none."""
    rank = F.coalesce(F.array_position(F.array(F.lit(""), *map(F.lit, remotes)), F.col("remote")), F.lit(0))
    first = refs.withColumn("rank", rank).filter("rank > 0").groupBy(F.col("name").alias("ref")).agg(F.min_by("sha", "rank").alias("sha"))
    return wanted.join(first, "ref", "left")


def commit_rows(captured: DataFrame, column: str) -> DataFrame:
    """Commits of a captured log whose records are sha, author, date, subject and the summary line: with their numbers."""
    rows = log_records(captured, column, ["sha", "author", "date", "subject", "summary"])
    return rows.withColumn("stat", shortstat(F.col("summary"))).select(*[c for c in rows.columns if c != "summary"], "stat.*")

"""Lines and names carried through a chain of commits by composition instead of commit by commit.

A commit's edits of a file are a piecewise map: lines lo..hi of version n were lines lo+shift..hi+shift of version n-1; lines in no piece are new
in n. Maps over 2^k commits are composed of two over 2^(k-1), at multiples of 2^k alone, so all levels together hold as
many pieces as commits times their logarithm. A line then climbs over ever larger stretches that keep it, and comes down where one doesn't: twice log n joins.
Lines of a file's first SPAN * ROUNDS versions need no composed maps: they walk through SPAN versions at a time, beside these versions' maps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from . import graph, sweeps

#: Stands for the end of a file, of any length.
END = 1 << 40
#: Versions that a line walks through in a round, rounds of walks, about how many rows walk in one task at once.
SPAN, ROUNDS, PACK = 256, 8, 200_000


def pieces(hunks: DataFrame, by: list[str]) -> DataFrame:
    """by, n, lo, hi, shift from hunks (by, n, old_start, old_count, new_start, new_count; a version's hunks don't overlap; a count of 0 stands before its
    start). Versions without hunks have no row here: give one with both counts 0."""
    w = [*by, "n"]
    at = hunks.select(*w, F.col("new_start").cast("long").alias("new_start"), "new_count", (F.col("old_start").cast("long") + F.col("old_count") - F.col("new_start") - F.col("new_count")).alias("shift"))
    place = at.groupBy(*w, "new_start").agg(F.max_by("new_count", "new_count").alias("new_count"), F.max_by("shift", "new_count").alias("shift"))
    nexts = sweeps.last_before(place, w, "new_start", F.col("new_start"), "next", backwards=True)
    after = nexts.select(*w, (F.col("new_start") + F.col("new_count")).alias("lo"), (F.coalesce("next", F.lit(END)) - 1).alias("hi"), "shift")
    first = place.groupBy(*w).agg(F.min("new_start").alias("to")).select(*w, F.lit(1).cast("long").alias("lo"), (F.col("to") - 1).alias("hi"), F.lit(0).cast("long").alias("shift"))
    return after.unionByName(first).filter("lo <= hi")


def composed(newer: DataFrame, older: DataFrame, key: list[str]) -> DataFrame:
    """key, lo, hi, shift: first the newer map, then the older one; both have key and map lines upwards in order. A sweep over both maps'
    ends, so a key's pieces are as many as both have together."""
    ends = lambda df, s, side: df.select(*key, F.explode(F.array(F.struct((F.col("lo") + s).alias("p"), F.struct(F.lit(True).alias("on"), F.col("shift").alias("shift")).alias("v")), F.struct((F.col("hi") + s + 1).alias("p"), F.struct(F.lit(False).alias("on"), F.lit(0).cast("long").alias("shift")).alias("v")))).alias("e")).select(*key, F.col("e.p").alias("p"), F.col("e.v").alias(side))
    both = ends(newer, F.col("shift"), "x").unionByName(ends(older, F.lit(0), "y"), allowMissingColumns=True)
    # where one piece ends and the next begins at once the beginning counts
    start = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(f"{c}.on").cast("int")))
    at = both.groupBy(*key, "p").agg(start("x").alias("x"), start("y").alias("y"))
    for side in ("x", "y"):
        at = sweeps.last_before(at, key, "p", F.col(side), f"_{side}").withColumn(side, F.coalesce(side, f"_{side}")).drop(f"_{side}")
    at = sweeps.last_before(at, key, "p", F.col("p"), "next", backwards=True).filter("x.on AND y.on AND next IS NOT NULL")
    return at.select(*key, (F.col("p") - F.col("x.shift")).alias("lo"), (F.col("next") - 1 - F.col("x.shift")).alias("hi"), (F.col("x.shift") + F.col("y.shift")).alias("shift"))


def levels(steps: DataFrame, by: list[str], last: int) -> DataFrame:
    """by, k, n, lo, hi, shift: the maps from version n over 2^k commits, for n that 2^k divides."""
    level = materialise(steps.select(*by, "n", "lo", "hi", "shift"), "maps")
    out, k = level.withColumn("k", F.lit(0)), 0
    while 2 << k <= last:
        size = 1 << k
        newer = level.filter(F.col("n") % (2 * size) == 0)
        older = level.filter(F.col("n") % (2 * size) == size).withColumn("n", F.col("n") + size)
        level = materialise(composed(newer, older, [*by, "n"]).select(*by, "n", "lo", "hi", "shift"), "maps")
        k += 1
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    return out


def walk(rows: pa.Table, by: list[str], span: int) -> pa.Table:
    """Lines (rows with at) carried through their block's maps (the other rows), to the version that brought them in (done) or to the end of the version below the block."""
    code = np.zeros(rows.num_rows, np.int64)
    for c in (*by, "_b"):
        own = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        code = np.unique(np.stack([code, own], 1), axis=0, return_inverse=True)[1].ravel()
    line = ~rows.column("at").is_null().to_numpy()
    column = lambda t, c: t.column(c).to_numpy()
    maps, asks = rows.filter(pa.array(~line)), rows.filter(pa.array(line))
    n, at, bottom = column(asks, "n").copy(), column(asks, "at").copy(), column(asks, "_b") * span
    # a version's pieces are a run of one sorted array
    version = lambda code, n: code * span + (n - 1) % span
    lo, key = column(maps, "lo"), version(code[~line], column(maps, "n"))
    order = np.lexsort((lo, key))
    lo, key, hi, shift = lo[order], key[order], column(maps, "hi")[order], column(maps, "shift")[order]
    runs, run = np.unique(key, return_inverse=True)
    place = lambda run, at: (run << 42) + np.clip(at + END, 0, (1 << 42) - 1)
    places, own, live = place(run, lo), code[line], np.flatnonzero(n > bottom)
    while len(live) and len(runs):
        want = version(own[live], n[live])
        r = np.minimum(np.searchsorted(runs, want), len(runs) - 1)
        k = np.maximum(np.searchsorted(places, place(r, at[live]), "right") - 1, 0)
        ok = (runs[r] == want) & (run[k] == r) & (lo[k] <= at[live]) & (at[live] <= hi[k])
        live, k = live[ok], k[ok]
        at[live] += shift[k]
        n[live] -= 1
        live = live[n[live] > bottom[live]]
    done = (n > bottom) | (n == 0)
    return asks.select([*by, "_version", "_line"]).append_column("n", pa.array(n)).append_column("at", pa.array(at)).append_column("done", pa.array(done))


def walked(lines: DataFrame, steps: DataFrame, by: list[str], span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """by, _version, _line, n, at: lines (by, _version, _line) carried to the version that brought them in, a block of versions a round. A file's lines, if there
    are very many, are dealt out over parts, each of which has the file's maps. Blocks share tasks by their hash."""
    block = F.floor((F.col("n") - 1) / span)
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    maps = materialise(steps.filter(known & (F.col("n") > 0) & (F.col("n") <= span * rounds)).select(*by, *[F.col(c).cast("long").alias(c) for c in ("n", "lo", "hi", "shift")]), "maps")
    now = lines.filter(known).select("*", F.col("_version").alias("n"), F.col("_line").alias("at"), (F.col("_version") == 0).alias("done"))
    now = materialise(now, "walk")
    crowds = now.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PACK).select(*by, F.ceil(F.col("_n") / PACK).cast("int").alias("_parts"))
    crowds = F.broadcast(materialise(crowds, "crowds"))
    parts, n_maps, out = F.coalesce("_parts", F.lit(1)), maps.count(), []
    fields = [*by, "_version", "_line", "n", "at", "done"]
    kinds = {f.name: f.dataType.simpleString() for f in now.schema}
    while True:
        out.append(now.filter("done").select(*by, "_version", "_line", "n", "at"))
        live = now.filter("NOT done")
        left = live.count()
        if not left:
            break
        packs = -(-(n_maps + left) // PACK)
        asked = live.drop("done").withColumn("_b", block).join(crowds, by, "left").withColumn("_s", F.pmod(F.xxhash64("_line"), parts).cast("int")).drop("_parts")
        given = maps.withColumn("_b", block).join(crowds, by, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        both = asked.unionByName(given, allowMissingColumns=True).withColumn("_pack", F.pmod(F.xxhash64(*by, "_b", "_s"), F.lit(packs)))
        now = materialise(both.groupBy("_pack").applyInArrow(lambda t: walk(t, by, span), ", ".join(f"`{c}` {kinds[c]}" for c in fields)), "walk")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def origins(lines: DataFrame, steps: DataFrame, by: list[str], version: str, line: str, span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """lines with born and born_line: the version that brought the line in, and its number there; version 0 for what was there from the
    start. steps: by, n (from 1), lo, hi, shift. Lines of null or negative versions, or null numbers, get null."""
    every = materialise(lines.select(*by, version, line).distinct().filter(f"{version} >= 0 AND {line} IS NOT NULL"), "lines")
    near = every.filter(F.col(version) <= span * rounds).select(*by, F.col(version).cast("long").alias("_version"), F.col(line).cast("long").alias("_line"))
    found = walked(near, steps, by, span, rounds).select(*by, F.col("_version").alias(version), F.col("_line").alias(line), F.col("n").alias("born"), F.col("at").alias("born_line"))
    far = every.filter(F.col(version) > span * rounds)
    if far.head(1):
        found = found.unionByName(climbed(far, steps, by, version, line))
    return lines.join(found, [*by, version, line], "left")


def climbed(keyed: DataFrame, steps: DataFrame, by: list[str], version: str, line: str) -> DataFrame:
    """by, version, line, born, born_line of distinct lines (by, version, line), over composed maps."""
    last = max(steps.agg(F.max("n")).first()[0] or 0, keyed.agg(F.max(version)).first()[0] or 0)
    maps = levels(steps, by, last)
    zeros = lambda n: F.length(F.regexp_extract(F.bin(n), "0*$", 0))
    now = keyed.select("*", F.col(version).cast("long").alias("n"), F.col(line).cast("long").alias("at"), F.lit(False).alias("down"))
    now = materialise(now.withColumn("k", F.when(F.col("n") == 0, -1).otherwise(zeros(F.col("n")))), "climb")
    done = []
    while True:
        done.append(now.filter("k < 0"))
        live = now.filter("k >= 0")
        if not live.head(1):
            break
        held = sweeps.owners(live, maps.withColumn("ok", F.lit(True)), [*by, "k", "n"], "at", "lo", "hi", ["shift", "ok"])
        kept = F.coalesce("ok", F.lit(False))
        n = F.when(kept, F.col("n") - F.pow(F.lit(2.0), F.col("k")).cast("long")).otherwise(F.col("n"))
        moved = held.withColumns({"at": F.when(kept, F.col("at") + F.col("shift")).otherwise(F.col("at")), "n": n, "down": F.col("down") | ~kept})
        now = materialise(moved.withColumn("k", F.when(F.col("n") == 0, -1).when(F.col("down"), F.col("k") - 1).otherwise(zeros(F.col("n")))).select(*now.columns), "climb")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(*by, version, line, F.col("n").alias("born"), F.col("at").alias("born_line"))


def followed(paths: DataFrame, renames: DataFrame, by: list[str]) -> DataFrame:
    """paths (by, path, n) with every name the file had: by, path, n, step, name, since: step 0 is the path itself, each further one the name before a
    rename; since is the commit that gave the name (null: as far back as the renames go). renames: by, n, old, new (a commit renames to a
    name once). A rename points at the rename that gave its old name, and pointers are doubled."""
    give = renames.select(*by, F.col("new").alias("name"), (2 * F.col("n").cast("long") + 1).alias("_at"), F.struct("n", "new").alias("_r"))
    key = lambda r: F.sha2(F.concat_ws("\0", *by, r["n"].cast("string"), r["new"]), 256)
    asks = renames.select(*by, F.col("old").alias("name"), (2 * F.col("n").cast("long")).alias("_at"), F.struct("n", "new").alias("_ask"))
    met = sweeps.last_before(give.unionByName(asks, allowMissingColumns=True), [*by, "name"], "_at", F.col("_r"), "_prev").filter("_ask IS NOT NULL")
    events = materialise(met.select(key(F.col("_ask")).alias("commit"), F.when(F.col("_prev").isNotNull(), F.array(key(F.col("_prev")))).otherwise(F.array().cast("array<string>")).alias("parents"), F.col("name").alias("old"), F.col("_prev.n").alias("given")), "renames")
    start = paths.select(*by, F.col("path").alias("name"), (2 * F.col("n").cast("long") + 2).alias("_at"), F.col("n").alias("_n")).distinct()
    heads = sweeps.last_before(give.unionByName(start, allowMissingColumns=True), [*by, "name"], "_at", F.col("_r"), "_prev").filter("_n IS NOT NULL")
    heads = materialise(heads.select(*by, F.col("name").alias("path"), F.col("_n").alias("n"), F.when(F.col("_prev").isNotNull(), key(F.col("_prev"))).alias("head"), F.col("_prev.n").alias("since")), "heads")
    chain = graph.first_parents(heads.filter("head IS NOT NULL").select("head"), events).join(events.select("commit", "old", "given"), "commit")
    own = heads.select(*by, "path", "n", F.lit(0).alias("step"), F.col("path").alias("name"), "since")
    more = heads.drop("since").join(chain.withColumnRenamed("n", "_k"), "head").select(*by, "path", "n", (F.col("_k") + 1).alias("step"), F.col("old").alias("name"), F.col("given").alias("since"))
    return own.unionByName(more)

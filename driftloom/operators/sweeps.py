"""Sweeps over places: running totals, the last value before, interval difference and bracket trees.

A window over one key puts all of its rows into one task. Here places are cut into blocks: what a block adds, or ends with, is a
row of a small table, a window over that carries it from block to block, and the window over rows has the block in its key.
So a text of any length is split over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BUSY = 1 << 16, 1 << 20


def blocked(rows: DataFrame, place: Column, block: int) -> DataFrame:
    return rows.withColumn("_b", F.floor(place / block))


def running(rows: DataFrame, by: list[str], place: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """rows with <value>_total for each value: its sum over the key up to this place, its own included. Places are whole numbers, unique in a key; null values add nothing."""
    cut = blocked(rows, F.col(place), block)
    sums = cut.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_s{k}") for k, v in enumerate(values)])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "_b", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_c{k}") for k in range(len(values))])
    inside = Window.partitionBy(*by, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [*by, "_b"])
    return out.withColumns({f"{v}_total": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_c{k}") for k, v in enumerate(values)}).drop("_b", *[f"_c{k}" for k in range(len(values))])


def last_before(rows: DataFrame, by: list[str], place: str, value: Column, name: str, block: int = BLOCK, backwards: bool = False) -> DataFrame:
    """rows with `name`: the value of the nearest row before this place (after it, if backwards) whose value isn't null. Null where there is none."""
    at = -F.col(place) if backwards else F.col(place)
    cut = blocked(rows.withColumn("_v", value), at, block)
    ends = cut.groupBy(*by, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_e"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_b", F.last("_e", ignorenulls=True).over(before).alias("_c"))
    inside = Window.partitionBy(*by, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(carried, [*by, "_b"])
    return out.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_c"))).drop("_v", "_b", "_c")


def difference(spans: DataFrame, cuts: DataFrame, on: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """on, start, end, piece, at: what the cuts leave of each key's spans (ends included). Spans that overlap or touch are one, ranges that end before they start
    are empty, null ends too. piece numbers a key's pieces from 0; `at` is how much of the key is left before the piece: the renumbered place of its start.

    A sweep: spans and cuts open and close, pieces are where a span is open and no cut is. A row for each end, whatever the length."""
    fine = lambda df: df.filter(F.col(start) <= F.col(end))
    ends = lambda df, s, c: fine(df).select(*on, F.explode(F.array(F.struct(F.col(start).cast("long").alias("_p"), F.lit(s).alias("_s"), F.lit(c).alias("_k")), F.struct((F.col(end).cast("long") + 1).alias("_p"), F.lit(-s).alias("_s"), F.lit(-c).alias("_k")))).alias("e")).select(*on, "e.*")
    events = ends(spans, 1, 0).unionByName(ends(cuts, 0, 1)).groupBy(*on, "_p").agg(F.sum("_s").alias("_s"), F.sum("_k").alias("_k")).filter("_s <> 0 OR _k <> 0")
    # one layout by blocks for all that follows: what blocks hand on meets the rows where they lie, so that ends are shuffled for it once
    at = [*on, "_b"]
    up, down = Window.partitionBy(*at).orderBy("_p"), Window.partitionBy(*at).orderBy(F.desc("_p"))
    earlier, later = (Window.partitionBy(*on).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    so_far, behind = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    cut = blocked(events, F.col("_p"), block)
    sums = cut.groupBy(*at).agg(F.sum("_s").alias("_cs"), F.sum("_k").alias("_ck"))
    sums = sums.select(*at, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_cs", "_ck")])
    swept = cut.join(sums, at).withColumn("_open", (F.sum("_s").over(so_far) + F.col("_cs") > 0) & (F.sum("_k").over(so_far) + F.col("_ck") == 0))
    shut = F.when(~F.col("_open"), F.col("_p"))
    edges = swept.groupBy(*at).agg(F.max_by("_open", "_p").alias("_lo"), F.min(shut).alias("_hi"))
    edges = edges.select(*at, F.last("_lo").over(earlier).alias("_lo"), F.min("_hi").over(later).alias("_hi"))
    swept = swept.join(edges, at).withColumns({"_was": F.coalesce(F.lag("_open").over(up), "_lo", F.lit(False)), "_next": F.coalesce(F.min(shut).over(behind), "_hi")})
    pieces = swept.filter("_open AND NOT _was").select(*at, "_p", (F.col("_next") - F.col("_p")).alias("_n"))
    lengths = pieces.groupBy(*at).agg(F.sum("_n").alias("_cn"), F.count(F.lit(1)).alias("_c1"))
    lengths = lengths.select(*at, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_cn", "_c1")])
    counted = pieces.join(lengths, at)
    place, left = F.count(F.lit(1)).over(so_far) + F.col("_c1") - 1, F.sum("_n").over(so_far) + F.col("_cn") - F.col("_n")
    return counted.select(*on, F.col("_p").alias(start), (F.col("_p") + F.col("_n") - 1).alias(end), place.alias("piece"), left.alias("at"))


def owners(points: DataFrame, pieces: DataFrame, on: list[str], place: str, start: str, end: str, keep: list[str], block: int = BLOCK, busy: int = BUSY) -> DataFrame:
    """points with `keep` of the piece that holds them (null where none does). Pieces of a key don't overlap: the last that starts
    at or before a point is the only one that may hold it. Points may repeat a place; keys and places that are null are held by nothing.

    Points go through the sweep whole, so they are shuffled once. A block with more than `busy` points is dealt out over parts by the points' hash, each of which has all
    of the block's pieces; there are at most rows / busy such blocks, which go to the tasks."""
    fine = F.lit(True)
    for c in (*on, start):
        fine = fine & F.col(c).isNotNull()
    give = blocked(pieces.filter(fine).select(*on, (2 * F.col(start).cast("long")).alias("_at"), F.struct(F.col(end).alias("_end"), *keep).alias("_piece")), F.col("_at"), 2 * block)
    ask = blocked(points.withColumn("_at", 2 * F.col(place).cast("long") + 1), F.col("_at"), 2 * block)
    at = [*on, "_b"]
    asked = ask.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    crowds = F.broadcast(asked.filter(F.col("_n") > busy).select(*at, F.ceil(F.col("_n") / busy).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    mine = lambda df: df.join(crowds, at, "left").withColumn("_s", F.pmod(F.xxhash64(*points.columns), parts).cast("int")).drop("_parts")
    every = lambda df: df.join(crowds, at, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    ends = give.groupBy(*at).agg(F.max_by("_piece", "_at").alias("_e")).unionByName(asked.select(*at), allowMissingColumns=True).groupBy(*at).agg(F.first("_e", ignorenulls=True).alias("_e"))
    before = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*at, F.last("_e", ignorenulls=True).over(before).alias("_c"))
    inside = Window.partitionBy(*at, "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = mine(ask).withColumn("_point", F.lit(True)).unionByName(every(give), allowMissingColumns=True)
    swept = both.join(every(carried), [*at, "_s"], "left").withColumn("_held", F.coalesce(F.last("_piece", ignorenulls=True).over(inside), F.col("_c"))).filter("_point")
    holds = F.col("_held._end") >= F.col(place)
    first = [*on, place]
    return swept.select(*first, *[c for c in points.columns if c not in first], *[F.when(holds, F.col(f"_held.{c}")).alias(c) for c in keep])


def bracket_tree(tokens: DataFrame, by: list[str], place: str, step: str, block: int = BLOCK) -> DataFrame:
    """tokens with partner, parent and depth. step is 1 for an opening token, -1 for a closing one, else 0 (null too).

    partner: the place of the bracket that closes, or opens, this one; null for other tokens and for ends that have none, which are leaves like these.
    parent: the place of the innermost opening bracket with a partner around the token; null at the top. depth: how many there are around it.

    Brackets of a level take turns: on each, an opening one's partner is the next bracket if that closes. A second running total over those with
    partners alone gives depths that unmatched ends don't shift; a parent is the last opening bracket of the level above."""
    base = tokens.withColumn("_d", F.coalesce(F.col(step).cast("int"), F.lit(0)))
    level = running(base, by, place, ["_d"], block).withColumn("_l", F.when(F.col("_d") > 0, F.col("_d_total") - 1).otherwise(F.col("_d_total"))).drop("_d_total")
    ends = level.filter("_d <> 0").select(*by, "_l", place, "_d")
    mark = F.struct(F.col(place).alias("p"), F.col("_d").alias("d"))
    ends = last_before(last_before(ends, [*by, "_l"], place, mark, "_prev", block), [*by, "_l"], place, mark, "_next", block, backwards=True)
    partner = F.when((F.col("_d") > 0) & (F.col("_next.d") < 0), F.col("_next.p")).when((F.col("_d") < 0) & (F.col("_prev.d") > 0), F.col("_prev.p"))
    paired = ends.select(*by, place, partner.alias("partner")).filter("partner IS NOT NULL")
    rows = base.join(paired, [*by, place], "left").withColumn("_m", F.when(F.col("partner").isNotNull(), F.col("_d")).otherwise(0))
    rows = running(rows, by, place, ["_m"], block).withColumn("depth", F.when(F.col("_m") > 0, F.col("_m_total") - 1).otherwise(F.col("_m_total"))).drop("_m_total")
    ask = rows.filter("depth > 0").select(*by, (F.col("depth") - 1).alias("_l"), place, F.lit(None).cast("long").alias("_open"))
    give = rows.filter("_m > 0").select(*by, F.col("depth").alias("_l"), place, F.col(place).cast("long").alias("_open"))
    found = last_before(ask.unionByName(give), [*by, "_l"], place, F.col("_open"), "parent", block).filter("_open IS NULL").select(*by, place, "parent")
    return rows.drop("_d", "_m").join(found, [*by, place], "left")

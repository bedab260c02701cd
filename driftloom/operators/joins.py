"""The joins between the two sides of a change, on column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_pairs(deleted: DataFrame, inserted: DataFrame, on: list[str], d_id: str, i_id: str) -> DataFrame:
    """Blocks with equal streams, the k-th deletion with the k-th insertion of each stream: no pair is used twice,
    and a stream that a third of all rows share makes as many pairs as rows, not their product."""
    rank = lambda df, c: df.withColumn("k", F.row_number().over(Window.partitionBy(*on).orderBy(c)))
    return rank(deleted, d_id).select(*on, "k", d_id).join(rank(inserted, i_id).select(*on, "k", i_id), [*on, "k"])


def nearest_pairs(deleted: DataFrame, inserted: DataFrame, on: list[str], path: str, d: tuple[str, str], i: tuple[str, str]) -> DataFrame:
    """Blocks with equal streams as on, d id, i id: in the same path first, the k-th by place with the k-th, then what is left by
    place over all paths. d and i: names of id and place. Two equi-joins on ranks, so no pair is used twice."""
    rank = lambda df, by, at: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(at)))

    def met(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        return rank(a, by, d[1]).select(*by, "k", d[0]).join(rank(b, by, i[1]).select(*by, "k", i[0]), [*by, "k"]).select(*on, d[0], i[0])

    near = met(deleted, inserted, [*on, path])
    rest = lambda df, name: df.join(near.select(*on, name), [*on, name], "left_anti")
    return near.unionByName(met(rest(deleted, d[0]), rest(inserted, i[0]), on))


def multiplicity(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def band_pairs(left: DataFrame, right: DataFrame, on: list[str], size: str, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """Pairs with low * left.size <= right.size <= high * left.size. Sizes go to buckets of their logarithm, and each
    left row looks into the few buckets that its band touches: an equi-join, not a product with a filter."""
    bucket = lambda c: F.floor(F.log(1.25, F.greatest(c, F.lit(1)).cast("double")))
    l_size, r_size = F.col(f"l_{size}"), F.col(f"r_{size}")
    le = left.withColumnRenamed(size, f"l_{size}").withColumn("b", F.explode(F.sequence(bucket(F.floor(low * l_size)), bucket(F.ceil(high * l_size)))))
    ri = right.withColumnRenamed(size, f"r_{size}").withColumn("b", bucket(r_size))
    return le.join(ri, [*on, "b"]).filter((r_size >= low * l_size) & (r_size <= high * l_size)).drop("b")


def quick_ratio(tokens: DataFrame, by: list[str], side: str, token: str) -> DataFrame:
    """Upper bound of a pair's ratio: twice the size of the multisets' intersection by the sum of their sizes.
    tokens has a row for each token of either side (side 'a' or 'b'); two empty sides don't occur."""
    counts = tokens.groupBy(*by, token).agg(F.count_if(F.col(side) == "a").alias("ca"), F.count_if(F.col(side) == "b").alias("cb"))
    return counts.groupBy(*by).agg((2 * F.sum(F.least("ca", "cb")) / F.sum(F.col("ca") + F.col("cb"))).alias("quick_ratio"))


def gone(old: DataFrame, new: DataFrame, on: list[str], parent: list[str] | None = None) -> DataFrame:
    """Rows of old without a partner in new; with `parent`, only where that still has rows in new."""
    out = old.join(new.select(*on).distinct(), on, "left_anti")
    return out.join(new.select(*parent).distinct(), parent, "left_semi") if parent else out


def innermost(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, key: list[str], step: int = 64) -> DataFrame:
    """For each point the smallest span around it (the first of equals). Spans are cut to blocks of `step`, so that the range join
    is an equi-join on the block."""
    cut = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.col(end) / step))))
    met = points.withColumn("b", F.floor(F.col(point) / step)).join(cut, [*on, "b"]).filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)))
    size = F.struct((F.col(end) - F.col(start)).alias("size"), F.col(start).alias("s"), F.col(end).alias("e"))
    return met.groupBy(*on, *key).agg(F.min_by(F.struct(start, end), size).alias("span")).select(*on, *key, F.col(f"span.{start}").alias(start), F.col(f"span.{end}").alias(end))


def longest_prefix(names: DataFrame, keys: DataFrame, on: list[str], name: str, key: str, mark: str = ".") -> DataFrame:
    """For each name its longest key that is the name or a prefix of it up to a mark: prefixes are exploded and joined."""
    parts = F.split(F.col(name), f"\\{mark}")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), mark))
    met = names.withColumn("p", F.explode(prefixes)).join(keys.select(*on, F.col(key).alias("p")).distinct(), [*on, "p"])
    return met.groupBy(*on, name).agg(F.max_by("p", F.length("p")).alias(key))


def surviving(edits: DataFrame, tokens: DataFrame, on: list[str], new: str, token: str, path: str) -> DataFrame:
    """edits with `survives`: the new value stands in the base of its own file ('file'), of another ('any'), or not (null)."""
    base = tokens.select(*on, path, F.col(token).alias(new)).distinct()
    own = base.withColumn("own", F.lit(True))
    some = base.select(*on, new).distinct().withColumn("some", F.lit(True))
    out = edits.join(own, [*on, path, new], "left").join(some, [*on, new], "left")
    return out.withColumn("survives", F.when(F.col("own"), "file").when(F.col("some"), "any")).drop("own", "some")


def all_changed(mentions: DataFrame, head: DataFrame, on: list[str], name: str, changed: str, least: int = 2) -> DataFrame:
    """Names that head no longer has, with at least `least` base mentions, all on changed lines."""
    agg = mentions.groupBy(*on, name).agg(F.count(F.lit(1)).alias("mentions"), F.bool_and(changed).alias("every"))
    return agg.filter((F.col("mentions") >= least) & F.col("every")).drop("every").join(head.select(*on, name).distinct(), [*on, name], "left_anti")


def first_places(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """by, total, locations: how many rows each key has, and its first `cap` by order. Ranks are cut off before rows are
    gathered, so no key's rows meet in one array."""
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    top = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= cap)
    some = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("locations"))
    return total.join(some, by)


def left_over(renames: DataFrame, identifiers: DataFrame, defined: DataFrame, on: list[str], old: str, name: str, cap: int = 50, order: list[str] | None = None) -> DataFrame:
    """References at head to renamed definitions that nothing defines any more: on, old, total, locations (the first `cap`)."""
    names = renames.select(*on, F.col(old).alias(name)).distinct().join(defined.select(*on, name).distinct(), [*on, name], "left_anti")
    return first_places(identifiers.join(names, [*on, name]), [*on, name], order or [name], cap)

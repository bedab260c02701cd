"""JSON of any shape as rows, with Spark's VARIANT: dotted keys, plural families, keys that one side lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: What plural forms of a translation key end with.
PLURALS = ["zero", "one", "two", "few", "many", "other"]


def flattened(rows: DataFrame, on: list[str], text: str) -> DataFrame:
    """on, key, value (JSON text of a leaf): a row for each leaf of the column's JSON, keys joined by dots, array elements by
    their number. Text that isn't JSON, null, and a single leaf (which has no key) give none; empty objects and arrays neither. A level a round, as
    many as the deepest value has."""
    level = materialise(rows.select(*on, F.lit("").alias("key"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL"), "json")
    leaves = []
    while True:
        kind = F.schema_of_variant("v")
        open_ = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        leaves.append(level.filter(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")) & (F.col("key") != "")).select(*on, "key", F.to_json("v").alias("value")))
        if not open_.head(1):
            break
        open_.createOrReplaceTempView("_open_json")
        names = ", ".join(f"o.`{c}`" for c in on)
        inside = rows.sparkSession.sql(f"SELECT {names}, o.key AS above, e.pos, e.key AS name, e.value AS v FROM _open_json o, LATERAL variant_explode(o.v) AS e")
        own = F.coalesce("name", F.col("pos").cast("string"))
        level = materialise(inside.select(*on, F.when(F.col("above") == "", own).otherwise(F.concat_ws(".", "above", own)).alias("key"), "v"), "json")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def plural_base(key: Column) -> Column:
    """The key without a plural form's ending (`item_one` and `item_other` are forms of `item`), or the key itself."""
    return F.regexp_replace(key, f"_(ordinal_)?({'|'.join(PLURALS)})$", "")


def orphans(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """on, key, forms: keys (by their plural base) that the old side has and the new one lacks, and how many forms went. Both: on, key."""
    base = lambda df: df.select(*on, "key", plural_base(F.col("key")).alias("base"))
    left = base(old).distinct().join(base(new).select(*on, "base").distinct(), [*on, "base"], "left_anti")
    return left.groupBy(*on, "base").agg(F.count_distinct("key").alias("forms")).withColumnRenamed("base", "key")

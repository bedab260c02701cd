"""Exact deduplication: group by a 128-bit content hash, then compare bytes inside the groups.

Plan. Pass 1 aggregates by (hash, normalised text): Spark's hash aggregate compares whole keys, so a group is one
text, byte for byte, and copies collapse before the shuffle (a hot text leaves one row per task). A second, narrow
aggregate counts the texts of each hash. Pass 2 reads only ids and hashes and joins them to that narrow table; the
join's partitions can be split by AQE, as one side is unique. Only where a hash has several texts (a collision) do
those rows' texts go through a join on (hash, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, materialise


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "largest", content_hash: Callable[[Column], Column] = md5_128, normalise: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """Returns one row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep is "smallest" or "largest": the id that stays in a group of equal texts. Null texts are empty; empty texts
    equal each other. Null ids are never kept before an id; in a group without any id, keep_id is null and every row
    stays. Rows that repeat an id and text are one document: both are kept or neither; group_size counts rows.
    An empty table gives no rows. Only doc_id and text are read, so clashing extra columns don't matter."""
    best = F.max if keep == "largest" else F.min
    norm = documents(docs).select("doc_id", normalise(F.col("text")).alias("norm"))
    keyed = norm.select("doc_id", "norm", content_hash(F.col("norm")).alias("k"))
    texts = keyed.groupBy("k", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(texts.groupBy("k").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "exact")
    narrow = keyed.select("doc_id", "k", F.sha2("norm", 256).alias("text_sha256"))
    out = narrow.join(groups.filter("texts = 1").drop("texts"), "k")
    clash = groups.filter("texts > 1").select("k")
    if clash.head(1):
        rows = keyed.join(clash, "k")
        exact = rows.groupBy("k", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        more = rows.join(exact, ["k", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        out = out.unionByName(more.select(*out.columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""

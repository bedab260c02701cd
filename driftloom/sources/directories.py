"""A change set from two folders, read with Spark's binary reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .captured import NO_NUL, lossy_text


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder) and text of every file; files with a NUL are binary and left out, bytes that aren't UTF-8 become
    replacement characters."""
    root = folder.rstrip("/").replace("file://", "")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_extract("path", r"^(?:[a-z]+:/*)?/?(.*)$", 1).alias("p"), "content").filter(NO_NUL).select(F.substring_index("p", root.lstrip("/") + "/", -1).alias("path"), lossy_text(F.col("content")).alias("text"))


def changes_between(before: DataFrame, after: DataFrame, change_set_id: str) -> DataFrame:
    """Files on both sides are M, even when equal; a deleted and an added file of equal content are one R (the k-th of
    either with the k-th of the other); files with a NUL are left out. before and after: path, text."""
    both = before.select("path", F.col("text").alias("old_text")).join(after.select("path", F.col("text").alias("new_text")), "path", "full_outer")
    same = both.filter("old_text IS NOT NULL AND new_text IS NOT NULL").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("M").alias("status"), "old_text", "new_text")
    nth = lambda df, c: df.withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy(c)))
    gone = nth(both.filter("new_text IS NULL").select(F.col("path").alias("old_path"), "old_text", F.sha2("old_text", 256).alias("digest")), "old_path")
    come = nth(both.filter("old_text IS NULL").select("path", "new_text", F.sha2("new_text", 256).alias("digest")), "path")
    met = gone.join(come, ["digest", "k"], "full_outer")
    status = F.when(F.col("path").isNull(), "D").when(F.col("old_path").isNull(), "A").otherwise("R")
    rest = met.select(F.coalesce("path", "old_path").alias("path"), F.when(status == "R", F.col("old_path")).alias("old_path"), status.alias("status"), F.coalesce("old_text", F.lit("")).alias("old_text"), F.coalesce("new_text", F.lit("")).alias("new_text"))
    out = same.unionByName(rest).filter(~F.col("old_text").contains("\0") & ~F.col("new_text").contains("\0"))
    return out.select(F.lit(change_set_id).alias("change_set_id"), "*")

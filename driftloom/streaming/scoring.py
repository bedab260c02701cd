"""Background scoring: what a cache of answers lacks is scored batch by batch by a pluggable evaluator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(hunks: DataFrame, cache: DataFrame, question_set: str) -> DataFrame:
    """Hunks without an answer of this version."""
    return hunks.join(cache.filter(F.col("question_set") == question_set).select("fingerprint").distinct(), "fingerprint", "left_anti")


def score_batches(evaluate: Callable[[DataFrame], DataFrame], cache_path: str, question_set: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: scores what is pending and appends the answers to the cache. A batch that is delivered again finds its answers there."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            cache = spark.read.parquet(cache_path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], "fingerprint string, question_set string")
        evaluate(pending(batch.dropDuplicates(["fingerprint"]), cache, question_set)).withColumn("question_set", F.lit(question_set)).write.mode("append").parquet(cache_path)

    return run

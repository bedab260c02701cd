"""Helpers shared by the training-data operators: text keys, Arrow batches, bounded samples; scratch tables are the core's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise, scratch_dir

__all__ = ["as_bytes", "ascii_lower", "bucket_of", "discard", "documents", "materialise", "meet", "scratch_dir", "share_by_hash", "slices", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. `lower` is exact, and much faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that other columns, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches: Python objects are only ever held for so many rows, or for one row that is larger."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        each = max(1, min(rows, int(n * max_bytes / max(1, batch.nbytes))))
        while at < n:
            yield batch.slice(at, each)
            at += each


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def bucket_of(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def share_by_hash(df: DataFrame, rows: int, *keys: str, of: int | None = None) -> DataFrame:
    """About `rows` rows of df, or all where it has no more: those whose keys' hash is below a share. Every task picks its
    own, so what reaches the driver is about `rows` rows in all, however many tasks there are. Rows with equal keys go
    together: keys should be distinct. of: the number of rows, if it is known."""
    n = df.count() if of is None else of
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def meet(many: DataFrame, one: DataFrame, on: str | list[str], rows: int, left: bool = False) -> DataFrame:
    """many joined with one, which is unique on `on`. Keys that hold more than a thousandth of `rows` rows (fewer than a thousand
    keys, which go to the tasks) are dealt out over so many parts as they hold thousandths, so that no key's rows meet in one task."""
    on = [on] if isinstance(on, str) else on
    part = max(1000, rows // 1000)
    hot = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > part) & F.col(on[0]).isNotNull()).select(*on, F.ceil(F.col("_n") / part).cast("int").alias("_parts"))
    hot = materialise(hot, "hot")
    if not hot.head(1):
        return many.join(one, on, "left" if left else "inner")
    salted = many.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.floor(F.rand(7) * F.col("_parts")).cast("int"))).drop("_parts")
    dealt = one.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(dealt, [*on, "_salt"], "left" if left else "inner").drop("_salt")

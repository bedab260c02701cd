"""Queries of the training-data operators, with production parameters over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, embedding_dedup, exact_dedup, lexical_search, license_scan, line_dedup, near_dedup, quality, suffix_tree_lm, toxicity, whitening
from .common import table

BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_tree_lm(spark, sf_dir):
    return suffix_tree_lm.score_corpus(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_byte_bpe(spark, sf_dir):
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents"), *BPE, back=True))


def op6_chat_format(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_windows(rows))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_dedup(spark, sf_dir):
    return embedding_dedup.linked_groups(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_suffix_tree_lm, op3_toxicity, op4_exact_dedup, op5_byte_bpe, op6_chat_format, op7_near_dedup, op8_line_dedup, op9_license_scan, op10_decontaminate, op11_embedding_dedup, op12_lexical_search, op13_whitening)}
SQL = {"op4_exact_dedup": exact_dedup.SQL, "op8_line_dedup": line_dedup.SQL, "op12_lexical_search": lexical_search.SQL}

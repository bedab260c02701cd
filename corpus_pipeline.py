"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, tokens.

Each stage takes all that its predecessor kept, calls one operator of driftloom.llm with production parameters, and lets its
decisions take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from driftloom.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from driftloom.llm.common import materialise, table

BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Lines that a document with a smaller id holds go."""
    return line_dedup.without_repeated_lines(docs)


def keep_one_of_near_duplicates(spark, docs, sf_dir):
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    gone = near_dedup.near_groups(docs, width=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode_and_decode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each remaining document."""
    return byte_bpe.digest(byte_bpe.encode(docs, *BPE, back=True))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE encoding and decoding", encode_and_decode),
]

#: SQL can't express the classifier, the templates or the merges; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

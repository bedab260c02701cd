"""Line deduplication over sharded cuckoo filters, each backed by an exact reference-count table.

refs   one row per document and distinct line key: doc_id, tag (hash of the row's text), key (128 bits), lines
       (positions). Written once to the shared folder; it is the exact table from which owners are found again.
shard  key -> number of documents, with a cuckoo filter in front: a key whose fingerprint is absent is new and
       goes in without a look at the table; a fingerprint that is present is confirmed in the table. Deletions lower
       the count and take the fingerprint out at zero, which a Bloom filter can't do.

Counts are combined in each task before the shuffle, so a line that a third of all documents hold reaches its
shard as one row per batch. The number of shards follows the number of refs: memory a shard is bounded.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents, materialise, slices

KEYS_PER_SHARD = 200_000
SLOTS, KICKS = 4, 400
NOBODY = -(1 << 63)  # in place of an owner that isn't known


class CuckooFilter:
    """16-bit fingerprints in buckets of four; partial-key cuckoo hashing; doubles when an insertion fails.

    Doubling needs the full hashes again, which the exact table supplies."""

    def __init__(self, capacity: int = 1024):
        self.n = 1 << max(4, math.ceil(math.log2(max(16, capacity) / SLOTS / 0.85)))
        self.cells = array("H", bytes(2 * SLOTS * self.n))

    def _place(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[:2], "little") or 1
        i = int.from_bytes(key[2:8], "little") & (self.n - 1)
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return i ^ ((fp * 0x5BD1E995 + 0x9E3779B9) >> 7 & (self.n - 1))

    def __contains__(self, key: bytes) -> bool:
        fp, i, j = self._place(key)
        return fp in self.cells[SLOTS * i : SLOTS * i + SLOTS] or fp in self.cells[SLOTS * j : SLOTS * j + SLOTS]

    def add(self, key: bytes) -> bool:
        fp, i, j = self._place(key)
        cells = self.cells
        for b in (i, j):
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if not cells[s]:
                    cells[s] = fp
                    return True
        undo, b = [], i
        for turn in range(KICKS):
            s = SLOTS * b + (turn * 7 + fp) % SLOTS
            undo.append((s, cells[s]))
            fp, cells[s] = cells[s], fp
            b = self._other(b, fp)
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if not cells[s]:
                    cells[s] = fp
                    return True
        for s, old in reversed(undo):
            cells[s] = old
        return False

    def remove(self, key: bytes) -> bool:
        fp, i, j = self._place(key)
        for b in (i, j):
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if self.cells[s] == fp:
                    self.cells[s] = 0
                    return True
        return False


class Shard:
    """A cuckoo filter before an exact table: key -> [documents, smallest id seen in insertions]."""

    def __init__(self, capacity: int = 1024):
        self.filter, self.table = CuckooFilter(capacity), {}

    def insert(self, key: bytes, n: int = 1, owner: int | None = None) -> None:
        if key in self.filter and (entry := self.table.get(key)) is not None:
            entry[0] += n
            if owner is not None and (entry[1] is None or owner < entry[1]):
                entry[1] = owner
            return
        self.table[key] = [n, owner]
        if not self.filter.add(key):
            self._grow()

    def delete(self, key: bytes, n: int = 1) -> None:
        if key not in self.filter or (entry := self.table.get(key)) is None:
            return
        entry[0] -= n
        if entry[0] <= 0:
            del self.table[key]
            self.filter.remove(key)

    def count(self, key: bytes) -> int:
        return self.table.get(key, (0,))[0] if key in self.filter else 0

    def _grow(self) -> None:
        size = 2 * self.filter.n * SLOTS
        while True:
            self.filter = CuckooFilter(size)
            if all(self.filter.add(k) for k in self.table):
                return
            size *= 2

    def dump(self) -> dict:
        return {"filter": self.filter.cells.tobytes(), "keys": b"".join(self.table), "counts": np.array([v[0] for v in self.table.values()], "<i8").tobytes(), "owners": np.array([NOBODY if v[1] is None else v[1] for v in self.table.values()], "<i8").tobytes()}

    @classmethod
    def load(cls, row: dict) -> Shard:
        out = cls()
        out.filter.cells = array("H", row["filter"])
        out.filter.n = len(out.filter.cells) // SLOTS
        counts, owners = (np.frombuffer(row[c], "<i8").tolist() for c in ("counts", "owners"))
        out.table = {row["keys"][16 * i : 16 * i + 16]: [n, None if o == NOBODY else o] for i, (n, o) in enumerate(zip(counts, owners, strict=True))}
        return out


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its 128-bit key; None for keys that are too short. The key's text is the line without
    ASCII white space at its ends, A-Z lower-cased (what strip() and lower() of bytes do)."""
    out = []
    for line in text.lower().split(b"\n"):
        line = line.strip()
        long = len(line) >= 4 * min_chars or len(line) >= min_chars and len(line.decode("utf-8", "replace")) >= min_chars
        out.append(blake2b(line, digest_size=16).digest() if long else None)
    return out


REFS = "doc_id long, tag long, key binary, lines array<int>"


def line_refs(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, tag, key, lines: one row per document row and distinct key of at least min_chars code points."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("key", pa.binary()), ("lines", pa.list_(pa.int32()))])

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, tags, keys, lines = [], [], [], []
            for doc, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), as_bytes(batch, "text"), strict=True):
                own: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text, min_chars)):
                    if key is not None:
                        own.setdefault(key, []).append(i)
                ids += [doc] * len(own)
                tags += [tag] * len(own)
                keys += own.keys()
                lines += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], schema=schema)

    return documents(docs).select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(refs, REFS)


def repeated_keys(refs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """key, n_docs, owner of the keys that at least two references hold, found by the sharded filters."""
    shards = max(1, math.ceil(refs.count() / keys_per_shard))
    pairs = pa.schema([("key", pa.binary()), ("n_docs", pa.int64()), ("owner", pa.int64())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = pa.Table.from_batches([batch]).group_by("key").aggregate([([], "count_all"), ("doc_id", "min")])
                yield from got.select(["key", "count_all", "doc_id_min"]).rename_columns(pairs.names).cast(pairs).combine_chunks().to_batches()

    def through_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shard(keys_per_shard // 2)
        for batch in batches:
            for key, n, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.insert(key, n, owner)
        rows = [(k, n, o) for k, (n, o) in own.table.items() if n > 1]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), pairs.types, strict=True)], schema=pairs)

    kind = "key binary, n_docs long, owner long"
    partial = refs.select("key", "doc_id").mapInArrow(combine, kind)
    return partial.repartition(shards, "key").mapInArrow(through_shard, kind)  # a task is a shard


def dropped_lines(refs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, tag, drops: the positions that each document row loses, which holds a key that a smaller id owns."""
    hit = refs.join(repeated.select("key", "owner"), "key").filter(F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("owner"))))
    return hit.groupBy("doc_id", "tag").agg(F.flatten(F.collect_set("lines")).alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Returns one row per row of docs: doc_id, kept_text, n_lines, n_dropped.

    A key found in at least two documents loses all its lines except in the smallest doc_id that holds it, where all
    of them stay. Null and empty texts are one empty line. A null id ranks after every other; where only rows
    without id hold a key, nothing goes. Rows that repeat an id are one document and keep the same lines. Every line
    of a text may go: the rest is then empty and n_dropped equals n_lines. An empty table gives no rows."""
    rows = documents(docs)
    return _cut(rows, _drops_of(rows, min_chars, keys_per_shard), "doc_id long, kept_text string, n_lines long, n_dropped long", "kept_text")


def without_repeated_lines(docs: DataFrame, min_chars: int = 10, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """The rows of docs with all their columns, text as dedup_lines keeps it and n_chars (where there is one) to match.

    Nulls, ties, repeated rows and very long texts are as in dedup_lines; a null text becomes empty. An empty table gives none. Other
    columns may have any names."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = _cut(rows, _drops_of(docs, min_chars, keys_per_shard), rows.schema, "text")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _drops_of(docs: DataFrame, min_chars: int, keys_per_shard: int) -> DataFrame:
    refs = materialise(line_refs(docs, min_chars), "line-refs")
    return dropped_lines(refs, repeated_keys(refs, keys_per_shard))


def _cut(rows: DataFrame, drops: DataFrame, schema, text_column: str) -> DataFrame:
    """rows with text_column after the drops; n_lines and n_dropped too where rows have no columns of these names but the
    schema does."""
    free = "_" * (1 + max(map(len, rows.columns)))  # longer than any column's name
    drop_name = f"{free}drops"
    names = {"doc_id": f"{free}id", "tag": f"{free}tag", "drops": drop_name}
    joined = rows.withColumn(f"{free}own", F.xxhash64(F.col("text"))).join(drops.withColumnsRenamed(names), F.col("doc_id").eqNullSafe(F.col(f"{free}id")) & (F.col(f"{free}own") == F.col(f"{free}tag")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(as_bytes(batch, "text"), batch.column(drop_name).to_pylist(), strict=True):
                lines, drop = text.split(b"\n"), set(drop or ())
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                n_lines.append(len(lines))
                n_dropped.append(len(drop))
            made = {text_column: pa.array(texts, pa.binary()).cast(pa.string(), safe=False), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            columns = made | {n: batch.column(n) for n in own if n != text_column}
            yield pa.RecordBatch.from_arrays([columns[n] for n in wanted], names=wanted)

    own = rows.columns
    wanted = [f.name for f in schema] if not isinstance(schema, str) else [x.split()[0] for x in schema.split(", ")]
    return joined.select(*own, drop_name).mapInArrow(cut, schema)


INDEX = "shard int, filter binary, keys binary, counts binary, owners binary"


def update_shards(state: DataFrame | None, refs: DataFrame, sign: int, n_shards: int) -> DataFrame:
    """shard, filter, keys, counts, owners after the references in refs are inserted (sign 1) or deleted (sign -1).

    This is the incremental form: an index is a state (this table, n_shards fixed when it is made) and the refs table. Each
    key keeps the smallest id that brought it. Deleting what was inserted gives back the counts from before; where an owner
    goes and others remain, the next one follows from the refs that remain (repeated_keys over them)."""
    blob = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("filter", "keys", "counts", "owners"))])
    delta = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"))
    if state is None:
        state = refs.sparkSession.createDataFrame([], INDEX)

    def apply(old: pa.Table, change: pa.Table) -> pa.Table:
        shard = Shard.load(old.to_pylist()[0]) if old.num_rows else Shard(max(1024, 2 * change.num_rows))
        number = (old if old.num_rows else change).column("shard")[0].as_py()
        for key, n, owner in zip(*(change.column(c).to_pylist() for c in ("key", "n", "owner")), strict=True):
            shard.insert(key, n, owner) if sign > 0 else shard.delete(key, n)
        return pa.Table.from_pylist([{"shard": number, **shard.dump()}], schema=blob)

    return state.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(apply, INDEX)


def indexed_keys(state: DataFrame) -> DataFrame:
    """key, n_docs, owner of an index's keys that at least two documents hold: what repeated_keys gives for its refs."""
    pairs = pa.schema([("key", pa.binary()), ("n_docs", pa.int64()), ("owner", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                some = [(k, n, o) for k, (n, o) in Shard.load(row).table.items() if n > 1]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], t) for k, t in enumerate(pairs.types)], schema=pairs)

    return state.mapInArrow(rows, "key binary, n_docs long, owner long")


SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

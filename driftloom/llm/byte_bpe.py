"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where boundaries agree, then encoded.

A pre-token match depends only on the text from its start on (the pattern has no look-behind). So once a boundary of
the chunk on the left is also a boundary of the chunk on the right, all later boundaries of the right chunk hold. Only
boundaries that the chunk's end can't have changed are used. Where the overlap has no common boundary (a run of
letters longer than it, say), the left scan goes on over the next chunk, which is always right.

Documents up to `spread_chars` are chunked and stitched inside their task. Longer ones are exploded into chunk rows that
are dealt out over the cluster, scanned there, and stitched by document from (chunk, boundaries).
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

CHUNK, OVERLAP, SPREAD = 16_384, 512, 1 << 20
CACHE = 200_000

#: Letters and numbers that the installed `regex` knows and the reference tokenizer's Unicode tables
#: (version 16) don't; to those they are symbols.
NEWER = regex.compile(
    "[\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1\\uAB6C-\\uAB6D"
    "\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE\\U00011B0A\\U00011DB0-\\U00011DDB\\U00011DE0-\\U00011DE9"
    "\\U00011DF1\\U0001246F\\U00012475-\\U0001247F\\U00012550-\\U00012686\\U00016EA0-\\U00016EB8\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF6"
    "\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA\\U00018D09-\\U00018D20\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191\\U000191A0-\\U000191D2"
    "\\U0001B123-\\U0001B128\\U0001B168\\U0001D6A6\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF"
    "\\U0001E6C0-\\U0001E6DE\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5\\U0001E6E7-\\U0001E6ED\\U0001E6F0-\\U0001E6F4\\U0001E6FE-\\U0001E6FF"
    "\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F]"
)


def scanned_as(text: str) -> str:
    """The text with each of those characters replaced by a symbol, so that boundaries are the same."""
    if text.isascii():
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return NEWER.sub("\u00a7", text)
    return text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """One vocabulary: pre-token pattern, merges by rank, decoding."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.scan = regex.compile(pattern)
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._bytes = {v: k for k, v in self.ranks.items()}
        self._cache: dict[str, bytes] = {}

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        got = self._cache.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            one = self.ranks.get(raw)
            got = np.array([one] if one is not None else self._core._encode_single_piece(raw), "<u4").tobytes()
            if len(piece) <= 64:
                if len(self._cache) >= CACHE:
                    self._cache.clear()
                self._cache[piece] = got
        return got

    def ends(self, text: str, start: int = 0) -> list[int]:
        """Ends of the pre-tokens of a text from start on."""
        return [m.end() for m in self.scan.finditer(scanned_as(text), start)]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        cache, out = self._cache, []
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            for p in pieces:
                out.append(cache.get(p) or self.piece_ids(p))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        b = self._bytes
        return b"".join([b[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        if len(text) <= chunk + overlap:
            if (seen := scanned_as(text)) is text:
                return self.encode_pieces(self.scan.findall(text))
            return self.encode_pieces([text[m.start() : m.end()] for m in self.scan.finditer(seen)])
        cuts = chunk_starts(len(text), chunk)
        parts = [[s + e for e in self.ends(text[s : s + chunk + overlap])] for s in cuts]
        ends = stitch(self, text, parts, cuts, chunk + overlap)
        return self.encode_pieces([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])


def chunk_starts(n: int, chunk: int) -> list[int]:
    return list(range(0, max(1, n), chunk))


def stitch(bpe: ByteBpe, text: str, parts: list[list[int]], starts: list[int], width: int) -> list[int]:
    """True boundaries of the whole text from those of its chunks (absolute positions), chunk k covering
    starts[k] to starts[k] + width."""
    out = parts[0]
    for k in range(1, len(parts)):
        seen = min(len(text), starts[k - 1] + width)  # end of what the left scan saw
        if seen >= len(text):
            break
        # a match that ends two characters before the end of the scan can't have looked past it
        sure = bisect_left(out, seen - 1)
        left, right = out[:sure], parts[k]
        there = set(right)
        at = next((i for i in range(bisect_left(left, starts[k]), len(left)) if left[i] in there), None)
        if at is None:
            here = left[-1] if left else 0
            here_to = min(len(text), starts[k] + width)
            right = [here + e for e in bpe.ends(text[here:here_to])]
            out = left + right
        else:
            out = left[: at + 1] + right[bisect_left(right, left[at]) + 1 :]
    return out


@lru_cache(maxsize=4)
def bpe_of(path: str, pattern: str) -> ByteBpe:
    """One instance for each Python worker."""
    return ByteBpe(path, pattern)


IDS, BOTH = "doc_id long, ids binary", "doc_id long, ids binary, raw binary"


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, spread_chars: int = SPREAD, back: bool = False) -> DataFrame:
    """Returns one row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. Null ids stay null. Rows are encoded each for itself, so repeated rows stay.
    The vocabulary file must lie at `path` on every executor. back: with raw, what decode() gives for the ids, worked out by the same Python worker,
    so that a core holds one vocabulary and one batch, not two of each."""
    rows = documents(docs)
    names = ["doc_id", "ids", "raw"] if back else ["doc_id", "ids"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in slices(batches):
            ids = [bpe.encode(t, chunk, overlap) for t in batch.column("text").to_pylist()]
            raw = [pa.array([bpe.decode(x) for x in ids], pa.binary())] if back else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), *raw], names=names)

    long = F.char_length("text") > spread_chars
    return rows.filter(~long).mapInArrow(whole, BOTH if back else IDS).unionByName(_spread(rows.filter(long), path, pattern, chunk, overlap, back))


def _spread(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int, back: bool) -> DataFrame:
    """The same for very long texts: chunk rows over the cluster, stitched by document."""
    wide = max(chunk, 1 << 18)
    cut = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").select("doc_id", "row", F.explode(F.transform(F.sequence(F.lit(0), ((F.char_length("text") - 1) / wide).cast("int")), lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * wide + 1, F.lit(wide + overlap)).alias("text")))).alias("c")).select("doc_id", "row", "c.k", "c.text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in slices(batches, 4):
            ends = [bpe.ends(t) for t in batch.column("text").to_pylist()]
            yield batch.append_column("ends", pa.array(ends, pa.list_(pa.int32())))

    def join(group: pa.Table) -> pa.Table:
        bpe = bpe_of(path, pattern)
        parts = sorted(zip(group.column("k").to_pylist(), group.column("text").to_pylist(), group.column("ends").to_pylist(), strict=True), key=lambda p: p[0])
        text = "".join(t[:wide] for _, t, _ in parts)
        starts = [k * wide for k, _, _ in parts]
        ends = stitch(bpe, text, [[s + e for e in p[2]] for s, p in zip(starts, parts, strict=True)], starts, wide + overlap)
        ids = bpe.encode_pieces([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        out = pa.table({"doc_id": group.column("doc_id").slice(0, 1).cast(pa.int64()), "ids": pa.array([ids], pa.binary())})
        return out.append_column("raw", pa.array([bpe.decode(ids)], pa.binary())) if back else out

    scanned = cut.repartition("row", "k").mapInArrow(scan, "doc_id long, row long, k int, text string, ends array<int>")
    return scanned.groupBy("row").applyInArrow(join, BOTH if back else IDS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, raw: the bytes of all tokens, one after the other."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("raw", pa.binary())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in slices(batches):
            raw = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, ids binary, raw binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The query's columns."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))

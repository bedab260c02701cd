"""Language-model scoring by a probabilistic suffix tree over word tokens.

The root is the smoothed unigram distribution over all training tokens. A state is a context of the last words, of any
length. It is looked at where its parent (the context without its oldest word) is a state, and it has an explicit next
symbol wherever that one's discounted share diverges from its probability in the parent by more than the entry is worth,
in likelihood; the state is retained where its entries gain more than the rest loses. All other symbols take the parent's
probability, scaled so that every state's distribution sums to one over the vocabulary and one unknown symbol. A token is scored in
the longest suffix of what stands before it that is a state.

Learning goes by length. Texts are cut once into chunks of word hashes in the shared folder. Each level is one pass over
them: it counts the sequences of one length (combined in the tasks before the shuffle, so no word or context is a hot key),
brings the contexts of those that are frequent, and meets their counts and parents' probabilities in joins. What is
frequent is an absolute count, `least`, whatever the corpus: the tree grows with it, as a distributed table. Levels end
where a whole level gains less than `least_gain` a token, or where no context is retained.

Scoring is a sum over a token's lookups: its root probability, for each state the logarithm of the parent's share, for each
explicit entry what it differs by. The most frequent entries, `head_rows` at most, go to the tasks; the others are looked
up by a shuffled join on their hash. Bit tables of a fixed size spare sequences and lookups that can't be there; where
there are too many for a table to tell, all are sent, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import as_bytes, bucket_of, discard, documents, materialise, slices
from .near_dedup import mix

U = np.uint64
PIECE, LEAD, SEGMENT = 1 << 18, 32, 1 << 20  # tokens of a chunk, of what is repeated from the chunk before, bytes split at once
HELD, BITS = 1 << 19, 27
DISCOUNT, COST = 0.5, 3.0
BASE, STEP = U(0x9FB21C651E98DF25), U(0xD1B54A32D192ED03)
ENTRY, STATE = 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85
SPACE = re.compile(rb"[\x09-\x0D ]")
END = U(xxh3_64_intdigest(b"\n"))  # no word holds a line's end


def planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: of sorted ones the first planes compress to nothing."""
    return x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplaned(raw: bytes, at: int, size: int, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, wide * size, at).reshape(wide, size).T.copy().view(kind).ravel().astype(kind[1:])


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows that go to Python at once, for queries that run inside: chunks are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Numbers(dict):
    """Word -> its number in a chunk, from 1; 0 is a text's end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def words_of(text: bytes, segment: int) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists from `segment` bytes each."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + segment) if len(text) - at > segment else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


class Chunk:
    """Tokens of several texts, the first of which may go on from the chunk before: then `lead` tokens are repeated."""

    def __init__(self, lead: list[bytes]):
        self.number, self.tokens, self.texts, self.n, self.lead = Numbers(), [], [], 0, len(lead)
        self.add(lead)

    def add(self, words: list[bytes]) -> None:
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.n += len(words)

    def close(self, text: tuple, ended: bool) -> None:
        if ended:
            self.tokens.append(np.zeros(1, np.uint32))
            self.n += 1
        self.texts.append((*text, self.n))

    def whole(self, number: int) -> pa.RecordBatch:
        h = np.fromiter(map(xxh3_64_intdigest, self.number), U, len(self.number))
        row, doc, train, ends = ([list(c)] for c in zip(*self.texts, strict=True))
        columns = [[number], row, doc, train, ends, [self.lead], [h.tobytes()], [planes(np.concatenate(self.tokens))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CHUNK.types, strict=True)], schema=CHUNK)


CHUNKS = "chunk long, row array<long>, doc_id array<long>, train array<boolean>, ends array<int>, lead int, words binary, tokens binary"
CHUNK = pa.schema([("chunk", pa.int64()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int32())), ("lead", pa.int32()), ("words", pa.binary()), ("tokens", pa.binary())])


def chunks(rows: DataFrame, piece: int = PIECE, segment: int = SEGMENT) -> DataFrame:
    """Texts (row, doc_id, train, text) as chunks of about `piece` tokens; longer texts go over several."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number = Chunk([]), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            rest = zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "train")), strict=True)
            for text, body in zip(rest, as_bytes(batch, "text"), strict=True):
                last: list[bytes] = []
                for words in words_of(body, segment):
                    if chunk.n >= piece:
                        chunk.close(text, False)
                        yield chunk.whole(number)
                        chunk, number = Chunk(last), number + 1
                    chunk.add(words)
                    last = (last + words)[-LEAD:]
                chunk.close(text, True)
                if chunk.n >= piece:
                    yield chunk.whole(number)
                    chunk, number = Chunk([]), number + 1
        if chunk.texts:
            yield chunk.whole(number)

    return rows.select("row", "doc_id", "train", "text").mapInArrow(cut, CHUNKS)


@dataclass
class Tokens:
    """A chunk's tokens: hash, number of the word in the chunk's list, number of the text, place in it, and whether they are
    the chunk's own and learned from."""

    words: np.ndarray
    word: np.ndarray
    h: np.ndarray
    text: np.ndarray
    at: np.ndarray
    own: np.ndarray
    learned: np.ndarray

    def sequences(self, k: int) -> np.ndarray:
        """Hash of the k tokens that end at each token (of use where at >= k - 1)."""
        if k == 1:
            return self.h
        out, power = self.h.copy(), U(1)
        for t in range(1, k):
            power *= BASE
            out[t:] += self.h[:-t] * power
        return mix(out + U(k) * STEP)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Tokens]]:
    with np.errstate(over="ignore"):
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                words, word = np.concatenate(([END], np.frombuffer(row["words"], U))), unplaned(row["tokens"], 0, len(row["tokens"]) // 4, ">u4")
                h = words[word]
                ends = np.array(row["ends"], np.int64)
                size = np.diff(ends, prepend=0)
                text = np.repeat(np.arange(len(ends), dtype=np.int32), size)
                place = np.arange(len(h), dtype=np.int32)
                own = place >= row["lead"]
                yield row, Tokens(words, word, h, text, place - np.repeat((ends - size).astype(np.int32), size), own, own & np.array(row["train"], bool)[text])


class Bits:
    """A bit table over hashes, of at most 2^BITS bits, two for each hash: what it hasn't isn't there."""

    def __init__(self, table: np.ndarray):
        self.last, self.table = U(len(table) - 1), np.packbits(table, bitorder="little").view(U)

    def has(self, h: np.ndarray) -> np.ndarray:
        p, q = h & self.last, h >> U(32) & self.last
        return (self.table[p >> U(6)] >> (p & U(63))) & (self.table[q >> U(6)] >> (q & U(63))) & U(1) == 1


def bit_table(keys: DataFrame) -> Bits | None:
    """Over the hashes `key` of a table; None where there are too many for it to tell much. Up to 2^(BITS - 3) hashes go
    to the driver, two places of 4 bytes for each, and 2^(BITS - 3) bytes to the tasks."""
    n = keys.count()
    if n > 1 << (BITS - 3):
        return None
    bits = min(BITS, max(10, n.bit_length() + 5))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, last = batch.column("key").to_numpy().view(U), U((1 << bits) - 1)
            p = np.concatenate((h & last, h >> U(32) & last)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary())], names=["p"])

    table = np.zeros(1 << bits, bool)
    for p in keys.select("key").mapInArrow(places, "p binary").toArrow().column("p").to_pylist():
        table[np.frombuffer(p, np.uint32)] = True
    return Bits(table)


COUNTS = "key long, s long, p long, n long"
COUNTED = pa.schema([(c, pa.int64()) for c in ("key", "s", "p", "n")])
PARTS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("body", pa.binary())])
ALONE, WORD, WHOLE = 0, 1, 2  # a sequence without its context, a word, a sequence with its context


def parts_of(table: DataFrame) -> int:
    """Ranges of keys: several for each shuffle partition, so that these are even, and one for two chunks at least."""
    return max(4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() // 2)


def key_part(key: np.ndarray, parts: int) -> np.ndarray:
    """Which part of the range of keys each is in."""
    return (key >> U(32)) * U(parts) >> U(32)


def dealt(kind: int, parts: int, key: np.ndarray, n: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys with their counts, a row for each part of the range of keys, in batches of about 1 MB."""
    cut = np.searchsorted(key_part(key, parts), np.arange(parts + 1))
    rows, size = [], 0
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            rows.append((kind, k, b - a, planes(key[a:b]) + planes(n[a:b].astype(np.uint32)) + b"".join(planes(x[a:b]) for x in more)))
            size += len(rows[-1][3])
        if rows and (size >= 1 << 20 or k == parts - 1):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PARTS.types, strict=True)], schema=PARTS)
            rows, size = [], 0


class Counter:
    """Counts of one kind of sequence in a task: distinct keys are kept while they repeat, and sent where they don't or are many."""

    def __init__(self, kind: int, parts: int):
        self.kind, self.parts = kind, parts
        self.new: list[tuple] = []
        self.held: list[tuple] = []

    def add(self, key: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.new.append((key, *more))
        if sum(len(x[0]) for x in self.new) >= HELD:
            yield from self.settle()

    def settle(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.new:
            key, *more = (np.concatenate(c) for c in zip(*self.new, strict=True))
            self.new = []
            some = distinct(key, *more)
            if 4 * len(some[0]) > 3 * len(key) and not last:
                yield from dealt(self.kind, self.parts, *some)
            else:
                self.held.append(tuple(some))
        if last or sum(len(x[0]) for x in self.held) >= 3 * HELD:
            if self.held:
                key, n, *more = (np.concatenate(c) for c in zip(*self.held, strict=True))
                order = np.argsort(key)
                key = key[order]
                first = run_starts(key)
                whole = (key[first], np.add.reduceat(n[order], first) if len(first) else n, *(x[order[first]] for x in more))
                self.held = [whole]
            if self.held and (last or len(self.held[0][0]) >= 2 * HELD):
                yield from dealt(self.kind, self.parts, *self.held.pop())


def merged(part: pa.Table, least: int) -> pa.Table:
    """The whole counts of one part."""
    kind, columns = part.column("kind")[0].as_py(), []
    for size, raw in zip(part.column("size").to_pylist(), part.column("body").to_pylist(), strict=True):
        places = [(0, ">u8"), (8 * size, ">u4"), (12 * size, ">u8"), (20 * size, ">u8")]
        columns.append([unplaned(raw, at, size, t) for at, t in (places if kind == WHOLE else places[:2])])
    key, n, *more = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = run_starts(key)
    n = np.add.reduceat(n[order].astype(np.int64), first)
    keep = np.flatnonzero(n >= (1 if kind == WORD else least))
    at = order[first[keep]]
    s, p = (x[at].view(np.int64) for x in more) if kind == WHOLE else (np.full(len(keep), kind), np.zeros(len(keep), np.int64))
    return pa.Table.from_arrays([pa.array(c) for c in (key[first[keep]].view(np.int64), s, p, n[keep])], schema=COUNTED)


def counted(table: DataFrame, k: int, least: int, shared: Broadcast | None = None) -> DataFrame:
    """key, s, p, n of the sequences that training texts hold: of k + 1 tokens the hash alone (s is ALONE), where both its
    parts of k tokens are frequent; of k tokens, where they are frequent and their context's parent is retained, also the hashes
    of the context s and of the sequence p without its oldest token. With k = 1 all words (s is WORD), and all pairs. Of
    sequences only those that stand there `least` times are returned. shared: bit tables of what is frequent and retained.

    Tasks send sorted counts in one row for each range of keys; there are so many ranges that one holds a few chunks'
    worth of keys."""
    parts = parts_of(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, whole, alone = (Counter(kind, parts) for kind in (WORD, WHOLE, ALONE))
        frequent, retained = shared.value if shared else (None, None)
        for _, t in opened(batches):
            if not t.learned.any():
                continue
            own = t.sequences(k)
            if k == 1:
                yield from words.add(own[t.learned])
                ok = np.ones(len(own), bool)
            else:
                ok = t.at >= k - 1
                if frequent is not None:
                    ok[ok] = frequent.has(own[ok])
                at = np.flatnonzero(ok & t.learned)
                shorter = t.sequences(k - 1)
                if retained is not None and k > 2:
                    at = at[retained.has(t.sequences(k - 2)[at - 1])]
                yield from whole.add(own[at], shorter[at - 1], shorter[at])
            at = np.flatnonzero(t.learned & (t.at >= k) & ok & np.concatenate(([False], ok[:-1])))
            yield from alone.add(t.sequences(k + 1)[at])
        for counter in (words, whole, alone):
            yield from counter.settle(last=True)

    sent = table.mapInArrow(run, "kind int, part int, size int, body binary")
    return sent.groupBy("kind", "part").applyInArrow(lambda t: merged(t, least), COUNTS)


def tested(rows: DataFrame, totals: DataFrame, parents: DataFrame, label: str) -> tuple[DataFrame, DataFrame, float]:
    """The divergence tests of one level. rows: key, s, p, n; totals: key, n of the contexts; parents: key, l (the logarithm
    of the probability in the parent). Returns the sequences in retained contexts (key, n, l, and for explicit ones what
    they differ by from the rest), the states (key, n, mass: the logarithm of the parent's share), and their whole gain."""
    met = rows.join(totals.select(F.col("key").alias("s"), F.col("n").alias("total")), "s").join(parents.select(F.col("key").alias("p"), F.col("l").alias("below")), "p")
    table = materialise(met.select("key", "s", "n", "total", "below"), f"{label}-met")
    met = table.withColumn("share", F.log((F.col("n") - DISCOUNT) / F.col("total")))
    met = met.withColumn("gain", F.col("n") * (F.col("share") - F.col("below")) - (COST + 0.5 * F.log("total")))
    of = met.filter("gain > 0").groupBy("s").agg(F.first("total").alias("total"), F.sum(F.exp("share")).alias("a"), F.sum(F.exp("below")).alias("b"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    tiny = F.lit(1e-12)
    mass = F.log(F.greatest(1 - F.col("a"), tiny) / F.greatest(1 - F.col("b"), tiny))
    states = of.withColumn("mass", mass).withColumn("net", F.col("gain") + (F.col("total") - F.col("n")) * F.col("mass")).filter("net > 0")
    states = materialise(states.select(F.col("s").alias("key"), F.col("total").alias("n"), "mass", "net"), f"{label}-states")
    inside = met.join(states.select(F.col("key").alias("s"), "mass"), "s")
    good = F.col("gain") > 0
    inside = inside.select("key", "n", F.when(good, F.col("share")).otherwise(F.col("mass") + F.col("below")).alias("l"), F.when(good, F.col("share") - F.col("mass") - F.col("below")).alias("differs"))
    inside = materialise(inside, f"{label}-inside")
    discard(table)
    return inside, states, states.agg(F.coalesce(F.sum("net"), F.lit(0.0))).first()[0]


@dataclass
class Tree:
    """n, v: training tokens and distinct ones. words (key, n) and lookups (key, n, v: log10) are whole tables; levels are
    the lengths of the longest states."""

    n: int
    v: int
    words: DataFrame
    lookups: DataFrame
    levels: int

    def root(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + 1.0 * (self.v + 1)))


def small_batches(table: DataFrame, made, label: str) -> DataFrame:
    """The scratch table of a pass over chunks, which are read one at a time."""
    with batches_of(table.sparkSession, 1):
        return materialise(made(), label)


def learn(table: DataFrame, least: int = 16, least_gain: float = 0.1) -> Tree:
    """The tree of the chunks' training texts."""
    sc = table.sparkSession.sparkContext
    first = small_batches(table, lambda: counted(table, 1, least), "sequences")
    words = first.filter(F.col("s") == WORD).select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    lookups = words.limit(0).select("key", "n", F.lit(0.0).alias("v"))
    totals, parents = words, words.select("key", F.log((F.col("n") + 1.0) / F.lit(n + 1.0 * (v + 1))).alias("l"))
    counts, retained, levels, held = first, None, 0, [first]
    tag = lambda c, t: F.col(c).bitwiseXOR(F.lit(t))
    while n and levels < LEAD - 1:
        frequent = counts.filter(F.col("s") == ALONE).select("key", "n")
        shared = sc.broadcast((bit_table(frequent), retained))
        counts = small_batches(table, lambda shared=shared, k=levels + 2: counted(table, k, least, shared), "sequences")
        shared.destroy()
        inside, states, gain = tested(counts.filter(F.col("s") != ALONE), totals, parents, f"level-{levels + 1}")
        held.append(counts)
        if len(held) > 3:  # the first has the words, the second to last the next level's totals
            discard(held.pop(1))
        if not gain:
            break
        levels += 1
        entries = inside.filter("differs IS NOT NULL").select(tag("key", ENTRY).alias("key"), "n", (F.col("differs") / log(10)).alias("v"))
        lookups = lookups.unionByName(entries).unionByName(states.select(tag("key", STATE).alias("key"), "n", (F.col("mass") / log(10)).alias("v")))
        if gain < least_gain * n:
            break
        totals, parents, retained = frequent, inside, bit_table(states)
    discard(*held[1:])
    return Tree(n, v, words, lookups, levels)


def most_frequent(df: DataFrame, rows: int) -> tuple[int, list[np.ndarray]]:
    """A count such that at most `rows` rows of df reach it, and their columns as arrays, by key."""
    by = {int(r.b): r.k for r in df.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}
    bound, seen = max(by, default=0) + 1, 0
    while bound > 0 and seen + by.get(bound - 1, 0) <= rows:
        bound -= 1
        seen += by.get(bound, 0)
    got = df.filter(F.col("n") >= 1 << bound).toArrow()
    columns = [np.asarray(got.column(c).combine_chunks()) if got.num_rows else np.zeros(0, np.int64) for c in df.columns]
    order = np.argsort(columns[0].view(U), kind="stable")
    return 1 << bound, [c[order] for c in columns]


class Known:
    """Values by sorted hashes, found through a table of where each run of equal first bits begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, min(22, len(keys).bit_length() + 1))
        self.keys, self.values, self.bits = keys.view(U), values, U(64 - bits)
        self.begin = np.searchsorted(self.keys >> self.bits, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of those that are known, and their values."""
        run = (h >> self.bits).astype(np.int64)
        place, end = self.begin[run], self.begin[run + 1]
        open_, found, of = np.flatnonzero(place < end), [], []
        while len(open_):
            hit = self.keys[place[open_]] == h[open_]
            found.append(open_[hit])
            of.append(place[open_[hit]])
            open_ = open_[~hit]
            place[open_] += 1
            open_ = open_[place[open_] < end[open_]]
        at = np.concatenate(found) if found else open_
        return at, self.values[np.concatenate(of)] if of else self.values[:0]


def run_starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def distinct(key: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, how often each is there, and what else stands beside one of each."""
    if not more:
        return list(np.unique(key, return_counts=True))
    order = np.argsort(key)
    key = key[order]
    first = run_starts(key)
    return [key[first], np.diff(np.append(first, len(key))), *(x[order[first]] for x in more)]


ASK = "chunk long, part int, size int, body binary, row array<long>, doc_id array<long>, train array<boolean>, n_tokens array<long>, known array<long>, base array<double>, score array<double>"
ASKED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("body", pa.binary()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64()))])
TEXTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def answered(asked: pa.Table, values: pa.Table, root) -> pa.Table:
    """What the lookups of one part add to the texts that ask: for each chunk the numbers of its texts and their sums."""
    key, word = values.column("key").to_numpy().view(U), values.column("word").to_numpy()
    key = key ^ np.where(word, U(WORD), U(0))
    order = np.argsort(key)
    key, n, v = key[order], values.column("n").to_numpy()[order], values.column("v").to_numpy()[order]
    out = []
    for chunk, size, raw in zip(asked.column("chunk").to_pylist(), asked.column("size").to_pylist(), asked.column("body").to_pylist(), strict=True):
        want, of, is_word = unplaned(raw, 0, size, ">u8"), unplaned(raw, 8 * size, size, ">u4"), np.frombuffer(raw, bool, size, 12 * size)
        want = want ^ np.where(is_word, U(WORD), U(0))
        at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
        hit = key[at] == want if len(key) else np.zeros(size, bool)
        count = np.where(hit, n[at], 0) if len(key) else np.zeros(size)
        base = np.where(is_word, root(count), 0.0)
        more = np.where(is_word, base, np.where(hit, v[at], 0.0) if len(key) else 0.0)
        text, place = np.unique(of, return_inverse=True)
        add = lambda x, place=place, k=len(text): np.bincount(place, x, k)
        known = add(is_word & (count > 0)).astype(np.int64)
        out.append((chunk, -2, 0, None, text.astype(np.int64), None, None, None, known, add(base), add(more)))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ASKED.types, strict=True)], schema=ASKED)


def summed(rows: pa.Table) -> pa.Table:
    """The texts of one chunk with all that was added to them."""
    whole = rows.to_pylist()
    own = next(r for r in whole if r["part"] == -1)
    sums = {c: np.array(own[c], t) for c, t in (("known", np.int64), ("base", np.float64), ("score", np.float64))}
    for r in whole:
        if r["part"] == -2:
            for c, x in sums.items():
                x[r["row"]] += r[c]
    return pa.table([pa.array(own[c] if c not in sums else sums[c], t) for c, t in zip(TEXTS.names, TEXTS.types, strict=True)], schema=TEXTS)


def score_corpus(docs: DataFrame, train: Column | None = None, least: int = 16, least_gain: float = 0.1, head_rows: int = 1 << 19, piece: int = PIECE, segment: int = SEGMENT) -> DataFrame:
    """Returns one row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train says which rows are learned from (by default all but those whose crc32 of the id as text is 2 modulo 7); held_out is its
    opposite. Null texts are empty: one token, the end. A null id counts as empty text. Very long texts go in pieces, which
    repeat the last LEAD words. Repeated rows each get their row and each count in training. Without training rows counts are 0 and every token
    has probability 1."""
    train = bucket_of(F.col("doc_id"), 7) != 2 if train is None else train
    numbered = documents(docs).withColumn("train", F.coalesce(train, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    with batches_of(docs.sparkSession, 512):
        table = materialise(chunks(numbered, piece, segment), "chunks", large_rows=True)
    tree = learn(table, least, least_gain)
    spark = docs.sparkSession
    word_bound, (w, c) = most_frequent(tree.words, head_rows)
    bound, (k, _, v) = most_frequent(tree.lookups, head_rows)
    tail = tree.lookups.filter(F.col("n") < bound)
    head = spark.sparkContext.broadcast((Known(w, c), Known(k, v.astype(np.float64)), bit_table(tail)))
    levels, root = tree.levels, lambda c, n=tree.n, v=tree.v: np.log10((c + 1.0) / (n + 1.0 * (v + 1)))
    parts = parts_of(table)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, states, rest = head.value
        for row, t in opened(batches):
            size = len(row["ends"])
            own = np.flatnonzero(t.own)
            h, text, at = t.h[own], t.text[own], t.at[own]
            hit, count = words.find(t.words)
            value, rare = np.zeros(len(t.words)), np.ones(len(t.words), bool)
            value[hit], rare[hit] = root(count), False
            base, rare = value[t.word[own]], rare[t.word[own]]
            score, known = base.copy(), ~rare
            keys, of, is_word = [h[rare]], [text[rare]], [np.ones(int(rare.sum()), bool)]

            def look(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """What is known of keys (0 where nothing), and which of the others may be in the table."""
                value, more = np.zeros(len(key)), np.ones(len(key), bool) if rest is None else rest.has(key)
                hit, found = states.find(key)
                value[hit], more[hit] = found, False
                return value, more

            def add_to(places: np.ndarray, value: np.ndarray, key: np.ndarray, more: np.ndarray, score=score, text=text, keys=keys, of=of, is_word=is_word) -> None:
                score[places] += value
                keys.append(key[more])
                of.append(text[places[more]])
                is_word.append(np.zeros(int(more.sum()), bool))

            alive, before = np.arange(len(h)), t.h
            for d in range(1, levels + 1):
                alive = alive[at[alive] >= d]
                key = before[own[alive] - 1] ^ U(STATE)
                value, more = look(key) if d > 1 else (x[t.word[own[alive] - 1]] for x in look(t.words ^ U(STATE)))
                state = (value != 0) | more
                alive = alive[state]
                add_to(alive, value[state], key[state], more[state])
                before = t.sequences(d + 1)
                key = before[own[alive]] ^ U(ENTRY)
                value, more = look(key)
                add_to(alive, value, key, more)
            add = lambda x, text=text, size=size: np.bincount(text, x, size)
            own_row = (row["chunk"], -1, 0, None, row["row"], row["doc_id"], row["train"], np.bincount(text, minlength=size), add(known).astype(np.int64), add(base), add(score))
            key, of, word = np.concatenate(keys), np.concatenate(of).astype(U), np.concatenate(is_word)
            order = np.argsort(key)
            key, of, word = key[order], of[order], word[order]
            cut = np.searchsorted(key_part(key, parts), np.arange(parts + 1)).tolist()
            asks = [(row["chunk"], p, b - a, planes(key[a:b]) + planes(of[a:b].astype(np.uint32)) + word[a:b].tobytes(), *[None] * 7) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(own_row, *asks, strict=True), ASKED.types, strict=True)], schema=ASKED)

    found = small_batches(table, lambda: table.mapInArrow(local, ASK), "scores")
    head.destroy()
    discard(table)
    values = tree.words.filter(F.col("n") < word_bound).select("key", F.lit(True).alias("word"), "n", F.lit(0.0).alias("v")).unionByName(tail.select("key", F.lit(False).alias("word"), F.lit(0).cast("long").alias("n"), "v"))
    values = values.withColumn("part", F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * parts, 32).cast("int"))
    answers = found.filter("part >= 0").select("chunk", "part", "size", "body").groupBy("part").cogroup(values.groupBy("part")).applyInArrow(lambda a, b: answered(a, b, root) if a.num_rows else ASKED.empty_table(), ASK)
    texts = found.filter("part = -1").unionByName(answers).groupBy("chunk").applyInArrow(summed, "row long, doc_id long, train boolean, n_tokens long, known long, base double, score double")
    out = texts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")

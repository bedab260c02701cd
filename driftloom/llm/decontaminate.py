"""Benchmark decontamination by template windows.

A text becomes a sequence of canonical tokens: words without outer punctuation, case folded over Unicode, where a number is <num>, a
unit behind a number <unit>, and a capitalised word inside a sentence <name>; the values are kept as slots. Windows of
`window` tokens are hashed on canonical tokens, so a question asked again with other numbers, names or units has the
same windows. Where a sentence begins isn't known of a text that stands behind other words, so each window is read three
ways, and each way is matched on its own: capitalised words at a sentence's begin as plain words, as <name> like all
others, and all tokens as plain words, values included. They are hash-joined with the benchmark's. Windows of one document that lie on one alignment with one
item are then put together: their slots have to map each of the item's values to one value of the document; where
they don't, only windows with the item's own values count. Where a window is mostly slots it tells too little, so the item's windows of twice the length are
looked for, which have to hold a word and another word or name. A pair is reported where enough of the item is covered.

The benchmark is looked at once. Up to `filter_bound` window hashes (8 bytes each) its hashes go to the tasks, which
then send on only windows that hit; beyond that all windows go through the shuffled join, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import as_bytes, materialise, slices

WINDOW, WIDE, LEAST, CACHE = 8, 16, 13, 200_000
EDGE = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
#: Characters of scripts written without spaces (kana, Han, Thai, Lao, Myanmar, Khmer), and their punctuation, in UTF-8.
UNSPACED = re.compile(rb"(?:\xe3[\x81-\xbf]|[\xe4-\xe9][\x80-\xbf]|\xe0[\xb8-\xbb]|\xe1(?:[\x80-\x82]|[\x9e\x9f])|\xef[\xa4-\xab])[\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")
MARKS = re.compile(rb"\xe3\x80[\x80-\x82\x88-\x91]|\xef\xbc[\x81-\x8f\x9a-\xa0]")
NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/%]*[a-z]{0,3}")

#: Number words and unit words.
NUMBER_WORDS = frozenset(b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(b"mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph".split())

PLAIN, NUM, UNIT, CAPITAL, SENTENCE, EMPTY = 0, 1, 2, 3, 4, 8  # low bits of a word's value
PLAIN_READING = 2  # the place of the reading without slots
TYPED = {NUM: 0x9E3779B97F4A7C10, UNIT: 0xC2B2AE3D27D4EB50, CAPITAL: 0x165667B19E3779F0}


def folded(word: bytes) -> tuple[str, bytes]:
    """The word without outer punctuation, composed, and its folded form; bytes that aren't UTF-8 stay as they are."""
    word = word.strip(EDGE)
    if word.isascii():  # composed already, and folding is lower-casing
        return word.decode("ascii"), word.lower()
    bare = unicodedata.normalize("NFC", word.decode("utf-8", "surrogateescape"))
    return bare, unicodedata.normalize("NFC", bare.casefold()).encode("utf-8", "surrogateescape")


class Words(dict):
    """Word as it stands -> hash of its plain form with its kind in the low bits. Emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        bare, low = folded(word)
        flags = SENTENCE if word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":") else 0
        if not bare:
            value = flags | EMPTY
        else:
            if low[0] < 58 and NUMBER.fullmatch(low) or low in NUMBER_WORDS:  # a number begins with a digit or a sign before ':'
                flags |= NUM
            elif low in UNITS:
                flags |= UNIT
            elif len(bare) > 1 and (bare[0].isupper() or bare[0].istitle()) and bare[1:] == bare[1:].lower():
                flags |= CAPITAL
            value = xxh3_64_intdigest(low) & ~15 | flags
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def canonical(text: bytes, words: Words) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Words that aren't only punctuation, and for each reading the hash of each one's canonical token and whether it is
    a slot. Readings: capitalised words are names but where a sentence begins; all are; nothing is a slot.
    A line's end counts as a sentence's. Each character of a script without spaces is a word."""
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(rb" \g<0> ", MARKS.sub(b" ", text))
    seen = text.replace(b"\n", b".\n").split()
    value = np.fromiter(map(words.__getitem__, seen), np.uint64, len(seen))
    kind, full = value & np.uint64(3), (value & np.uint64(EMPTY)) == 0
    begins = np.concatenate(([True], (value[:-1] & np.uint64(SENTENCE)) != 0)) if len(seen) else np.zeros(0, bool)
    behind = np.concatenate(([False], kind[:-1] == NUM)) if len(seen) else np.zeros(0, bool)
    plain = value & ~np.uint64(15)
    out = plain.copy()
    slot = kind == NUM
    out[slot] = TYPED[NUM]
    unit, capital = (kind == UNIT) & behind, kind == CAPITAL
    out[unit] = TYPED[UNIT]
    slot = slot | unit
    readings = [(np.where(names, np.uint64(TYPED[CAPITAL]), out), slot | names) for names in (capital & ~begins, capital)]
    readings.append((plain, np.zeros(len(seen), bool)))
    if not full.all():
        seen = [w for w, ok in zip(seen, full.tolist(), strict=True) if ok]
        readings = [(tokens[full], slots[full]) for tokens, slots in readings]
    return seen, readings


def window_hashes(tokens: np.ndarray, width: int, short: np.ndarray | None = None) -> np.ndarray:
    """A hash of each window, along the last axis; one over more than WINDOW tokens is made of those of its first and its last
    WINDOW (short, if they are known)."""
    n = max(0, tokens.shape[-1] - width + 1)
    if width > WINDOW:
        short = window_hashes(tokens, WINDOW) if short is None else short
        total = short[..., :n] * np.uint64(0xC2B2AE3D27D4EB4F) + short[..., width - WINDOW :] + np.uint64(width)
        return total ^ (total >> np.uint64(29))
    total = np.full((*tokens.shape[:-1], n), width, np.uint64)
    for k in range(width if n else 0):
        total *= np.uint64(0x9FB21C651E98DF25)
        total += tokens[..., k : k + n]
        total ^= total >> np.uint64(29)
    return total


def literal_enough(slot: np.ndarray, width: int) -> np.ndarray:
    """Windows of which at least half the tokens are words, not slots; the reading without slots has all windows."""
    total = np.concatenate(([0], np.cumsum(~slot)))
    return 2 * (total[width:] - total[:-width]) >= width


def wide_enough(tokens: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """Windows with a word and another word or name, and not mostly names: what a question that is nearly all numbers is told by, over more
    than WINDOW tokens. (Its first word is a name where all capitalised ones are.)"""
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (~slot, tokens == np.uint64(TYPED[CAPITAL]))]
    words, names = (x[width:] - x[:-width] for x in sums)
    return (words >= 1) & (words + names >= 2) & (2 * names <= width)


class Known:
    """Membership of sorted hashes, by a bit table first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.bits = np.unique(hashes), 20
        while len(self.hashes) << 4 > 1 << self.bits:
            self.bits += 1
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.hashes >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == h[at]]


KIND = "id long, pos int, width int, reading int, h long, slots array<string>, n_tokens int"
SCHEMA = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("width", pa.int32()), ("reading", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(pa.string())), ("n_tokens", pa.int32())])


def windows(rows: DataFrame, widths: list[int] | None, known: np.ndarray | None, least: int = 5) -> DataFrame:
    """Windows of (id, text). widths None: each text has windows of WINDOW tokens, or all its tokens where it has
    fewer; with slots only where these are at least `least`; and, where slots prevail in a window, of WIDE tokens (or all) too. known: only windows with these hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), Known(known) if known is not None else None
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("id").to_pylist(), as_bytes(batch, "text"), strict=True):
                seen, readings = canonical(text, words)
                own = widths if widths is not None else [min(WINDOW, len(seen))] if seen else []
                if widths is None and len(seen) > WINDOW and not all(literal_enough(slot, WINDOW).all() for _, slot in readings):
                    own = [*own, min(WIDE, len(seen))]
                n, every = len(seen), np.stack([tokens for tokens, _ in readings])  # all readings at once
                short = window_hashes(every, WINDOW) if max(own, default=0) >= WINDOW else None
                for width in own:
                    if width > n:
                        continue
                    h = (short if width == WINDOW else window_hashes(every, width, short)).ravel()
                    at = table.find(h) if table is not None else np.arange(len(h))
                    if not len(at):
                        continue
                    reading, place = np.divmod(at, n - width + 1)
                    if width < least:
                        fit = reading == PLAIN_READING
                    else:
                        fit = np.zeros(len(at), bool)
                        for r in np.unique(reading).tolist():
                            tokens, slot = readings[r]
                            own_fit = literal_enough(slot, width) if width <= WINDOW else wide_enough(tokens, slot, width)
                            fit[reading == r] = own_fit[place[reading == r]]
                    for r, p, x in zip(reading[fit].tolist(), place[fit].tolist(), h[at[fit]].astype(np.int64).tolist(), strict=True):
                        slots = [folded(seen[p + i])[1].decode("utf-8", "replace") for i in np.flatnonzero(readings[r][1][p : p + width]).tolist()]
                        out.append((doc, p, width, r, x, slots, n))
                        if len(out) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                            out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return rows.mapInArrow(cut, KIND)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, filter_bound: int = 1 << 21) -> DataFrame:
    """Returns one row for each document and benchmark item that it holds: doc_id, item_id, n_windows, covered, item_tokens.

    covered is the number of the item's tokens that consistent windows cover; a pair is returned from
    min(least, item_tokens) on. Items of fewer than five tokens, and items of eight or fewer that are mostly slots, match with their
    own values alone; where slots prevail in longer ones, windows of sixteen tokens (or the whole item) decide. Items without a token match nothing. Null
    texts and ids match nothing; rows that repeat an id are one document; repeated items are reported under their
    ids, and where windows lie on several alignments with one item, what any of them covers counts. Very long texts are read
    whole. An empty table on either side gives no rows."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("id IS NOT NULL").distinct()
    items = materialise(windows(bench, None, None), "benchmark-windows")
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most WINDOW values
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, covered long, item_tokens long")
    n = items.count()
    known = items.select("h").distinct().toArrow().column("h").to_numpy().view(np.uint64) if n <= filter_bound else None
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("id IS NOT NULL")
    hits = windows(rows, widths, known).drop("n_tokens").withColumnsRenamed({"id": "doc_id", "pos": "doc_pos", "slots": "doc_slots"})
    side = items.withColumnsRenamed({"id": "item_id", "pos": "item_pos", "slots": "item_slots", "n_tokens": "item_tokens"})
    pairs = hits.join(F.broadcast(side) if n <= filter_bound // 64 else side, ["h", "width", "reading"]).select("doc_id", "item_id", "reading", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "item_pos", "width", "item_tokens", F.arrays_zip(F.col("item_slots").alias("a"), F.col("doc_slots").alias("b")).alias("slots"))
    same = F.forall("slots", lambda s: s["a"].eqNullSafe(s["b"]))
    place = F.struct("item_pos", "width")
    lined = pairs.groupBy("doc_id", "item_id", "item_tokens", "shift", "reading").agg(F.collect_set(place).alias("every"), F.collect_set(F.when(same, place)).alias("literal"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    sure = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))
    tokens = lambda c: F.flatten(F.transform(c, lambda p: F.sequence(p["item_pos"], p["item_pos"] + p["width"] - 1)))
    kept = lined.withColumn("places", F.when(sure, F.col("every")).otherwise(F.col("literal"))).filter(F.size("places") > 0)
    each = kept.groupBy("doc_id", "item_id", "item_tokens", "shift").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    whole = each.groupBy("doc_id", "item_id", "item_tokens").agg(F.sum(F.size("places")).cast("long").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list(tokens("places"))))).cast("long").alias("covered"))
    return whole.filter(F.col("covered") >= F.least(F.lit(least), F.col("item_tokens"))).select("doc_id", "item_id", "n_windows", "covered", F.col("item_tokens").cast("long").alias("item_tokens"))

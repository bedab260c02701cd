"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the whole text alone (one pass over the texts, a narrow table after it). The model is an intercept,
a lookup table over quantile bins for each feature, and one over coarse bin pairs for the strongest pairs. Tables are
learned by cyclic boosting: features take turns, each turn fits a tree of at most three leaves to the gradient in that
feature's bins and adds a small part of it to the table; then pairs do the same on the residual. Scoring is bin lookups
and additions over whole batches. Fitting takes a bounded sample of labelled rows (`sample_rows`), chosen by a
hash of the id, so the driver's part doesn't grow.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bucket_of, documents, materialise, share_by_hash, slices

NAMES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops", "lines", "distinct", "top_word", "repeated_lines", "non_ascii", "odd_ends", "odd_lines", "worst_lines", "packed"]


def _classes() -> np.ndarray:
    kinds = np.full(256, 5, np.uint8)  # symbols
    for kind, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n")):
        kinds[list(chars)] = kind
    kinds[list(b".,;:?'\"-()")] = 6
    kinds[ord("!")], kinds[ord("|")] = 7, 8
    kinds[0x80:] = 9
    return kinds


CLASS = _classes()
LETTER_END = frozenset(range(128, 256)) | frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?'\"-()")


def features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    kinds = CLASS[np.frombuffer(text, np.uint8)]
    low, up, digit, _, newline, symbol, stop, bang, bar, high = np.bincount(kinds, minlength=10).tolist()
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    # a line is odd where capitals or symbols are far more than prose has
    odd, ends = 0, [0]
    if newline:
        cut = np.flatnonzero(kinds == 4)
        sums = np.concatenate(([0], np.cumsum((kinds == 1) | (kinds == 5) | (kinds == 7) | (kinds == 8))))
        starts, stops = np.concatenate(([0], cut + 1)), np.concatenate((cut, [n]))
        size = stops - starts
        share = (sums[stops] - sums[starts]) / np.maximum(1, size)
        odd, ends = float(size[share > 0.15].sum()), share[size >= 20]
        worst = float(ends.max()) if len(ends) else float(share.max())
    else:
        worst = (up + symbol + bang + bar) / n
        odd = n if worst > 0.15 else 0
    odd_ends = sum(c for x, c in counts.items() if x[-1] not in LETTER_END)
    # enough of the text's whole to see that it repeats itself; level 1 is the fastest
    return [
        np.log1p(n), np.log1p(len(words)), sum(len(x) * c for x, c in counts.items()) / w, up / max(1, up + low), digit / n, symbol / w, bang / w, bar / w, stop / w, newline / w,
        len(counts) / w, max(counts.values(), default=0) / w, 1 - len(set(lines)) / max(1, len(lines)), high / n, odd_ends / w, odd / n, worst, len(zlib.compress(text, 1)) / n,
    ]


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and x (one array of the features) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], schema=schema)

    return documents(docs).mapInArrow(rows, "doc_id long, x array<float>")


@dataclass
class Additive:
    """Intercept, bin edges and table of each feature, and (i, j, edges, edges, table) of each pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of a tree that splits ordered bins into at most `leaves` runs, best gain first."""
    runs, out = [(0, len(g))], np.zeros(len(g))
    sg, sh = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + ridge)
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for r, (a, b) in enumerate(runs):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], r, int(cut[k]))
        if best[1] is None:
            break
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
    for a, b in runs:
        out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8) -> Additive:
    """Cyclic boosting on logistic loss. One class alone, or no rows, gives a constant."""
    n, k = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    model = Additive(float(np.log(p / (1 - p))), [np.zeros(0)] * k, [np.zeros(1)] * k)
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [quantile_edges(x[:, f], bins) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    raw = np.full(n, model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f in range(k):
            if len(model.edges[f]):
                g, h = gradient()
                m = len(model.tables[f])
                step = rate * shallow_tree(np.bincount(at[f], g, m), np.bincount(at[f], h, m))
                model.tables[f] += step
                raw += step[at[f]]
    coarse = [quantile_edges(x[:, f], pair_bins) for f in range(k)]
    cell = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    g, h = gradient()
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            m, w = len(coarse[i]) + 1, len(coarse[j]) + 1
            c = cell[i] * w + cell[j]
            sg, sh = np.bincount(c, g, m * w), np.bincount(c, h, m * w)
            gains.append((float((sg**2 / (sh + 1)).sum()), i, j))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 2):
        for i, j, grid in chosen:
            g, h = gradient()
            m, w = grid.shape
            c = cell[i] * w + cell[j]
            sg, sh = np.bincount(c, g, m * w).reshape(m, w), np.bincount(c, h, m * w).reshape(m, w)
            # a tree of depth two: rows split once, then each part's columns
            rows = shallow_tree(sg.sum(1), sh.sum(1), 2)
            step = np.zeros((m, w))
            for v in np.unique(rows):
                part = rows == v
                step[part] = shallow_tree(sg[part].sum(0), sh[part].sum(0), 2)
            grid += rate * step
            raw += rate * step.ravel()[c]
    model.pairs = [(i, j, coarse[i], coarse[j], grid) for i, j, grid in chosen]
    return model


def train(feats: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000, folds: int = 5, of: int | None = None) -> Additive:
    """Fits on about sample_rows labelled rows at most, outside the held-out fold, picked by a hash of the id. of: how many
    labelled rows there are, where feats has the sample's alone."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL").filter(bucket_of(F.col("doc_id"), folds) != 0)
    labelled = feats.filter(F.col("doc_id").isNotNull()).join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = sorted(share_by_hash(labelled, sample_rows, "doc_id", "y", of=of).collect(), key=lambda r: (r.doc_id, r.y))
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r.y for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 20_000, folds: int = 5) -> DataFrame:
    """Returns one row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null texts are empty, and empty texts are scored as such. Labels that are null or belong to no document play no
    part; without labels of both classes every score is the smoothed share of label 1. Repeated rows of a document
    each get their row; in fitting a document and label count once. held_out: crc32 of the id as text modulo `folds` is 0 (a null
    id counts as empty text)."""
    feats = materialise(featurise(docs), "quality")
    model = train(feats, labels, "quality", sample_rows, folds)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], schema=schema)

    out = feats.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 20_000, folds: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that score_quality would predict 1. No row moves: once the model is
    fitted on the sample's features, each task scores and filters its own rows.

    Nulls, repeated rows and missing labels are as in score_quality; rows that repeat are kept or go together. An empty table
    gives none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL").filter(bucket_of(F.col("doc_id"), folds) != 0)
    rows = documents(docs).filter("doc_id IS NOT NULL")
    there = materialise(rows.select("doc_id").join(known, "doc_id").distinct(), "labelled")
    ids = share_by_hash(there, sample_rows, "doc_id", "y").select("doc_id").distinct()  # about sample_rows at most
    model = train(featurise(rows.join(F.broadcast(ids), "doc_id", "left_semi")), there, "y", sample_rows, folds, there.count())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in as_bytes(batch, "text")], np.float32).astype(np.float64)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(passed, docs.schema)

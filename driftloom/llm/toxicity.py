"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as its hashed word embedding and the mean of its hashed character n-gram embeddings (3 and 5 bytes,
with marks at its ends), beside two numbers learned from the sample: the word's log odds and the highest log odds of its
n-grams. Windows of `T` words overlap; each is read in both directions, states are pooled by learned attention.
Every window of every text is scored, and a document's score combines its worst three windows and how many are suspect
by a logistic regression that is fitted on a part of the sample that the network hasn't seen.

A document's label says only that some window is toxic, so training repeats: choose each document's most toxic window
by the present model (by the log odds at first), then take Adam steps on those. It takes a bounded sample: at most
`sample_rows` toxic and three times as many other labelled rows. Texts up to `sample_bytes` are sent whole. Longer ones are cut into windows in
the tasks, and those of highest log odds (counted over the whole sample, in the tasks too) are sent up to that size: the windows that
training chooses from, wherever in the text they stand. The model has a fixed size.

Word vectors times input weights are computed once for each distinct word of a task and looked up after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bucket_of, documents, materialise, share_by_hash, slices

T, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 32, 24, 8, 6, 8
WORD_SPACE, CHAR_SPACE, CACHE = 1 << 15, 1 << 17, 150_000
INPUT = WORD_DIM + CHAR_DIM + 2
BLOCK, PART = 4096, 20_000
SPACES = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))
f32 = np.float32


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes beyond ASCII."""
    return text.lower().translate(SPACES).split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; character n-gram buckets of all words in a row; where each word's n-grams begin."""
    buffer = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(size)
    starts = ends - size
    n = len(buffer) - 4
    three = (buffer[:n] * np.uint32(0x9E3779B1) ^ buffer[1 : n + 1] * np.uint32(0x85EBCA77) ^ buffer[2 : n + 2] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    five = (three ^ buffer[3 : n + 3] * np.uint32(0x165667B1) ^ buffer[4 : n + 4] * np.uint32(0xD3A2646C)) * np.uint32(0x9E3779B1)
    bucket3, bucket5 = three >> np.uint32(15), five >> np.uint32(15)
    # a position takes part while its n-gram lies inside its word; every word has its first position
    owner = np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(n)
    keep3, keep5 = (left >= 3) | (np.arange(n) == starts[owner]), left >= 5
    grams = np.concatenate((bucket3[keep3], bucket5[keep5])).astype(np.int64)
    of = np.concatenate((owner[keep3], owner[keep5]))
    order = np.argsort(of, kind="stable")
    grams, of = grams[order], of[order]
    begin = np.searchsorted(of, np.arange(len(words)))
    # the word's own bucket from all its bytes
    with np.errstate(over="ignore"):
        weight = buffer[:n].astype(np.uint64) * (np.uint64(0x9E3779B97F4A7C15) * ((np.arange(n) - starts[owner]).astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        whole = np.add.reduceat(weight, starts) if len(words) else np.zeros(0, np.uint64)
        whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (whole >> np.uint64(49)).astype(np.int64), grams, begin


def all_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_features() of many words, a part at a time: what it holds meanwhile is many times its result."""
    done = [word_features(words[at : at + PART]) for at in range(0, max(1, len(words)), PART)]
    before = np.cumsum([0, *(len(g) for _, g, _ in done)])
    return np.concatenate([w for w, _, _ in done]), np.concatenate([g.astype(np.int32) for _, g, _ in done]), np.concatenate([b + n for (_, _, b), n in zip(done, before[:-1], strict=True)])


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last may be shorter."""
    return list(range(0, max(1, n - (T - STRIDE)), STRIDE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(f32)
        self.p = {"word": (r.standard_normal((WORD_SPACE, WORD_DIM)) * 0.05).astype(f32), "char": (r.standard_normal((CHAR_SPACE, CHAR_DIM)) * 0.05).astype(f32)}
        for d in "fb":
            self.p |= {f"W{d}": small(INPUT, 3 * HIDDEN), f"U{d}": small(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, f32)}
        self.p |= {"A": small(2 * HIDDEN, HIDDEN), "a": small(HIDDEN, 1), "o": small(2 * HIDDEN, 1), "bias": np.zeros(1, f32)}
        self.word_odds, self.char_odds = np.zeros(WORD_SPACE, f32), np.zeros(CHAR_SPACE, f32)
        self.base = 0.5
        self.combine = np.array([1.0, 0, 0, 0, 0, 0])  # see Reader.windows

    def vectors(self, features: tuple) -> np.ndarray:
        word, grams, begin = features
        count = np.diff(np.append(begin, len(grams)))[:, None].astype(f32)
        chars = np.add.reduceat(self.p["char"][grams], begin, axis=0) / count
        odds = np.maximum.reduceat(self.char_odds[grams], begin)
        return np.concatenate((self.p["word"][word], chars, self.word_odds[word][:, None], odds[:, None]), axis=1).astype(f32)

    def all_vectors(self, features: tuple) -> np.ndarray:
        """vectors() of many words, a part at a time: the n-grams' vectors are much larger than the words'."""
        word, grams, begin = features
        ends = np.append(begin, len(grams))
        out = np.empty((len(word), INPUT), f32)
        for at in range(0, len(word), PART):
            to = min(len(word), at + PART)
            out[at:to] = self.vectors((word[at:to], grams[ends[at] : ends[to]], begin[at:to] - ends[at]))
        return out

    def run(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits from projected inputs (windows, T, 3 HIDDEN). keep: also what backward() needs."""
        n, states, trace = len(mask), np.empty((len(mask), T, 2 * HIDDEN), f32), {"f": [], "b": []}
        for d, x, order in (("f", xf, range(T)), ("b", xb, range(T - 1, -1, -1))):
            h, u = np.zeros((n, HIDDEN), f32), self.p[f"U{d}"]
            off = 0 if d == "f" else HIDDEN
            for t in order:
                g = h @ u
                rz = sigmoid(x[:, t, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(x[:, t, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = z * h + (1 - z) * c
                new = np.where(mask[:, t, None], new, h)
                if keep:
                    trace[d].append((t, h, r, z, c, g[:, 2 * HIDDEN :]))
                h = new
                states[:, t, off : off + HIDDEN] = h
        inner = np.tanh(states @ self.p["A"])
        e = np.where(mask, (inner @ self.p["a"])[:, :, 0], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", alpha, states)
        logit = (pooled @ self.p["o"])[:, 0] + self.p["bias"][0]
        return (logit, trace, states, inner, alpha, pooled) if keep else logit

    def backward(self, y: np.ndarray, weight: np.ndarray, x: np.ndarray, mask: np.ndarray):
        """Gradients of the weighted logistic loss; also for the input vectors x (windows, T, INPUT)."""
        p = self.p
        xf, xb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        logit, trace, states, inner, alpha, pooled = self.run(xf, xb, mask, keep=True)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(f32)
        grad = {"o": pooled.T @ d[:, None], "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["o"][:, 0]
        d_states = alpha[:, :, None] * d_pooled[:, None, :]
        d_alpha = np.einsum("nh,nth->nt", d_pooled, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
        grad["a"] = np.einsum("nt,ntk->k", d_e, inner)[:, None]
        d_inner = d_e[:, :, None] * p["a"][:, 0] * (1 - inner**2)
        grad["A"] = np.einsum("nth,ntk->hk", states, d_inner)
        d_states = d_states + d_inner @ p["A"].T
        dx = np.zeros_like(x)
        for k, off in (("f", 0), ("b", HIDDEN)):
            u, back, gu, d_in = p[f"U{k}"], np.zeros((len(y), HIDDEN), f32), np.zeros_like(p[f"U{k}"]), np.zeros((len(y), T, 3 * HIDDEN), f32)
            for t, h, r, z, c, gc in reversed(trace[k]):
                dh = back + d_states[:, t, off : off + HIDDEN]
                m = mask[:, t, None]
                live = np.where(m, dh, 0)
                dc = live * (1 - z) * (1 - c**2)
                dz = live * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate((dr, dz, dc * r), axis=1)
                d_in[:, t] = np.concatenate((dr, dz, dc), axis=1)
                gu += h.T @ dg
                back = np.where(m, live * z, dh) + dg @ u.T
            grad[f"U{k}"], grad[f"W{k}"], grad[f"c{k}"] = gu, np.einsum("nti,ntk->ik", x, d_in), d_in.sum((0, 1))
            dx += d_in @ p[f"W{k}"].T
        return grad, dx, logit


class Reader(dict):
    """Word -> number of its row of projected inputs, made in batches and emptied between batches when full."""

    def __init__(self, net: Net):
        super().__init__()
        self.net, self.pending = net, []
        self.rows = [np.zeros((CACHE * 2, 3 * HIDDEN), f32) for _ in "fb"]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1  # 0 is padding
        self.pending.append(word)
        return number

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > CACHE:
            self.clear()
        out = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        if self.pending:
            first, p = len(self) - len(self.pending) + 1, self.net.p
            while len(self) + 1 > len(self.rows[0]):
                self.rows = [np.concatenate((m, np.zeros_like(m))) for m in self.rows]
            for at in range(0, len(self.pending), 20_000):
                part = self.pending[at : at + 20_000]
                v = self.net.vectors(word_features(part))
                for m, d in zip(self.rows, "fb", strict=True):
                    m[first + at : first + at + len(part)] = v @ p[f"W{d}"] + p[f"c{d}"]
            self.pending = []
        return out

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text: its three highest window logits (a missing one is the lowest there is), the logs of the
        sum of all windows' chances and of one more than the number of suspect ones, 1.
        Also which texts have no words."""
        docs = self.numbers(texts)
        starts = [(d, s) for d, ids in enumerate(docs) for s in window_starts(len(ids))]
        of = np.array([d for d, _ in starts], np.int64)
        padded = [np.concatenate((ids, np.zeros(T, np.int64))) for ids in docs]
        logit = np.zeros(len(starts))
        for at in range(0, len(starts), BLOCK):
            ids = np.stack([padded[d][s : s + T] for d, s in starts[at : at + BLOCK]])
            logit[at : at + BLOCK] = self.net.run(self.rows[0][ids], self.rows[1][ids], ids > 0)
        out = np.ones((len(docs), 6))
        n = np.bincount(of, minlength=len(docs))
        order = np.lexsort((-logit, of))
        first = np.cumsum(n) - n
        for k in range(3):
            out[:, k] = logit[order[first + np.minimum(k, n - 1)]]
        chance = sigmoid(logit)
        out[:, 3], out[:, 4] = np.log(1e-3 + np.bincount(of, chance, len(docs))), np.log1p(np.bincount(of, chance > 0.2, len(docs)))
        return out, np.array([len(d) == 0 for d in docs], bool)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, empty = self.windows(texts)
        return np.where(empty, 0.0 if self.net.base < 0.5 else self.net.base, sigmoid(x @ self.net.combine))


def fit_combination(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the worst window's logit alone."""
    prior = np.array([1.0, 0, 0, 0, 0, 0])
    w, pull = prior.copy(), ridge * np.diag([1.0, 1, 1, 1, 1, 0.01])
    for _ in range(25):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + pull @ (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull + 1e-6 * np.eye(6)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
    return w


def learn_odds(net: Net, features: tuple, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Smoothed log odds of word and n-gram buckets, each counted once a document."""
    word, grams, begin = features
    stops = np.append(begin[1:], len(grams))
    for space, name, of in ((WORD_SPACE, "word_odds", lambda w: word[w]), (CHAR_SPACE, "char_odds", lambda w: np.concatenate([grams[begin[i] : stops[i]] for i in w] or [np.zeros(0, np.int64)]))):
        n = np.zeros((2, space))
        for ids, label in zip(docs, y, strict=True):
            n[int(label)][np.unique(of(np.unique(ids)))] += 1
        total = np.array([(y == 0).sum(), (y == 1).sum()])
        odds = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
        setattr(net, name, (np.clip(odds, -2, 5) * (n.sum(0) / (n.sum(0) + 5)) / 2).astype(f32))


def fit_network(texts: list[bytes], y: np.ndarray, spare: int = 5) -> Net:
    """The network from all but every spare-th text of either class, and the combination of windows from those."""
    place = np.zeros(len(y), np.int64)
    for label in (0, 1):
        place[y == label] = np.arange((y == label).sum())
    seen = place % spare != 0
    if min(((y == label) & ~seen).sum() for label in (0, 1)) < 8:
        return train(texts, y)
    net = train([t for t, s in zip(texts, seen, strict=True) if s], y[seen])
    net.base = float((y.sum() + 0.5) / (len(y) + 1))
    reader, rest = Reader(net), [t for t, s in zip(texts, seen, strict=True) if not s]
    x = np.concatenate([reader.windows(rest[k : k + 128])[0] for k in range(0, len(rest), 128)])
    net.combine = fit_combination(x, y[~seen])
    return net


def train(texts: list[bytes], y: np.ndarray, epochs: int = 9, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Net:
    """One class alone, or no texts, gives a network that scores every text by the smoothed share of label 1."""
    net = Net(seed)
    net.base = float((y.sum() + 0.5) / (len(y) + 1))
    net.p["bias"][:] = np.log(net.base / (1 - net.base))
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        return net
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    feats = all_features(list(number))
    learn_odds(net, feats, docs, y)
    word, grams, begin = feats
    stops = np.append(begin[1:], len(grams))
    pad = len(number)
    starts = [(d, s) for d, ids in enumerate(docs) if len(ids) for s in window_starts(len(ids))]
    ids = np.full((len(starts), T), pad, np.int64)
    for i, (d, s) in enumerate(starts):
        part = docs[d][s : s + T]
        ids[i, : len(part)] = part
    of = np.array([d for d, _ in starts])
    odds = np.append(net.word_odds[word] + np.maximum.reduceat(net.char_odds[grams], begin), -9)
    judged = np.sort(odds[ids], axis=1)[:, -2:].sum(1)
    rng, state, steps = np.random.default_rng(seed), {}, 0

    def update(name: str, g: np.ndarray) -> None:
        m, v = state.setdefault(name, [np.zeros_like(net.p[name]), np.zeros_like(net.p[name])])
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        net.p[name] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(f32)

    squares = {"word": np.full(WORD_SPACE, 1e-6, f32), "char": np.full(CHAR_SPACE, 1e-6, f32)}
    for epoch in range(epochs):
        order = np.lexsort((rng.random(len(of)), -judged, of))
        first = np.append(True, of[order][1:] != of[order][:-1])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        chosen = order[(rank == 0) | ((rank <= 2) & (y[of[order]] == 0))]
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            steps += 1
            part = ids[chosen[at : at + batch]]
            target = y[of[chosen[at : at + batch]]]
            own, inverse = np.unique(part, return_inverse=True)
            inverse = inverse.reshape(part.shape)
            real = own[own < pad]
            # the distinct words of this batch, with their n-grams again in a row
            lengths = stops[real] - begin[real]
            local = np.cumsum(lengths) - lengths
            g = grams[np.repeat(begin[real], lengths) + np.arange(lengths.sum()) - np.repeat(local, lengths)]
            v = net.vectors((word[real], g, local))
            v = np.concatenate((v, np.zeros((len(own) - len(real), INPUT), f32)))
            grad, dx, _ = net.backward(target, np.ones(len(target), f32), v[inverse], part < pad)
            for name, value in grad.items():
                update(name, value.astype(f32))
            dv = np.zeros_like(v)
            np.add.at(dv, inverse.ravel(), dx.reshape(-1, INPUT))
            dv = dv[: len(real)]
            for name, index, value in (("word", word[real], dv[:, :WORD_DIM]), ("char", g, np.repeat(dv[:, WORD_DIM : WORD_DIM + CHAR_DIM] / lengths[:, None], lengths, axis=0))):
                total = np.zeros_like(net.p[name])
                np.add.at(total, index, value)
                hit = np.unique(index)
                squares[name][hit] += (total[hit] ** 2).mean(1)
                net.p[name][hit] -= (0.05 * total[hit] / np.sqrt(squares[name][hit])[:, None]).astype(f32)
        table = np.concatenate((net.all_vectors(feats), np.zeros((1, INPUT), f32)))
        pf, pb = table @ net.p["Wf"] + net.p["cf"], table @ net.p["Wb"] + net.p["cb"]
        judged = np.concatenate([net.run(pf[ids[i : i + BLOCK]], pb[ids[i : i + BLOCK]], ids[i : i + BLOCK] < pad) for i in range(0, len(ids), BLOCK)])
    return net


def likeliest(text: bytes, odds: np.ndarray, most: int) -> bytes:
    """The windows of a text whose two likeliest words have the highest log odds, in their order, up to `most` bytes."""
    words = words_of(text)
    if not words:
        return b""
    value = odds[word_features(words)[0]]
    starts = window_starts(len(words))
    best = [np.sort(value[s : s + T])[-2:].sum() for s in starts]
    keep, size = np.zeros(len(words), bool), 0
    for k in sorted(range(len(starts)), key=lambda k: (-best[k], k)):
        fresh = [i for i in range(starts[k], min(len(words), starts[k] + T)) if not keep[i]]
        size += sum(len(words[i]) + 1 for i in fresh)
        if size > most and keep.any():
            break
        keep[fresh] = True
    return b" ".join(w for w, k in zip(words, keep, strict=True) if k)


def sent_windows(sample: DataFrame, most: int) -> DataFrame:
    """doc_id, y, text (binary) of the sample: whole texts up to `most` bytes, of longer ones the likeliest windows."""
    long_ones = F.octet_length("text") > most
    whole = sample.filter(~long_ones).select("doc_id", "y", F.encode("text", "utf-8").alias("text"))
    if not sample.filter(long_ones).head(1):
        return whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WORD_SPACE), np.int64)
        for batch in slices(batches, 128, 1 << 20):
            for y, text in zip(batch.column("y").to_pylist(), as_bytes(batch, "text"), strict=True):
                if words := list(set(words_of(text))):
                    total[y][np.unique(word_features(words)[0])] += 1
        y, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[y, bucket], pa.int64())})

    n = np.zeros((2, WORD_SPACE))
    for r in sample.select("y", "text").mapInArrow(count, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).collect():
        n[r["y"], r["bucket"]] = r["n"]
    total = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    odds = (np.log((n[1] + 0.5) / (total.get(1, 0) + 1)) - np.log((n[0] + 0.5) / (total.get(0, 0) + 1))).astype(f32)
    held = sample.sparkSession.sparkContext.broadcast(odds)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([likeliest(t, held.value, most) for t in as_bytes(batch, "text")], pa.binary())], names=["doc_id", "y", "text"])

    return whole.unionByName(sample.filter(long_ones).select("doc_id", "y", "text").mapInArrow(choose, "doc_id long, y int, text binary"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = 1500, sample_bytes: int = 65_536, folds: int = 5) -> DataFrame:
    """Returns one row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null texts are empty; texts without words score 0 (0.5 or more only if most labelled rows are toxic). Null labels
    and labels of unknown documents play no part; without labels of both classes every score is the smoothed share of
    label 1. Very long texts are scored whole. Repeated rows each get their row. held_out: crc32 of the id as text modulo `folds` is 0."""
    spark = docs.sparkSession
    rows = documents(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL").filter(bucket_of(F.col("doc_id"), folds) != 0)
    # ids first, so that only the sample's texts move
    fits = rows.select("doc_id").filter("doc_id IS NOT NULL").join(known, "doc_id").distinct()
    fits = materialise(fits, "labelled")
    picked = [r for y in (0, 1) for r in share_by_hash(fits.filter(F.col("y") == y), sample_rows * (1 if y else 3), "doc_id").collect()]
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, y int"))  # about 4 * sample_rows ids at most
    # a document whose rows repeat is one row of the sample
    sample = materialise(rows.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "toxic-sample")
    sample = sent_windows(sample, sample_bytes).collect()
    sample.sort(key=lambda r: (r.doc_id, r.text, r.y))
    texts, y = [bytes(r.text) for r in sample], np.array([r.y for r in sample], f32)
    del sample, picked
    net = spark.sparkContext.broadcast(fit_network(texts, y))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net.value)
        for batch in slices(batches, 128, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(reader.scores(as_bytes(batch, "text")), pa.float64())], schema=schema)

    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

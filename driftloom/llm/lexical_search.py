"""Ranked lexical search over an index whose documents recursive graph bisection has put in order.

1. parse     one pass over the texts: each document's length and its counts of the terms that the items ask for. Document frequencies are
             added up in the tasks, then over them.
2. order     documents and terms are a graph; bisection splits the documents into halves by swapping pairs while that makes the gaps in the terms'
             posting lists cheaper, again and again. The upper splits are fitted on a sample of documents (`sample`, a fixed
             number); a document goes down them by what each side would pay for its terms. Below, each block of about `block`
             documents is bisected on its own, down to clusters of `leaf` documents or fewer. A shard of any size is dealt out over as many blocks as it needs.
3. index     a row for each cluster: its documents, their postings by term, and the most that a term adds to a score in it.
4. search    an item's bound for a cluster is the sum of what its terms add at most. First the clusters of highest bound are visited, which
             gives each item a threshold (its 20th score); then all clusters are, where the bound isn't below the
             threshold, which rises on the way. So what is left out can't hold a document that belongs to the answer, ties included.
             Positions are mapped back to doc_id, which decides between equal scores.

Items go to the tasks, in turns of at most `turn` items: a stated query set against all rows. Tables: parsed documents (a row each, 8 bytes a posting), index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, documents, materialise, share_by_hash, slices

#: What parts terms: all ASCII but digits and letters; A-Z are lower-cased.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WEIGHTS = 1 << 23  # numbers in the fitted splits, at most


def counted(text: bytes, known: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms, and the known ones' numbers and counts, by number."""
    words = text.translate(TERMS).split()
    got = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
    return len(words), np.array([t for t, _ in got], np.int32), np.array([c for _, c in got], np.int32)


PARSED = "doc_id long, n long, size int, terms binary, tfs binary"


def parsed(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [counted(t, sent.value) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([len(t) for _, t, _ in got], pa.int32()), pa.array([t.tobytes() for _, t, _ in got], pa.binary()), pa.array([c.tobytes() for _, _, c in got], pa.binary())], names=["doc_id", "n", "size", "terms", "tfs"])

    return documents(docs).mapInArrow(run, PARSED)


def frequencies(table: DataFrame, v: int) -> np.ndarray:
    """Documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch, "terms"), minlength=v)
        yield pa.RecordBatch.from_pydict({"t": pa.array(np.flatnonzero(total), pa.int32()), "df": pa.array(total[total > 0], pa.int64())})

    out = np.zeros(v, np.int64)
    for r in table.select("terms").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r["t"]] = r["df"]
    return out


def flat(batch: pa.RecordBatch | pa.Table, name: str, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)


def price(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What a posting list of `count` of `of` documents costs: about the logarithm of its gaps."""
    return count * np.log2(of / (count + 1))


def bisected(doc: np.ndarray, terms: np.ndarray, n: int, depth: int, rounds: int = 8, learn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaf (0 to 2^depth - 1) of each of n documents; leaves of equal sizes or nearly. doc, terms: postings by document.
    With learn (the number of terms) also weights and limit of each split: a document whose terms' weights add up to more than the limit goes right."""
    leaf, weights, limits = np.zeros(n, np.int64), np.zeros((max(1, 2**depth - 1), learn), np.float32), np.zeros(max(1, 2**depth - 1))
    v = int(terms.max(initial=0)) + 1
    for level in range(depth):
        order = np.argsort(leaf, kind="stable")
        size = np.bincount(leaf, minlength=2**level)
        begin = np.cumsum(size) - size
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - begin[leaf[order]]
        side = rank >= (size[leaf] + 1) // 2
        keys, slot = np.unique(leaf[doc] * v + terms, return_inverse=True)
        node = keys // v
        total = np.bincount(slot, minlength=len(keys))
        for turn in range(rounds + 1):
            right = np.bincount(slot, side[doc], len(keys))
            left = total - right
            n_right = np.bincount(leaf, side, 2**level)
            n_left = size - n_right
            nl, nr = np.maximum(n_left, 1)[node], np.maximum(n_right, 1)[node]
            if turn == rounds:
                break
            now = price(left, nl) + price(right, nr)
            to_right = now - price(np.maximum(left - 1, 0), nl) - price(right + 1, nr)
            to_left = now - price(left + 1, nl) - price(np.maximum(right - 1, 0), nr)
            gain = np.bincount(doc, np.where(side[doc], to_left[slot], to_right[slot]), n)
            order = np.lexsort((-gain, side, leaf))
            pairs = np.minimum(n_left, n_right).astype(np.int64)
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            a = order[np.repeat(begin, pairs) + k]
            b = order[np.repeat(begin + n_left.astype(np.int64), pairs) + k]
            go = gain[a] + gain[b] > 1e-9
            if not go.any():
                break
            side[a[go]], side[b[go]] = True, False
        if learn:
            add = (price(left + 1, nl) - price(left, nl)) - (price(right + 1, nr) - price(right, nr))
            value = np.bincount(doc, add[slot], n)
            for i in range(2**level):
                at = 2**level - 1 + i
                own = node == i
                weights[at, keys[own] % v] = add[own]
                here = leaf == i
                limits[at] = (np.median(value[here & side]) + np.median(value[here & ~side])) / 2 if (here & side).any() and (here & ~side).any() else 0
        leaf = 2 * leaf + side
    return leaf, weights, limits


def routed(doc: np.ndarray, terms: np.ndarray, n: int, depth: int, weights: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Leaf of each document, down fitted splits."""
    at = np.zeros(n, np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + (np.bincount(doc, weights[at[doc], terms], n) > limits[at])
    return at - (2**depth - 1)


INDEX = "cluster string, docs binary, terms binary, ends binary, slots binary, impacts binary, tops binary"


def clusters(name: str, group: pa.Table, leaf: int, n_docs: int, length: int) -> list[dict]:
    """Index rows of a block of documents."""
    n = group.num_rows
    sizes = group.column("size").to_numpy()
    doc, terms, tfs = np.repeat(np.arange(n), sizes), flat(group, "terms"), flat(group, "tfs").astype(np.int64)
    m = np.array([75 + 25 * x * n_docs // length for x in group.column("n").to_pylist()], np.int64)
    impact = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[doc])
    ids = group.column("doc_id").to_numpy()
    where, _, _ = bisected(doc, terms, n, max(0, math.ceil(math.log2(n / leaf))))
    out, order = [], np.lexsort((doc, terms, where[doc]))
    cut = np.searchsorted(where[doc][order], np.arange(where.max() + 2))
    for c in range(where.max() + 1):
        own = np.flatnonzero(where == c)
        rows = order[cut[c] : cut[c + 1]]
        if len(rows):
            kinds, first = np.unique(terms[rows], return_index=True)
            ends = np.append(first, len(rows))
            tops = np.maximum.reduceat(impact[rows], first)
            slots = np.searchsorted(own, doc[rows])
            out.append({"cluster": f"{name}.{c}", "docs": ids[own].tobytes(), "terms": kinds.tobytes(), "ends": ends.astype(np.int32).tobytes(), "slots": slots.astype(np.int32).tobytes(), "impacts": impact[rows].tobytes(), "tops": tops.tobytes()})
    return out


INDEX_SCHEMA = pa.schema([("cluster", pa.string()), *((c, pa.binary()) for c in ("docs", "terms", "ends", "slots", "impacts", "tops"))])


def build_index(table: DataFrame, v: int, n_docs: int, length: int, block: int = 8192, leaf: int = 256, sample: int = 16_384, most_depth: int = 6) -> DataFrame:
    """A row of INDEX for each cluster of the documents that hold any term."""
    rows = table.filter("size > 0 AND doc_id IS NOT NULL")
    total = rows.count()
    depth = max(0, min(most_depth, math.ceil(math.log2(max(1, total / block))), int(math.log2(max(1, WEIGHTS // max(1, v))))))
    weights, limits = np.zeros((1, v), np.float32), np.zeros(1)
    if depth:

        def fit(group: pa.Table) -> pa.Table:
            doc = np.repeat(np.arange(group.num_rows), group.column("size").to_numpy())
            _, w, at = bisected(doc, flat(group, "terms"), group.num_rows, depth, learn=v)
            return pa.table({"split": pa.array(range(len(w)), pa.int32()), "w": pa.array([x.tobytes() for x in w], pa.binary()), "at": pa.array(at)})

        model = share_by_hash(rows, sample, "doc_id", of=total).groupBy(F.lit("sample").alias("all")).applyInArrow(fit, "split int, w binary, at double").orderBy("split").collect()
        weights, limits = np.array([np.frombuffer(r["w"], np.float32) for r in model]), np.array([r["at"] for r in model])
    sent = table.sparkSession.sparkContext.broadcast((weights, limits))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.repeat(np.arange(batch.num_rows), batch.column("size").to_numpy())
            to = routed(doc, flat(batch, "terms"), batch.num_rows, depth, *sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to.astype(np.int32))], names=[*batch.schema.names, "shard"])

    placed = rows.mapInArrow(route, PARSED + ", shard int")
    shards = placed.groupBy("shard").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.col("size").cast("long")) / (1 << 21))).alias("parts"))
    parts = {r["shard"]: r["parts"] for r in shards.collect()}  # 2^depth rows at most
    of = F.element_at(F.create_map(*[F.lit(x).cast("int") if k % 2 == 0 else F.lit(x).cast("long") for s in parts.items() for k, x in enumerate(s)]), F.col("shard")) if parts else F.lit(1)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "n"), of))

    def build(group: pa.Table) -> pa.Table:
        name = f"{group.column('shard')[0].as_py()}.{group.column('part')[0].as_py()}"
        return pa.Table.from_pylist(clusters(name, group, leaf, n_docs, length), schema=INDEX_SCHEMA)

    return dealt.groupBy("shard", "part").applyInArrow(build, INDEX)


class Items:
    """A turn of items: their terms' numbers and weights, one after the other."""

    def __init__(self, ids: list, counts: list[Counter], known: dict[bytes, int], weight: np.ndarray):
        own = [sorted((known[t], c * int(weight[known[t]])) for t, c in x.items() if t in known) for x in counts]
        self.ids, self.v = ids, len(weight)
        self.of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.terms = np.array([t for x in own for t, _ in x], np.int64)
        self.weights = np.array([w for x in own for _, w in x], np.int64)

    def bounds(self, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """What a document of a cluster scores at most, for each item."""
        most = np.zeros(self.v, np.int64)
        most[terms] = tops
        return total_by(self.of, self.weights * most[self.terms], len(self.ids))

    def scores(self, asked: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, doc_id, score of the documents of a cluster that score above 0, for the items asked."""
        docs, terms, ends, slots, impacts = row["docs"], row["terms"], row["ends"], row["slots"], row["impacts"]
        place = np.full(self.v, -1)
        place[terms] = np.arange(len(terms))
        use = np.flatnonzero(np.isin(self.of, asked) & (place[self.terms] >= 0))
        p = place[self.terms[use]]
        n = ends[p + 1] - ends[p]
        at = np.repeat(ends[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(self.of[use], n) * len(docs) + slots[at]
        total = total_by(cell, np.repeat(self.weights[use], n) * impacts[at], len(self.ids) * len(docs))
        hit = np.flatnonzero(total > 0)
        return hit // len(docs), docs[hit % len(docs)], total[hit]


def total_by(cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by cell. Doubles add them exactly while they are below 2^53."""
    if len(value) * int(value.max(initial=0)) < 1 << 53:
        return np.bincount(cell, value, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, cell, value)
    return out


def opened(batch: pa.RecordBatch) -> Iterator[dict]:
    kinds = {"docs": np.int64, "terms": np.int32, "ends": np.int32, "slots": np.int32, "impacts": np.int64, "tops": np.int64}
    for r in batch.to_pylist():
        yield {c: np.frombuffer(r[c], k) for c, k in kinds.items() if c in r} | {"cluster": r.get("cluster")}


class Best:
    """The best `top` documents of each item so far, and the score that a further one must reach."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top, self.rows = least.copy(), top, [(np.zeros(0, np.int64),) * 2 for _ in least]

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        for i in np.unique(item).tolist():
            own = (item == i) & (score >= self.least[i])
            d, s = np.concatenate((self.rows[i][0], doc[own])), np.concatenate((self.rows[i][1], score[own]))
            keep = np.lexsort((d, -s))[: self.top]
            self.rows[i] = d[keep], s[keep]
            if len(keep) == self.top:
                self.least[i] = max(self.least[i], s[keep[-1]])


def visited(index: DataFrame, items: Items, least: np.ndarray, top: int, only: dict[str, list[int]] | None = None) -> DataFrame:
    """item, doc_id, score: a task's best of the clusters that can reach `least`; with `only`, of these items of these clusters.
    Each task takes the clusters of a batch by falling bound and raises its thresholds as it goes."""
    sent = index.sparkSession.sparkContext.broadcast((items, least, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, low, pick = sent.value
        best = Best(low, top)
        for batch in batches:
            rows = [r for r in opened(batch) if pick is None or r["cluster"] in pick]
            bounds = [q.bounds(r["terms"], r["tops"]) for r in rows]
            for k in sorted(range(len(rows)), key=lambda k: -int(bounds[k].max(initial=0))):
                go = (bounds[k] >= best.least) & (bounds[k] > 0)
                if pick is not None:
                    go &= np.isin(np.arange(len(go)), pick[rows[k]["cluster"]])
                if go.any():
                    best.add(*q.scores(np.flatnonzero(go), rows[k]))
        item = np.repeat(np.arange(len(low)), [len(d) for d, _ in best.rows])
        docs, scores = (np.concatenate(c) for c in zip(*best.rows, strict=True))
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(docs), "score": pa.array(scores)})

    return index.mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def first_clusters(index: DataFrame, items: Items, each: int = 4) -> dict[str, list[int]]:
    """The `each` clusters of highest bound of every item."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = [], []
        for batch in batches:
            for r in opened(batch):
                names.append(r["cluster"])
                values.append(sent.value.bounds(r["terms"], r["tops"]))
                if len(names) > 256:  # of what a task has seen only the best count
                    names, values = best(names, values)
        names, values = best(names, values)
        got = [(i, n, int(b[i])) for n, b in zip(names, values, strict=True) for i in np.flatnonzero(b > 0).tolist()]
        yield pa.RecordBatch.from_pydict({"item": pa.array([x[0] for x in got], pa.int32()), "cluster": pa.array([x[1] for x in got], pa.string()), "bound": pa.array([x[2] for x in got], pa.int64())})

    def best(names: list[str], values: list[np.ndarray]) -> tuple[list[str], list[np.ndarray]]:
        if len(names) <= each:
            return names, values
        b = np.array(values)
        least = np.partition(b, len(b) - each, 0)[len(b) - each]
        b = np.where(b >= np.maximum(least, 1), b, 0)
        keep = np.flatnonzero(b.any(1))
        return [names[k] for k in keep], [b[k] for k in keep]

    w = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    rows = index.select("cluster", "terms", "tops").mapInArrow(run, "item int, cluster string, bound long").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["cluster"], []).append(r["item"])
    return out


def search(docs: DataFrame, items: DataFrame, top: int = 20, turn: int = 2000, block: int = 8192, leaf: int = 256, sample: int = 16_384) -> DataFrame:
    """Returns item_id, rank, doc_id, score for each item's `top` best documents with a score above 0.

    docs: doc_id, text; items: item_id, text. Terms and scores as the module's contract has them; null texts have no terms. Every row of items is
    an item of its own, also where it repeats an id or lacks one (null), and every row of docs a document; rows without a doc_id count in the statistics and
    are never returned. Documents without terms count nowhere. Equal scores go by ascending doc_id. Items without terms, and empty tables, give no
    rows. Very long texts are read whole, each in one task. Other columns play no part."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark, n_items = docs.sparkSession, asked.count()
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    turns = max(1, -(-n_items // turn))
    out = none
    for k in range(turns):
        own = asked if turns == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == k)
        rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        counts = [Counter(t.encode().translate(TERMS).split()) for _, t in rows]
        known = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        if not known:
            continue
        table = materialise(parsed(docs, known), "parsed")
        n_docs, length = table.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = frequencies(table, len(known))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        query = Items([i for i, _ in rows], counts, known, weight)
        index = materialise(build_index(table, len(known), n_docs, length, block, leaf, sample), "index", large_rows=True)
        low = np.ones(len(rows), np.int64)
        first = ranked(visited(index, query, low, top, first_clusters(index, query)), top)
        for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == top).collect():
            low[r["item"]] = r["least"]
        found = materialise(visited(index, query, low, top), "found")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], "item int, item_id long")
        out = out.unionByName(ranked(found, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        discard(table, index)
    return out


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
s AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0), g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM s),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
qc AS (SELECT item_id, t, count(*) AS c FROM q GROUP BY ALL), p AS (SELECT doc_id, n, unnest(ts) AS t FROM s),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM p WHERE t IN (SELECT t FROM qc) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
i AS (SELECT doc_id, t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS v FROM tf JOIN df USING (t), g),
r AS (SELECT item_id, doc_id, CAST(sum(c * v) AS BIGINT) AS score FROM qc JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM r WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20
"""

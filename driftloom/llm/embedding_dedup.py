"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

1. classes   rows with equal vectors are one class (128-bit hash of the entries); copies end here, whatever their number.
2. shards    a tree of spherical k-means splits: each shard of more than `cap` classes is split by centroids fitted on a bounded
             sample of it (`sample` rows), and every class goes to its `overlap` nearest centroids. What a sample shows to be a
             crowd becomes a ball: all classes within half the threshold's angle of its centre. Members of a ball are linked with
             one another by the triangle inequality, so a crowd of near copies makes one node of the graph and no pairs.
3. graph     in each shard, every node's nearest neighbours and some far ones are pruned by the robust rule (a neighbour stays
             unless a closer one lies `alpha` times nearer to it), edges are made mutual and pruned again.
4. union     adjacency lists of a node's shards become one list.
5. search    in each shard every node is a query: a beam search from medoids, then the range is expanded from every node found within
             it until nothing new turns up. What the beam meets in range is verified in double precision.
6. balls     a node whose angle to a ball leaves no doubt is linked with all of its members or with none; otherwise members
             are compared one by one, in blocks that give counts alone.
7. audit     queries picked by a hash (`audited`, a fixed number) are compared with all classes by brute force. Where fewer than `recall` of their links
             were found, everything is done again with twice the overlap.

Work: n * overlap shard rows and about a thousand comparisons each; what a task holds is bounded by `cap`, `sample` and the block size,
never by a crowd. Centroids and balls that a split sends to tasks are broadcast while their size is below BROADCAST bytes, and joined beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import discard, materialise, meet, share_by_hash
from .near_dedup import components

CAP, PER_SHARD, SAMPLE, OVERLAP, DEGREE, NEAREST, FAR, BEAM, ALPHA, BLOCK, BROADCAST = 4096, 512, 8192, 4, 24, 40, 12, 24, 1.2, 1024, 16 << 20
#: Angles within which a comparison in lower precision decides nothing.
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def stacked(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Binary rows of one length as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def vectors(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, dim, key (hash of the entries), vec (entries); key and vec are null where the vector can't be compared."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()), ("vec", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys, vecs, dims = batch.column("embedding"), [], [], []
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)
            ends = lists.offsets.to_numpy()
            null, gaps = lists.is_null().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(~(np.abs(values.astype(np.float64)) <= 1e150))))
            for k in range(batch.num_rows):
                v = values[ends[k] : ends[k + 1]] + 0.0  # -0 is 0
                ok = not null[k] and gaps[ends[k]] == gaps[ends[k + 1]] and v.any()
                vecs.append(v.tobytes() if ok else None)
                keys.append(blake2b(vecs[-1], digest_size=16).digest() if ok else None)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], schema=schema)

    kind_of = "array<float>" if kind == "f4" else "array<double>"
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind_of).alias("embedding")).mapInArrow(read, "vec_id long, dim int, key binary, vec binary")


def crowds(x: np.ndarray, half: float, share: float, most: int = 256) -> np.ndarray:
    """Centres of what holds at least `share` of the rows of x (unit vectors) within the angle `half`, densest first."""
    alive, out, least = np.arange(len(x)), [], max(16, share * len(x))
    x = x.astype(np.float32)
    near = [np.flatnonzero(x @ v >= np.cos(half)) for v in x] if len(x) <= 64 else None
    count = np.array([len(n) for n in near]) if near is not None else np.concatenate([(x[i : i + 512] @ x.T >= np.cos(half)).sum(1) for i in range(0, len(x), 512)])
    while len(out) < most and len(alive):
        best = alive[count[alive].argmax()]
        if count[best] < least:
            break
        own = alive[x[alive] @ x[best] >= np.cos(half)]
        centre = x[own].mean(0)
        centre /= np.linalg.norm(centre)
        taken = x[alive] @ centre >= np.cos(half)
        if taken.sum() >= least:
            out.append(centre)
        alive = alive[~(taken | (x[alive] @ x[best] >= np.cos(half)))]
    return np.array(out, np.float64).reshape(-1, x.shape[1])


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced rows."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)[:, None]
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


AT = "node long, ball boolean, first boolean, dim int, vec binary, shard string"
MODEL = "shard string, dim int, balls binary, cents binary"


def routed(table: pa.RecordBatch, models: dict[str, tuple[np.ndarray, np.ndarray]], half: float, overlap: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of open shards with their new shards; a row that a ball takes has shard null and the ball's id in place of its vector's."""
    shards = np.array(table.column("shard").to_pylist(), object)
    for name in dict.fromkeys(shards.tolist()):
        part = table.filter(pa.array(shards == name))
        balls, cents = models[name]
        x = unit(stacked(part.column("vec"), kind))
        first, is_ball = part.column("first").to_numpy(zero_copy_only=False), part.column("ball").to_numpy(zero_copy_only=False)
        taken = np.full(len(x), -1)
        if len(balls):
            cos = x @ balls.T
            taken = np.where(first & ~is_ball & (angle(cos.max(1)) <= half - 1e-7), cos.argmax(1), -1)
        free, cos = np.flatnonzero(taken < 0), x @ cents.T
        take = min(overlap, max(1, len(cents) // 2))  # each split leaves half at most, on average
        top = np.argpartition(-cos, take - 1, 1)[:, :take]
        nearest = cos.argmax(1)
        n = np.repeat(free, take)
        to = top[free].ravel()
        held = np.flatnonzero(taken >= 0)
        at = np.concatenate((n, held))
        out = part.take(pa.array(at))
        out_shard = pa.array([f"{name}/{k}" for k in to] + [f"{name}#{k}" for k in taken[held]], pa.string())
        is_first = pa.array(np.concatenate((first[n] & (to == nearest[n]), np.zeros(len(held), bool))))
        yield pa.RecordBatch.from_arrays([out.column("node"), out.column("ball"), is_first, out.column("dim"), out.column("vec"), out_shard], schema=out.schema)


def ball_id(name):
    return -1 - F.pmod(F.xxhash64(name), F.lit(1 << 61))


def sharded(classes: DataFrame, half: float, overlap: int, kind: str, cap: int = CAP, per_shard: int = PER_SHARD, sample: int = SAMPLE, least_share: float = 1 / 256) -> tuple[DataFrame, DataFrame]:
    """Rows of AT for each class (or ball) and shard, and (node, ball) for the classes that balls hold."""
    spark = classes.sparkSession
    at = materialise(classes.select("node", F.lit(False).alias("ball"), F.lit(True).alias("first"), "dim", "vec", F.concat(F.lit("d"), F.col("dim").cast("string")).alias("shard")), "shards")
    held, depth = spark.createDataFrame([], "node long, ball long"), 0
    schema = pa.schema([("shard", pa.string()), ("dim", pa.int32()), ("balls", pa.binary()), ("cents", pa.binary())])

    def fit(group: pa.Table) -> pa.Table:
        x = unit(stacked(group.column("vec"), kind))
        n = int(group.column("n")[0].as_py())
        balls = crowds(x, half, least_share)
        rest = x[(angle((x @ balls.T).max(1)) > half)] if len(balls) else x
        cents = centroids(rest if len(rest) else x, max(8, min(1024, -(-n // per_shard))))
        return pa.Table.from_arrays([pa.array([group.column("shard")[0].as_py()]), pa.array([group.column("dim")[0].as_py()], pa.int32()), pa.array([balls.tobytes()], pa.binary()), pa.array([cents.tobytes()], pa.binary())], schema=schema)

    while depth < 8:
        sizes = at.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)
        open_ = materialise(sizes, "open")
        n_open, widest = open_.count(), (at.agg(F.max("dim")).first()[0] or 0)
        if not n_open:
            discard(open_)
            break
        small = n_open * 1280 * widest * 8 <= BROADCAST
        hint = F.broadcast if n_open <= 10_000 else (lambda df: df)
        live = at.join(hint(open_), "shard")
        picked = live.filter(F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 30)) < F.least(F.lit(1.0), sample / F.col("n")) * (1 << 30))
        models = materialise(picked.groupBy("shard").applyInArrow(fit, MODEL), "models")
        as_models = lambda rows: {r["shard"]: (np.frombuffer(r["balls"]).reshape(-1, r["dim"]), np.frombuffer(r["cents"]).reshape(-1, r["dim"])) for r in rows}
        sent = spark.sparkContext.broadcast(as_models(models.collect())) if small else None

        copies = 2 if depth else overlap

        def route(batches: Iterator[pa.RecordBatch], sent=sent, copies=copies) -> Iterator[pa.RecordBatch]:
            names = ["node", "ball", "first", "dim", "vec", "shard"]
            for batch in batches:
                if not batch.num_rows:
                    continue
                if sent is None:
                    lists = as_models({c: batch.column(c)[k].as_py() for c in ("shard", "dim", "balls", "cents")} for k in dict(zip(batch.column("shard").to_pylist(), range(batch.num_rows), strict=True)).values())
                else:
                    lists = sent.value
                yield from routed(batch.select(names), lists, half, copies, kind)

        # a ball's centre goes where classes of its kind go
        centres = models.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([f"{r['shard']}#{k}" for k in range(len(r["balls"]) // 8 // r["dim"])], pa.string()), pa.array([r["shard"]] * (len(r["balls"]) // 8 // r["dim"]), pa.string()), pa.array([r["dim"]] * (len(r["balls"]) // 8 // r["dim"]), pa.int32()), binary(np.frombuffer(r["balls"]).reshape(-1, r["dim"]).astype(kind))], names=["name", "shard", "dim", "vec"]) for b in batches for r in b.to_pylist()), "name string, shard string, dim int, vec binary")
        new_balls = centres.select(ball_id(F.col("name")).alias("node"), F.lit(True).alias("ball"), F.lit(True).alias("first"), "dim", "vec", "shard")
        moving = live.drop("n").select("node", "ball", "first", "dim", "vec", "shard").unionByName(new_balls)
        moving = moving if small else moving.join(models.drop("dim"), "shard")
        done = materialise(moving.mapInArrow(route, AT), "routed")
        inside = F.col("shard").contains("#")
        held = held.unionByName(done.filter(inside).select("node", ball_id(F.col("shard")).alias("ball")))
        absorbed = done.filter(inside).select("node")
        rest = at.join(hint(open_).select("shard"), "shard", "left_anti").select(*at.columns).unionByName(done.filter(~inside).select(*at.columns))
        # a class may have been put into a shard twice on different ways, and one that a ball holds may have copies elsewhere
        rest = rest.join(absorbed, "node", "left_anti") if depth else rest
        old, at = at, materialise(rest.groupBy("node", "shard").agg(F.first("ball").alias("ball"), F.max("first").alias("first"), F.first("dim").alias("dim"), F.first("vec").alias("vec")).select(*at.columns), "shards")
        held = materialise(held, "held")
        discard(old, open_)
        depth += 1
    return at, held


def pruned(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of some rows of x. near: their candidates (-1: none). Keeps the closest, drops those that lie alpha times
    nearer to it than to the row, and so on, up to `degree`."""
    own = np.where(near >= 0, 2 - 2 * np.einsum("nd,ncd->nc", x[rows], x[near]), np.inf)
    alive, out, at = near >= 0, np.full((len(rows), degree), -1, np.int32), np.arange(len(rows))
    for k in range(degree):
        go = alive.any(1)
        if not go.any():
            break
        best = np.where(alive, own, np.inf).argmin(1)
        pick = near[at, best]
        out[go, k] = pick[go]
        between = 2 - 2 * np.einsum("nd,ncd->nc", x[pick], x[near])
        alive &= go[:, None] & (alpha * alpha * between > own)
        alive[at[go], best[go]] = False
    return out


def mutual(x: np.ndarray, out: np.ndarray, width: int = 64) -> np.ndarray:
    """Edges in both directions; where a node has more than fit they are pruned again."""
    n = len(x)
    a, b = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    both = np.unique(np.concatenate((a * n + b, b.astype(np.int64) * n + a)))
    a, b = both // n, both % n
    cos = np.einsum("id,id->i", x[a], x[b])
    order = np.lexsort((-cos, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    near = np.full((n, min(width, int(rank.max(initial=0)) + 1)), -1, np.int64)
    keep = rank < width
    near[a[keep], rank[keep]] = b[keep]
    return near.astype(np.int32) if near.shape[1] <= 2 * DEGREE else pruned(x, np.arange(n), near, 2 * DEGREE)


def shard_graph(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Adjacency (-1 pads) of a shard of unit vectors."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    x = x.astype(np.float32)
    c = min(NEAREST, n - 1)
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    out = np.full((n, DEGREE), -1, np.int32)
    for i in range(0, n, 512):
        rows = np.arange(i, min(n, i + 512))
        cos = x[rows] @ x.T
        cos[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-cos, c - 1, 1)[:, :c]
        cand = np.concatenate((near, far[rows]), 1)
        of = np.take_along_axis(cos, cand, 1)
        cand = np.take_along_axis(cand, np.argsort(-of, 1, kind="stable"), 1)
        cand[cand == rows[:, None]] = -1
        out[rows] = pruned(x, rows, cand)
    return mutual(x, out)


def medoids(x: np.ndarray, k: int = 12) -> np.ndarray:
    """Rows nearest to the shard's mean and to centroids of it."""
    c = np.concatenate((x.mean(0, keepdims=True), centroids(x, k, 3)))
    return np.unique((c @ x.T).argmax(1))


def range_search(x: np.ndarray, adj: np.ndarray, low: np.ndarray, starts: np.ndarray, beam: int = BEAM, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) for all rows of x as queries. A pair is in range where the angle is at most low[query] + low[found]. Beam search
    from `starts`, four nodes a step, until no better node is left; then from all in range to what is next to them, until nothing is new."""
    x, n, found = x.astype(np.float32), len(x), []
    for i in range(0, n, batch):
        q = np.arange(i, min(n, i + batch))
        xq, rows = x[q], np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        seen[:, starts] = True
        ids = np.tile(starts.astype(np.int64), (len(q), 1))
        cos = xq @ x[starts].T
        ids, cos = np.pad(ids, ((0, 0), (0, max(0, beam - len(starts)))), constant_values=0), np.pad(cos, ((0, 0), (0, max(0, beam - len(starts)))), constant_values=-np.inf)
        opened = ~np.isfinite(cos)
        hits: list[tuple[np.ndarray, np.ndarray]] = []

        def in_range(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = angle(c) <= low[q[a]] + low[b] + SLACK
            return a[ok], b[ok]

        hits.append(in_range(np.repeat(rows, len(starts)), np.tile(starts, len(q)), cos[:, : len(starts)].ravel()))
        while True:
            value = np.where(opened, -np.inf, cos)
            step = min(4, value.shape[1])
            top = np.argpartition(-value, step - 1, 1)[:, :step]
            good = np.isfinite(np.take_along_axis(value, top, 1))
            if not good.any():
                break
            np.put_along_axis(opened, top, True, 1)
            a, k = np.nonzero(good)
            b = adj[ids[a, top[a, k]]]
            a, b = np.repeat(a, adj.shape[1]), b.ravel()
            fresh = (b >= 0) & ~seen[a, b]
            flat = np.unique(a[fresh] * n + b[fresh])
            a, b = flat // n, flat % n
            seen[a, b] = True
            c = np.einsum("id,id->i", xq[a], x[b])
            hits.append(in_range(a, b, c))
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            wide = int(rank.max(initial=-1)) + 1
            if not wide:
                continue
            more, more_ids = np.full((len(q), wide), -np.inf, np.float32), np.zeros((len(q), wide), np.int64)
            more[a, rank], more_ids[a, rank] = c, b
            cos, ids, opened = np.concatenate((cos, more), 1), np.concatenate((ids, more_ids), 1), np.concatenate((opened, ~np.isfinite(more)), 1)
            if cos.shape[1] > beam:
                keep = np.argpartition(-cos, beam - 1, 1)[:, :beam]
                cos, ids, opened = (np.take_along_axis(m, keep, 1) for m in (cos, ids, opened))
        front = tuple(np.concatenate(c) for c in zip(*hits, strict=True))
        while len(front[0]):
            found.append((q[front[0]], front[1]))
            fresh = []
            for j in range(0, len(front[0]), 1 << 16):  # a crowd's pairs are looked at in parts
                a, b = np.repeat(front[0][j : j + (1 << 16)], adj.shape[1]), adj[front[1][j : j + (1 << 16)]].ravel()
                new = (b >= 0) & ~seen[a, b]
                flat = np.unique(a[new] * n + b[new])
                a, b = flat // n, flat % n
                seen[a, b] = True
                fresh.append(in_range(a, b, np.einsum("id,id->i", xq[a], x[b])))
            front = tuple(np.concatenate(c) for c in zip(*fresh, strict=True))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return a, b


def graph_links(at: DataFrame, kind: str, theta: float) -> DataFrame:
    """a, b (a < b), cos: nodes whose angle is at most theta and both radii, found by searching each shard with the lists of all shards."""
    edges = pa.schema([("node", pa.int64()), ("nbrs", pa.binary())])
    links = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cos", pa.float64())])

    def build(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        adj = shard_graph(unit(stacked(group.column("vec"), kind)))
        return pa.Table.from_arrays([pa.array(node), pa.array([node[r[r >= 0]].tobytes() for r in adj], pa.binary())], schema=edges)

    def search(group: pa.Table) -> pa.Table:
        node, x = group.column("node").to_numpy(), unit(stacked(group.column("vec"), kind))
        order = np.argsort(node)
        node, x, radius = node[order], x[order], group.column("radius").to_numpy()[order]
        lists = [np.unique(np.frombuffer(b"".join(n), np.int64)) for n in np.array(group.column("lists").to_pylist(), object)[order]] if len(node) > 1 else []
        if not lists:
            return links.empty_table()
        flat, of = np.concatenate(lists), np.repeat(np.arange(len(node)), [len(n) for n in lists])
        place = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        here = node[place] == flat
        of, place = of[here], place[here]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        adj = np.full((len(node), int(rank.max(initial=0)) + 1), -1, np.int64)
        adj[of, rank] = place
        a, b = range_search(x, adj, theta / 2 + radius, medoids(x))
        pair = np.unique(np.minimum(a, b) * len(node) + np.maximum(a, b))
        a, b = pair // len(node), pair % len(node)
        a, b = a[a != b], b[a != b]
        cos = np.concatenate([np.einsum("id,id->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        ok = (cos >= np.cos(theta)) | (angle(cos) <= theta + radius[a] + radius[b])
        return pa.Table.from_arrays([pa.array(node[a[ok]]), pa.array(node[b[ok]]), pa.array(cos[ok])], schema=links)

    lists = at.groupBy("shard").applyInArrow(build, "node long, nbrs binary").groupBy("node").agg(F.collect_list("nbrs").alias("lists"))
    lists = materialise(lists, "adjacency")
    met = at.select("node", "vec", "shard", "radius").join(lists, "node")
    return met.groupBy("shard").applyInArrow(search, "a long, b long, cos double").groupBy("a", "b").agg(F.max("cos").alias("cos"))


def compared(group: pa.Table, kind: str, least: float) -> pa.Table:
    """A block of one side (role 0) against a block of the other: how many rows each class is linked with over there."""
    x, n, role, node = unit(stacked(group.column("vec"), kind)), group.column("cnt").to_numpy(), group.column("role").to_numpy(), group.column("node").to_numpy()
    le, ri = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    linked = x[le] @ x[ri].T >= least
    more = np.concatenate((linked @ n[ri], linked.T @ n[le]))
    a, b = (group.column(c)[0].as_py() for c in "ab")
    k = len(more)
    return pa.table({"a": pa.array([a] * k, pa.int64()), "b": pa.array([b] * k, pa.int64()), "node": pa.array(node[np.concatenate((le, ri))], pa.int64()), "n": pa.array(more, pa.int64())}).filter(pa.array(more > 0))


def member_links(pairs: DataFrame, members: DataFrame, kind: str, least: float, block: int = BLOCK) -> DataFrame:
    """a, b, node, n: rows that a class of node pair (a, b) is linked with on the other side. pairs: a, b; members: owner, node, cnt, vec."""
    blocks = members.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    open_ = pairs.join(blocks.withColumnsRenamed({"owner": "a", "blocks": "ab"}), "a").join(blocks.withColumnsRenamed({"owner": "b", "blocks": "bb"}), "b")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    le = members.join(open_, members.owner == open_.a).select("a", "b", "node", "cnt", "vec", F.lit(0).alias("role"), own("ab").alias("i"), every("bb").alias("j"))
    ri = members.join(open_, members.owner == open_.b).select("a", "b", "node", "cnt", "vec", F.lit(1).alias("role"), every("ab").alias("i"), own("bb").alias("j"))
    return le.unionByName(ri).groupBy("a", "b", "i", "j").applyInArrow(lambda t: compared(t, kind, least), "a long, b long, node long, n long")


def brute_counts(classes: DataFrame, asked: DataFrame, kind: str, least: float) -> DataFrame:
    """node, true: rows linked with each asked class (its own included), by comparing it with all classes. What tasks get is as large as `asked`."""
    rows = asked.select("node", "dim", "vec").collect()
    by_dim = {d: (np.array([r["node"] for r in rows if r["dim"] == d]), unit(np.frombuffer(b"".join(r["vec"] for r in rows if r["dim"] == d), kind).reshape(-1, d))) for d in {r["dim"] for r in rows}}
    sent = asked.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            dims, cnt = batch.column("dim").to_numpy(), batch.column("cnt").to_numpy()
            for d, (ids, q) in sent.value.items():
                here = np.flatnonzero(dims == d)
                if len(here):
                    hits = q @ unit(stacked(batch.column("vec").take(pa.array(here)), kind)).T >= least
                    for k, v in zip(ids.tolist(), (hits @ cnt[here]).tolist(), strict=True):
                        total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(total), pa.int64()), "true": pa.array(list(total.values()), pa.int64())})

    return classes.select("dim", "cnt", "vec").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))


def linked_groups(rows: DataFrame, least: float = 0.95, overlap: int = OVERLAP, recall: float = 0.98, audited: int = 1024, cap: int = CAP, per_shard: int = PER_SHARD, sample: int = SAMPLE, least_share: float = 1 / 256) -> DataFrame:
    """Returns one row per row of rows (vec_id, embedding): vec_id, n_links, component_id, kept, audit_recall.

    Rows are linked where the cosine of their vectors, in double precision, is at least `least` (between 0 and 1). n_links counts other rows; component_id
    is the smallest vec_id reachable, its own included. Vectors that are null, empty or zero, or hold a null or non-finite entry (or one
    beyond 1e150), are linked with nothing, as are rows without a vec_id; these have a null component_id and are kept. Vectors of different
    lengths are never linked. Rows that repeat a vec_id are rows of their own: their links count each, and kept is true for all that hold their component's id.
    audit_recall is the share of links that the audited queries' search found (1 where they have none). An empty table gives no
    rows. Columns other than vec_id and embedding play no part."""
    element = rows.schema["embedding"].dataType
    kind = "f8" if isinstance(element, ArrayType) and isinstance(element.elementType, DoubleType) else "f4"
    theta = float(np.arccos(least))
    rows = materialise(vectors(rows, kind), "vectors")
    valid = rows.filter("key IS NOT NULL AND vec_id IS NOT NULL")
    grouped = valid.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt"), F.first("vec").alias("vec"))
    classes = materialise(grouped.select(F.monotonically_increasing_id().alias("node"), "dim", "key", "rep", "cnt", "vec"), "classes")
    n_rows = rows.count()
    while True:
        at, held = sharded(classes, theta / 2, overlap, kind, cap, per_shard, sample, least_share)
        inside = meet(classes.select("node", "cnt", "vec"), held, "node", n_rows, left=True)
        centres = at.filter("ball").select(F.col("node").alias("ball"), F.col("vec").alias("centre")).dropDuplicates(["ball"])
        off = materialise(meet(inside.filter("ball IS NOT NULL"), centres, "ball", n_rows), "members")
        turned = pa.schema([("owner", pa.int64()), ("node", pa.int64()), ("cnt", pa.int64()), ("vec", pa.binary()), ("off", pa.float64())])

        def offs(batches: Iterator[pa.RecordBatch], turned=turned) -> Iterator[pa.RecordBatch]:
            for b in batches:
                widths = np.array([len(v) for v in b.column("vec").to_pylist()])
                for w in np.unique(widths):
                    part = b.filter(pa.array(widths == w))
                    cos = np.einsum("id,id->i", unit(stacked(part.column("vec"), kind)), unit(stacked(part.column("centre"), kind)))
                    yield pa.RecordBatch.from_arrays([part.column("ball"), part.column("node"), part.column("cnt"), part.column("vec"), pa.array(angle(cos))], schema=turned)

        members = materialise(off.mapInArrow(offs, "owner long, node long, cnt long, vec binary, off double"), "members")
        balls = members.groupBy("owner").agg(F.max("off").alias("radius"), F.sum("cnt").alias("total"))
        nodes = materialise(balls.withColumn("single", F.lit(False)).unionByName(inside.filter("ball IS NULL").select(F.col("node").alias("owner"), F.lit(0.0).alias("radius"), F.col("cnt").alias("total"), F.lit(True).alias("single"))), "nodes")
        wide = at.join(nodes.select(F.col("owner").alias("node"), "radius"), "node")
        found = materialise(graph_links(wide, kind, theta), "found")
        end = lambda p: nodes.select(F.col("owner").alias(p), F.col("radius").alias(f"{p}_radius"), F.col("total").alias(f"{p}_total"), F.col("single").alias(f"{p}_single"))
        both = found.join(end("a"), "a").join(end("b"), "b")
        apart, around = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))), F.col("a_radius") + F.col("b_radius")
        two = F.col("a_single") & F.col("b_single")
        # an angle of 1e-7 covers what rounding does to a centre; between single vectors the cosine itself decides
        sure = F.when(two, F.col("cos") >= least).otherwise(apart + around <= theta - 1e-7)
        graded = materialise(both.withColumn("sure", sure).filter(F.col("sure") | ~two), "graded")
        certain = graded.filter("sure")
        per_node = certain.select(F.col("a").alias("owner"), F.col("b_total").alias("n")).union(certain.select("b", "a_total")).groupBy("owner").agg(F.sum("n").alias("linked"))
        singles = inside.filter("ball IS NULL").select(F.col("node").alias("owner"), "node", "cnt", "vec")
        doubt = graded.filter("NOT sure").select("a", "b")
        single_links = materialise(member_links(doubt, members.drop("off").unionByName(singles), kind, least), "doubtful")
        per_class = single_links.groupBy("node").agg(F.sum("n").alias("more"))
        comp = components(certain.select("a", "b").union(single_links.select("a", "b").distinct()))
        owner = inside.select("node", F.coalesce("ball", "node").alias("owner"))
        of_node = nodes.join(per_node, "owner", "left").join(comp.withColumnRenamed("node", "owner"), "owner", "left").select("owner", F.coalesce("comp", "owner").alias("comp"), (F.when(F.col("single"), F.lit(0)).otherwise(F.col("total")) + F.coalesce("linked", F.lit(0))).alias("around"), "single")
        met = meet(classes.drop("vec").join(owner, "node"), of_node, "owner", n_rows).join(per_class, "node", "left")
        met = materialise(met.select("node", "dim", "key", "rep", "comp", (F.when(F.col("single"), F.col("cnt")).otherwise(F.lit(0)) + F.col("around") + F.coalesce("more", F.lit(0)) - 1).alias("n_links")), "linked")
        asked = materialise(share_by_hash(classes, audited, "node"), "audited")
        check = brute_counts(classes, asked, kind, least).join(met.select("node", "n_links"), "node").agg(F.sum(F.least(F.col("true") - 1, "n_links")).alias("got"), F.sum(F.col("true") - 1).alias("true")).first()
        seen = 1.0 if not check["true"] else check["got"] / check["true"]
        if seen >= recall or overlap >= 16:
            break
        overlap *= 2
    least_id = met.groupBy("comp").agg(F.min("rep").alias("component_id"))
    per_key = meet(met, least_id, "comp", n_rows).select("dim", "key", "n_links", "component_id")
    # equal vectors: the class of a large number of rows is dealt out
    out = meet(rows.select("vec_id", "dim", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")), per_key, ["dim", "key"], n_rows, left=True)
    where = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), where.alias("component_id"), F.col("vec_id").eqNullSafe(where).alias("kept"), F.lit(float(seen)).alias("audit_recall"))

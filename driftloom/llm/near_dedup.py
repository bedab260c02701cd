"""Near-duplicate detection with SetSketch registers.

A document is its set of distinct word shingles (64-bit hashes). Its sketch has m registers: for each shingle,
register values come in rising order, the j-th drawn from an exponential distribution truncated to the j-th of m intervals of
equal probability and put into one register each by an affine permutation; a register keeps the minimum x, stored as
floor(1 - log_b x). Registers of a union are the maxima of those values, and two documents agree in one with a
probability close to their Jaccard similarity, so bands of registers find candidates.

1. sketches   one pass over the texts: class key (128-bit hash of the whole sorted set), size, registers. Narrow.
2. classes    documents with equal sets are one class, its representative the smallest id; copies end here.
3. bands      each representative's bands; a bucket links its members to its smallest id (a star: as many candidate
              pairs as members, never all pairs of a bucket). What stars connect is a cluster.
4. sets       the full shingle sets of documents in clusters, from their texts, read again where they lie.
5. blocks     clusters are packed into, or split over, blocks of about 256 documents. In a block, sizes and the joint
              likelihood of (registers above, equal, below) over all similarities set pairs aside where the threshold
              is less likely than the best fit by e^18; the rest is verified on full sets. Links that join components leave.
6. across     components of links by alternating min-label steps. In clusters of several blocks, documents outside the
              largest component are compared with all members, in pairs of blocks; where a cluster hangs together by buckets much
              smaller than itself, this goes bucket by bucket. So no link between different texts that share a band is lost,
              and no pair of a large group becomes a row.

73 bands of seven registers: a pair at the threshold 0.8 shares none with probability (1 - 0.8^7)^73, below 4e-8; one at 0.5
shares one with 0.44, at 0.4 with 0.11, at 0.3 with 0.02.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import as_bytes, discard, documents, materialise, slices

M, ROWS, BASE, CACHE, BLOCK, FILTER_BITS = 512, 7, 1.02, 200_000, 256, 26
PAIRS = 200_000  # held at once in a block
BANDS = M // ROWS
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def shingle_set(text: bytes, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; words are what ASCII white space parts.
    A text with fewer words is one shingle; one without words has none."""
    seen = text.lower().split()
    if not seen:
        return np.zeros(0, U)
    h = np.fromiter(map(words.__getitem__, seen), U, len(seen))
    n = max(1, len(h) - width + 1)
    take = min(width, len(h))
    total = np.full(n, take, U)
    for k in range(take):
        total *= U(0x9FB21C651E98DF25)
        total += h[k : k + n]
        total ^= total >> U(29)
    return np.unique(mix(total))


def set_key(h: np.ndarray) -> bytes:
    """128-bit hash of a whole set."""
    return blake2b(h.tobytes(), digest_size=16).digest()


def interval_ends(m: int) -> np.ndarray:
    """Ends of m intervals that an exponential variable of rate 1 falls into with equal probability."""
    j = np.arange(m)
    return np.concatenate((np.log1p(j / (m - j)), [np.inf]))


ENDS = interval_ends(M)


def registers(h: np.ndarray) -> np.ndarray:
    """m register values (16 bits) of a set of shingle hashes; zeros for an empty set.

    Intervals are taken several at a time; within one, x rises with the random part u, so each register's minimum is
    taken over u and the logarithm once a register."""
    n = len(h)
    if not n:
        return np.zeros(M, np.uint16)
    low = np.full(M, np.inf)
    first, step = (h & U(M - 1)).astype(np.int64), ((h >> U(16)) & U(M - 1) | U(1)).astype(np.int64)
    j, wide = 0, max(1, min(M, 4096 // n))
    while j < M and ENDS[j] <= low.max():
        turn = np.arange(j, min(M, j + wide))
        state = mix(h[:, None] + turn.astype(U) * U(0x9E3779B97F4A7C15))
        cell = (first[:, None] + turn * step[:, None]) & (M - 1)
        least = np.full((len(turn), M), ~U(0))
        np.minimum.at(least.reshape(-1), (cell + np.arange(len(turn)) * M).ravel(), state.ravel())
        u = (least >> U(11)).astype(np.float64) * 2.0**-53
        # exponential truncated to interval j: all intervals have probability 1/m
        x = -np.log(np.maximum(np.exp(-ENDS[turn])[:, None] - u / M, 1e-300))
        low = np.minimum(low, np.where(least == ~U(0), np.inf, x).min(0))
        j += wide
    return np.clip(np.floor(1 - np.log(low) / np.log(BASE)) + 200, 1, 65535).astype(np.uint16)


SKETCH = "doc_id long, set_key binary, n_shingles long, regs binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set_key (128-bit hash of the set), n_shingles, regs (registers, or null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n_shingles", pa.int64()), ("regs", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches):
            keys, sizes, regs = [], [], []
            for text in as_bytes(batch, "text"):
                h = shingle_set(text, width, words)
                keys.append(set_key(h) if len(h) else None)
                sizes.append(len(h))
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], schema=schema)

    return documents(docs).mapInArrow(sketch, SKETCH)


def band_rows(classes: DataFrame) -> DataFrame:
    """rep, bucket: a row for each representative and band. A bucket is the band's number and register values, hashed."""
    schema = pa.schema([("rep", pa.int64()), ("bucket", pa.int64())])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048, 1 << 30):
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, M)
            cut = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U)
            total = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), cut.shape[:2]).copy()
            for k in range(ROWS):
                total = mix(total + cut[:, :, k])
            reps = np.repeat(np.asarray(batch.column("rep")), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(total.astype(np.int64).ravel(), pa.int64())], schema=schema)

    return classes.select("rep", "regs").mapInArrow(bands, "rep long, bucket long")


def above(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is above the other's, where x is the part of the union that it alone adds."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood_keeps(up: np.ndarray, down: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, slack: float = 18.0) -> np.ndarray:
    """Whether the threshold, or a similarity above it, is not less likely than the best fit by e^slack.

    up and down count registers of a above and below b's. Given sizes and J, the union has (na + nb) / (1 + J)
    elements; a register is above where the element that sets it is in a alone."""
    share = na / (na + nb)
    best = np.full(len(up), -np.inf)
    over = np.full(len(up), -np.inf)
    for j in np.linspace(0, 1, 51):
        most = np.minimum(share / (1 - share), (1 - share) / share)
        ok = j <= most + 1e-9
        p = above(np.clip(share - (1 - share) * j, 1e-9, 1))
        q = above(np.clip(1 - share - share * j, 1e-9, 1))
        value = np.where(ok, up * np.log(p) + down * np.log(q) + (M - up - down) * np.log(np.clip(1 - p - q, 1e-12, 1)), -np.inf)
        best = np.maximum(best, value)
        if j >= threshold - 1e-9:
            over = np.maximum(over, value)
    return over >= best - slack


def candidate_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray | None:
    """A bit table of a fixed size (8 MB) over hashed ids, or None where there are too many ids for it to tell much."""
    if ids.count() > 1 << (bits - 2):
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    if words.num_rows:
        table[np.asarray(words.column("w").combine_chunks())] = np.asarray(words.column("v").combine_chunks())
    return table


def sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set_key, own, regs: full shingle sets and registers of candidate documents, from their texts, which are read again.

    A bit table of the ids lets tasks pass over other documents' texts where they lie; only sets are shuffled. Where
    there are too many ids for the table, the texts meet the ids in a shuffled join first. Both give the same rows."""
    table = candidate_filter(ids)
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("own", pa.binary()), ("regs", pa.binary())])
    held = ids.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            if held is not None:
                p = batch.column("p").to_numpy()
                batch = batch.filter(pa.array((held.value[p >> 6] >> (p & 63)) & 1 == 1))
            for part in slices([batch]):
                own = [shingle_set(t, width, words) for t in as_bytes(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([set_key(h) for h in own], pa.binary()), pa.array([h.tobytes() for h in own], pa.binary()), pa.array([registers(h).tobytes() for h in own], pa.binary())], schema=schema)

    rows = documents(docs).filter("doc_id IS NOT NULL").withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    rows = rows if held is not None else rows.join(ids, "doc_id")
    return rows.select("doc_id", "text", "p").mapInArrow(sets, "doc_id long, set_key binary, own binary, regs binary")


def block_links(group: pa.Table, percent: int) -> pa.Table:
    """Links between the strays (role 0) and the members (role 1) of a block that join different components: a spanning
    forest, so at most as many rows as documents. Without role and comp all documents are both, each a component.

    Sizes and the registers' joint likelihood set pairs aside; what they leave is decided on the full sets."""
    rep = group.column("rep").to_numpy()
    role, comp = (group.column(c).to_numpy() for c in ("role", "comp")) if "comp" in group.column_names else (None, rep)
    own = [np.frombuffer(x, U) for x in group.column("own").to_pylist()]
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, M)
    strays = np.arange(len(rep)) if role is None else np.flatnonzero(role == 0)
    size = np.array([len(x) for x in own], np.int64)
    tokens, doc = np.concatenate([own[i] for i in strays] or [np.zeros(0, U)]), np.repeat(np.arange(len(strays)), size[strays])
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    root = {int(c): int(c) for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links: list[tuple[int, int]] = []

    def decide(pairs: list[tuple[np.ndarray, ...]]) -> None:
        near, of, up, down = (np.concatenate(c) for c in zip(*pairs, strict=True))
        # sets smaller than the sketch repeat few elements over all registers: the likelihood doesn't hold for them;
        # and registers that agree as often as the threshold need no estimate
        least = np.minimum(size[strays[near]], size[of])
        ask = np.flatnonzero((least >= M) & (100 * (M - up - down) < percent * M))
        keep = np.ones(len(near), bool)
        keep[ask] = likelihood_keeps(up[ask], down[ask], size[strays[near[ask]]].astype(float), size[of[ask]].astype(float), percent / 100)
        near, of = near[keep], of[keep]
        if not len(of):
            return
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for lo_, hi_ in zip(edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True):
            b, own_near = int(of[lo_]), near[lo_:hi_]
            lo, hi = np.searchsorted(tokens, own[b]), np.searchsorted(tokens, own[b], "right")
            n = hi - lo
            hits = doc[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(strays))[own_near]
            for k in own_near[100 * common >= percent * (size[strays[own_near]] + size[b] - common)].tolist():
                x, y = find(int(comp[strays[k]])), find(int(comp[b]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(rep[strays[k]]), int(rep[b])))

    pairs, waiting = [], 0
    for b in range(len(rep)) if role is None else np.flatnonzero(role == 1).tolist():
        near = np.flatnonzero((100 * np.minimum(size[strays], size[b]) >= percent * np.maximum(size[strays], size[b])) & (comp[strays] != comp[b]) & ((strays < b) | (role is not None)))
        if len(near):
            up, down = (regs[strays[near]] > regs[b]).sum(1), (regs[strays[near]] < regs[b]).sum(1)
            pairs.append((near, np.full(len(near), b), up, down))
            waiting += len(near)
        if waiting > PAIRS:  # what they join needs no further comparison
            decide(pairs)
            pairs, waiting, comp = [], 0, np.array([find(int(c)) for c in comp])
    if pairs:
        decide(pairs)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def links_within(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """nodes (rep, cluster, own, regs) with the key of their block: small clusters share blocks, large ones have several.
    Also the clusters with several blocks and how many."""
    sizes = materialise(nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "clusters")
    packs = max(1, -(-(sizes.filter(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0) // block))
    key = F.when(F.col("n") <= block, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block)))
    keyed = nodes.join(sizes, "cluster").select(F.when(F.col("n") > block, F.col("cluster")).alias("large"), key.alias("i"), "rep", "own", "regs")
    return keyed, sizes.filter(F.col("n") > block)


def cross_links(nodes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between different components of a cluster of several blocks. nodes: rep, cluster, comp, own, regs.

    Only strays (documents outside their cluster's largest component) can bring any, so they are compared with the
    cluster's members, in pairs of blocks of about `block` documents: no task holds more than two blocks, whatever
    the cluster's size, and no pair is a row."""
    parts = nodes.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("most"))
    open_ = open_.filter("comps > 1").select("cluster", "main", F.ceil((F.col("n") - F.col("most")) / block).alias("sb"), F.ceil(F.col("n") / block).alias("mb"))
    rows = nodes.join(open_, "cluster")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    own = ["cluster", "rep", "comp", "own", "regs"]
    strays = rows.filter("comp <> main").select(*own, F.lit(0).alias("role"), at("sb").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)).alias("j"))
    members = rows.select(*own, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sb") - 1)).alias("i"), at("mb").alias("j"))
    return strays.unionByName(members).groupBy("cluster", "i", "j").applyInArrow(lambda t: block_links(t, percent), "a long, b long")


def meetings(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """nodes (rep, cluster, comp, own, regs) as cross_links() takes them, where a cluster is whole, or each of its buckets that holds several
    components: whichever makes fewer rows there. Clusters that hang together by chance grow faster than the input, their buckets don't."""
    bands = band_rows(nodes).join(nodes.select("rep", "cluster", "comp"), "rep")

    def rows(parts: DataFrame, by: list[str]) -> DataFrame:
        """by, rows, n: how many rows cross_links() makes of groups that hold several components. parts: by, comp, n."""
        got = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        strays, blocks = F.col("n") - F.col("most"), lambda n: F.ceil(n / block)
        return got.select(*by, (strays * blocks(F.col("n")) + F.col("n") * blocks(strays)).alias("rows"), "n")

    mixed = materialise(rows(bands.groupBy("cluster", "bucket", "comp").agg(F.count(F.lit(1)).alias("n")), ["cluster", "bucket"]), "mixed")
    # documents also go to each of their buckets
    apart = mixed.groupBy("cluster").agg(F.sum(F.col("rows") + F.col("n")).alias("apart"))
    whole = rows(nodes.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n")), ["cluster"])
    split = materialise(whole.join(apart, "cluster", "left").filter("coalesce(apart, 0) < rows").select("cluster"), "split")
    cut = bands.join(mixed.join(split, "cluster").select("cluster", "bucket"), ["cluster", "bucket"]).select("rep", F.xxhash64("cluster", "bucket").alias("cluster"))
    return nodes.join(split, "cluster", "left_anti").select("rep", "cluster", "comp", "own", "regs").unionByName(cut.join(nodes.drop("cluster"), "rep").select("rep", "cluster", "comp", "own", "regs"))


def with_least(edges: DataFrame, both_sides: bool = False, salts: int = 8) -> DataFrame:
    """u, v, m: edges beside the least neighbour m of u (or u itself, if that is less and both_sides is set). A node's edges
    are dealt out over `salts` tasks by v, and its least neighbour goes to each of them, so a hub's edges don't meet in one.

    The join is shuffled whatever the size: Spark takes the least neighbours, salted, for as small as the edges' file, and would send some millions
    of rows through the driver."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", (F.least("m", "u") if both_sides else F.col("m")).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable, for each node of links (a, b).

    Alternates large-star and small-star steps (each node's larger, then smaller, neighbours are linked to its least
    one) until nothing changes: about log n rounds. Each round is a narrow table in the shared folder."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
        deep = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR below = 1 AND above = 1")
        if not deep.head(1):  # stars alone
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, both_sides=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old, edges = edges, materialise(small, "edges")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_groups(docs: DataFrame, width: int = 4, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Returns one row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest id reachable over links, itself included. Null texts and texts without words have no shingles and are linked with
    nothing; texts with fewer words than a shingle are one shingle. Rows without an id are linked with nothing, and
    their component_id is null, kept true. Rows that repeat an id are one document: its set is that of its row with the smallest
    set key. Very long texts are read whole, each in one task; what they add to shuffles is their distinct shingles."""
    sk = materialise(sketches(docs, width), "sketches")
    repeated = bool(sk.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").head(1))
    one = sk.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_key").alias("set_key"))
    sized = sk.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("any_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = materialise(one.groupBy("set_key").agg(F.min("doc_id").alias("rep")).join(sized, "set_key").select("set_key", "rep", "n_shingles", "regs"), "classes")
    rows = band_rows(classes)
    hubs = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = rows.join(hubs.select("bucket", "hub"), "bucket").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    star = materialise(star, "candidates")
    nodes = components(star).select(F.col("node").alias("rep"), F.col("comp").alias("cluster")).join(classes.select("rep", "set_key"), "rep")
    found = sets_of(nodes.select(F.col("rep").alias("doc_id")), docs, width).withColumnRenamed("doc_id", "rep")
    # the join also drops what the bit table let through, and of rows that repeat an id all but the one that decided its class
    nodes = nodes.join(found, ["rep", "set_key"]).drop("set_key")
    nodes = materialise(nodes.dropDuplicates(["rep"]) if repeated else nodes, "nodes")
    keyed, large = links_within(nodes, block)
    links = materialise(keyed.groupBy("large", "i").applyInArrow(lambda t: block_links(t, percent), "a long, b long"), "links")
    comp = components(links)
    if large.head(1):
        wide = nodes.join(large.select("cluster"), "cluster").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        wide = materialise(wide, "wide")
        more = materialise(cross_links(meetings(wide, block), percent, block), "links")
        comp = components(links.union(more)) if more.head(1) else comp
    class_of = classes.select("set_key", "rep").join(comp, classes.rep == comp.node, "left").select("set_key", F.coalesce("comp", "rep").alias("component_id"))
    ids = sk.select("doc_id", "set_key", "n_shingles").join(one.withColumnsRenamed({"set_key": "own_key", "doc_id": "own_id"}), F.col("doc_id") == F.col("own_id"), "left").withColumn("set_key", F.col("own_key"))
    out = ids.join(class_of, "set_key", "left")
    where = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", where.alias("component_id"), F.col("doc_id").eqNullSafe(where).alias("kept"))

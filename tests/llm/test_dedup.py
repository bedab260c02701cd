import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.llm import exact_dedup, line_dedup, near_dedup
from driftloom.llm.common import ascii_lower

KIND = "doc_id long, text string, keep_id long, n_lines int, tag string, rep string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6, "clash", "clash") for i, t in rows], KIND).repartition(3)


def low(s):
    return (s or "").encode().lower().decode()


EXACT = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 50_000), (8, "X" * 50_000), (8, "X" * 50_000), (None, "ab"), (None, "alone"), (9, "c"), (9, "d")]


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_128, lambda t: F.encode(F.substring(t, 1, 1), "utf-8"), lambda t: F.encode(F.lit("same"), "utf-8")])
def test_exact_groups_whatever_the_hash(spark, content_hash):
    groups = defaultdict(list)
    for i, t in EXACT:
        groups[low(t)].append(i)
    want = sorted((repr(i), repr(max((x for x in g if x is not None), default=None)), len(g), sha256(low(t).encode()).hexdigest()) for i, t in EXACT for g in [groups[low(t)]])
    got = exact_dedup.exact_groups(table(spark, EXACT), "largest", content_hash).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_empty_and_smallest(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    got = exact_dedup.exact_groups(table(spark, [(3, "a"), (2, "A"), (9, "b")]), "smallest").collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(3, 2), (2, 2), (9, 9)}


def test_ascii_lower(spark):
    s = "AbZ[ÉİKK"
    assert spark.createDataFrame([(s,), ("ABC",)], "t string").select(ascii_lower(F.col("t")).alias("t")).collect()[0].t == low(s)


def brute_lines(rows):
    own = defaultdict(set)
    key = lambda x: x.encode().strip().lower().decode()
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                own[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(own[key(x)] - {None}) and len(own[key(x)]) > 1 and i != min(own[key(x)] - {None}))]
        out.append((repr(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


LINES = [
    (4, "A long repeated line\nown words of four\n\nshort\n  a LONG repeated line\t"), (2, " a long repeated line \nshort\nshort"), (7, None), (8, ""), (9, "ééééééééé\nÉéééééééééé"), (3, "ééééééééé\nÉéééééééééé"),
    (None, "a long repeated line\nno id at all here"), (None, "no id at all here"), (11, "twice twice twice"), (11, "twice twice twice"), (12, "z\n" * 500 + "a long repeated line"), (13, "\x1fcontrol chars stay\x1f"), (14, "control chars stay"),
]


def test_line_dedup_equals_brute_force(spark):
    got = line_dedup.dedup_lines(table(spark, LINES), keys_per_shard=2).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(LINES)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_lines_at_random(spark):
    rnd = random.Random(3)
    pool = [f"line number {i % 40} of all" for i in range(60)] + ["tiny", ""]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(8)))) for i in range(150)]
    got = line_dedup.dedup_lines(table(spark, rows), keys_per_shard=50).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(rows)


def test_pipeline_form_keeps_columns(spark):
    df = spark.createDataFrame([(1, "the same line here\nb", "en", "s", 20), (2, "the same line here\nc", None, "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    out = line_dedup.without_repeated_lines(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "the same line here\nb", "en", "s", 20), (2, "c", None, "s", 1)]


def test_index_has_the_owners(spark):
    refs = line_dedup.line_refs(table(spark, LINES))
    index = line_dedup.update_shards(None, refs.filter("doc_id < 9"), 1, 3)
    index = line_dedup.update_shards(index, refs.filter("doc_id >= 9 OR doc_id IS NULL"), 1, 3)
    plain = lambda df: sorted((bytes(r.key), r.n_docs, r.owner) for r in df.filter("owner IS NOT NULL").collect())
    assert plain(line_dedup.indexed_keys(index)) == plain(line_dedup.repeated_keys(refs)) != []


def test_lines_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the same line here\nb", 1, 2, 3, 4), (2, "the same line here\nc", 1, 2, 3, 4)], "doc_id long, text string, _tag int, _drops int, _d_id int, _d_tag int")
    out = line_dedup.without_repeated_lines(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "the same line here\nb", 1, 2, 3, 4), (2, "c", 1, 2, 3, 4)]


def test_cuckoo_shard_is_reversible():
    rnd, shard, counts = random.Random(1), line_dedup.Shard(16), defaultdict(int)
    keys = [rnd.randbytes(16) for _ in range(5000)]
    for _ in range(30_000):
        k = rnd.choice(keys)
        if rnd.random() < 0.6:
            shard.insert(k)
            counts[k] += 1
        elif counts[k]:
            shard.delete(k)
            counts[k] -= 1
    assert all(shard.count(k) == counts[k] for k in keys)
    assert all((k in shard.filter) for k in keys if counts[k])
    again = line_dedup.Shard.load(shard.dump())
    assert all(again.count(k) == counts[k] for k in keys)
    for k in keys:
        if counts[k]:
            shard.delete(k, counts[k])
    assert not shard.table and not any(shard.filter.cells)


def test_index_updates_are_reversible(spark):
    refs = line_dedup.line_refs(table(spark, LINES))
    more = line_dedup.line_refs(table(spark, [(20, "a long repeated line\nanother line here"), (21, "another line here")]))
    state = line_dedup.update_shards(None, refs, 1, 3)
    there = line_dedup.update_shards(state, more, 1, 3)
    back = line_dedup.update_shards(there, more, -1, 3)

    def counts(df):
        return {k: n for r in df.collect() for k, (n, _) in line_dedup.Shard.load(r.asDict()).table.items()}

    assert counts(back) == counts(state) != counts(there)


def brute_near(rows, width, percent):
    words = near_dedup.WordHashes()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        assert len(sets[i]) == len(near_dedup.shingle_set((t or "").encode(), width, words))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, n = [(900, None), (901, " \n"), (902, "one two"), (903, "ONE two"), (904, "one two three")], 0
    for size in (3, 8, 30, 120):
        base = [word() for _ in range(size * 3)]
        for _ in range(25):
            text = list(base)
            for _ in range(rnd.randrange(1 + size // 4)):
                text[rnd.randrange(len(text))] = word()
            rows.append((n, " ".join(text)))
            n += 1
            if rnd.random() < 0.3:
                base = text  # a chain: ends that are not alike but linked
    for _ in range(10):
        rows.append((n, " ".join(word() for _ in range(50))))
        n += 1
    rnd.shuffle(rows)
    want = brute_near(rows, 4, 80)
    got = near_dedup.near_groups(table(spark, rows), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block,table_of_ids", [(8, True), (8, False), (3, True)])
def test_near_groups_of_large_clusters(spark, monkeypatch, block, table_of_ids):
    """Clusters of many blocks: chains of small edits, so that most of a cluster is no direct link of most others."""
    rnd, rows = random.Random(block), []
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    for chain in range(3):
        words = list(base[:60]) + [f"c{chain}x{k}" for k in range(60)]
        for step in range(14):
            rows.append((chain * 100 + step, " ".join(words)))
            at = rnd.randrange(len(words) - 24)
            more = 4 if step % 5 != 4 else 22  # a larger edit breaks the chain, but the parts still share bands
            words[at : at + more] = [f"n{rnd.randrange(10**6)}" for _ in range(more)]
    sets = {i: frozenset(tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    if not table_of_ids:
        monkeypatch.setattr(near_dedup, "candidate_filter", lambda *a: None)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(table(spark, rows), block=block).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 3


def test_hubs_are_dealt_out(spark):
    star = [(0, i) for i in range(1, 400)] + [(500, 501), (501, 502), (502, 399)]
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(400), 500, 501, 502]}
    edges = spark.createDataFrame([(1000, i) for i in range(300)], "u long, v long")
    parts = near_dedup.with_least(edges, salts=16)
    assert parts.count() == 300 and {r.m for r in parts.collect()} == {0}


def test_near_edges_of_the_contract(spark):
    got = near_dedup.near_groups(table(spark, [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "A B C D E"), (None, None)])).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == [("5", 2, "5", True), ("5", 2, "5", True), ("7", 2, "5", False), ("None", 0, "None", True), ("None", 2, "None", True)]
    assert near_dedup.near_groups(table(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (300, 200)]
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90, 300: 200, 200: 200}


def test_rounds_of_components_broadcast_nothing(spark):
    """Salted rows of the least neighbours are eight times the edges, which Spark's estimate of the file doesn't know."""
    edges = near_dedup.materialise(spark.createDataFrame([(k + 1, k // 2) for k in range(2000)], "u long, v long"), "edges")
    plan = near_dedup.with_least(edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chained_clusters_meet_by_buckets(spark, monkeypatch):
    """A cluster that hangs together by neighbours alone: its rows grow with its documents, not with their square."""
    rnd, rows, sizes = random.Random(4), [], []
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    for step in range(160):
        rows.append((step, " ".join(words)))
        at = rnd.randrange(160)
        more = 4 if step % 10 == 9 else 34  # below the threshold, but neighbours share bands
        words[at : at + more] = [f"n{rnd.randrange(10**6)}" for _ in range(more)]
    meetings = near_dedup.meetings

    def seen(nodes, block):
        out = meetings(nodes, block)
        sizes.append((nodes.count(), nodes.groupBy("cluster").count().selectExpr("sum(count * ceil(count / 4))").first()[0], out.count()))
        return out

    monkeypatch.setattr(near_dedup, "meetings", seen)
    monkeypatch.setattr(near_dedup, "PAIRS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(table(spark, rows), 4, 80, block=4).collect()}
    assert got == brute_near(rows, 4, 80) and len({c for _, c in got.values()}) < 160
    assert sizes and all(out < whole / 2 for _, whole, out in sizes)


def test_blocks_whose_pairs_are_all_set_aside():
    """Sets of at least M shingles whose registers tell that they are far apart: no pair is left for the full sets."""
    sets = [near_dedup.mix(np.arange(1 + 10_000 * k, 2001 + 10_000 * k, dtype=np.uint64)) for k in range(3)]
    own = [np.sort(s).tobytes() for s in sets]
    block = {"rep": pa.array([1, 2, 3], pa.int64()), "own": pa.array(own, pa.binary()), "regs": pa.array([near_dedup.registers(s).tobytes() for s in sets], pa.binary())}
    assert near_dedup.block_links(pa.table(block), 80).num_rows == 0
    block |= {"role": pa.array([0, 1, 1], pa.int32()), "comp": pa.array([1, 2, 2], pa.int64())}
    assert near_dedup.block_links(pa.table(block), 80).num_rows == 0


def test_large_group_with_few_strays_meets_whole(spark):
    """A large component and a few strays that share many buckets with it: fewer rows at once than bucket by bucket."""
    regs = np.random.default_rng(5).integers(1000, 60_000, (63, near_dedup.M)).astype(np.uint16)
    for b in range(20):  # a band that seven of the component and a stray have
        regs[[*((3 * b + k) % 60 for k in range(7)), 60 + b % 3], near_dedup.ROWS * b : near_dedup.ROWS * (b + 1)] = b
    rows = [(k, 0, 0 if k < 60 else k, b"", regs[k].tobytes()) for k in range(63)]
    nodes = near_dedup.materialise(spark.createDataFrame(rows, "rep long, cluster long, comp long, own binary, regs binary"), "wide")
    assert near_dedup.meetings(nodes, 8).count() == len(rows)

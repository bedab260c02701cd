"""Similarity join, greedy matching, sweeps, bracket trees, commit graphs and line maps against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.operators import graph, linemaps, similar, sweeps


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("measure,hot", [("jaccard", 2000), ("jaccard", 5), ("dice", 5)])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, measure, hot):
    """hot 5: almost every posting list is cut into blocks."""
    monkeypatch.setattr(similar, "HOT", hot)
    rng = random.Random(1)
    rows = [(k % 2, k, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))]) for k in range(160)] + [(0, 900 + k, ["a", "b"]) for k in range(40)] + [(0, 999, None), (0, 998, [None, "a"])]
    sets = spark.createDataFrame(rows, "g int, id long, ts array<string>")
    pairs, members = similar.similar_pairs(sets, ["g"], "id", "ts", 0.6, measure)
    of = {(g, i): Counter(t for t in ts or [] if t) if measure == "dice" else Counter(set(t for t in ts or [] if t)) for g, i, ts in rows}
    rep = {}
    for (g, i), c in sorted(of.items()):
        if c:
            rep[g, i] = min(j for (h, j), d in of.items() if h == g and c == d)
    assert collected(members, "g", "id", "rep") == sorted(((g, i, r) for (g, i), r in rep.items()), key=repr)
    want = []
    for g, a in sorted({(g, r) for (g, _), r in rep.items()}):
        for h, b in sorted({(g, r) for (g, _), r in rep.items()}):
            if g == h and a < b:
                x, y = of[g, a], of[h, b]
                both = (x & y).total()
                value = both / (x | y).total() if measure == "jaccard" else 2 * both / (x.total() + y.total())
                if value >= 0.6:
                    want.append((g, a, b, both))
    assert collected(pairs, "g", "a", "b", "overlap") == sorted(want, key=repr) and want


def test_similar_pairs_of_two_sides(spark):
    rows = [(True, "d1", list("aabc")), (True, "d2", list("xyz")), (False, "i1", list("aabc")), (False, "i2", list("abcd")), (False, "i3", list("q"))]
    pairs, _ = similar.similar_pairs(spark.createDataFrame(rows, "mine boolean, id string, ts array<string>"), [], "id", "ts", 0.75, "dice", "mine")
    assert [(r.a, r.b, r.similarity) for r in pairs.orderBy("b").collect()] == [("d1", "i1", 1.0), ("d1", "i2", 0.75)]


def one_after_the_other(rows):
    used_a, used_b, out = set(), set(), []
    for s, _, g, a, b in sorted((-s, h, g, a, b) for g, a, b, s, h in rows if a is not None and b is not None):
        if (g, a) not in used_a and (g, b) not in used_b:
            used_a.add((g, a))
            used_b.add((g, b))
            out.append((g, a, b, -s))
    return sorted(out, key=repr)


def test_greedy_matching_equals_the_sequential_rule(spark, monkeypatch):
    rng, rounds = random.Random(2), []
    rows = [(k % 3, rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 9)) for k in range(1500)]
    rows += rows[:50] + [(0, None, 1, 99), (0, 1, None, 99)]
    was = similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda df, label: rounds.append(label) or was(df, label))
    # scores tie often; a hash decides between equals, so that these don't form chains
    df = spark.createDataFrame(rows, "g int, a int, b int, s int").withColumn("h", F.xxhash64("a", "b"))
    got = similar.greedy_matching(df, ["g"], "a", "b", [-F.col("s"), F.col("h")])
    assert collected(got, "g", "a", "b", "s") == one_after_the_other([tuple(r) for r in df.collect()])
    assert rounds.count("matched") <= 11  # log2 of 1500
    assert similar.greedy_matching(df.filter("a < 0"), ["g"], "a", "b", [-F.col("s")]).count() == 0


def test_two_deletions_and_two_insertions_that_are_all_alike(spark):
    rows = [("d1", "i1", 0.9), ("d1", "i2", 0.8), ("d2", "i1", 0.85), ("d2", "i2", 0.775)]
    got = similar.greedy_matching(spark.createDataFrame(rows, "d string, i string, r double"), [], "d", "i", [-F.col("r")])
    assert collected(got, "d", "i") == [("d1", "i1"), ("d2", "i2")]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_running_totals_and_last_values_over_blocks(spark, block):
    rng = random.Random(3)
    rows = [(k % 3, p, rng.choice([None, 1, 2, 3])) for k in range(3) for p in rng.sample(range(-50, 50), 30)]
    df = spark.createDataFrame(rows, "k int, p int, v int")
    got = sweeps.last_before(sweeps.running(df, ["k"], "p", ["v"], block), ["k"], "p", F.col("v"), "before", block)
    got = sweeps.last_before(got, ["k"], "p", F.col("v"), "after", block, backwards=True)
    want = []
    for k, p, v in rows:
        own = sorted((q, x) for j, q, x in rows if j == k)
        less, more = [x for q, x in own if q < p and x is not None], [x for q, x in own if q > p and x is not None]
        want.append((k, p, sum(x or 0 for q, x in own if q <= p), less[-1] if less else None, more[0] if more else None))
    assert collected(got, "k", "p", "v_total", "before", "after") == sorted(want, key=repr)


SPANS = [(1, 1, 10), (1, 8, 20), (1, 21, 25), (1, 40, 39), (1, None, 3), (2, 5, 5), (3, 1, 9), (4, 1, 3)]
CUTS = [(1, 4, 6), (1, 6, 7), (1, 15, 15), (1, 24, 99), (1, 9, 8), (2, 5, 5), (3, 3, 4), (3, 5, 6), (5, 1, 2)]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_difference_by_whole_places(spark, block):
    """Overlapping, touching, nested and empty spans and cuts; keys with cuts alone or none."""
    rng = random.Random(4)
    more = lambda n: [(k, s, s + rng.randint(-1, 9)) for k in range(10, 20) for s in rng.sample(range(100), n)]
    spans, cuts = SPANS + more(6), CUTS + more(8)
    frame = lambda rows: spark.createDataFrame(rows, "k int, s long, e long")
    got = sweeps.difference(frame(spans), frame(cuts), ["k"], "s", "e", block)
    points = defaultdict(set)
    for k, s, e in spans:
        points[k] |= set(range(s, e + 1)) if s is not None else set()
    for k, s, e in cuts:
        points[k] -= set(range(s, e + 1))
    want = []
    for k, ps in points.items():
        at, piece = 0, 0
        for p in sorted(ps):
            if p - 1 not in ps:
                end = p
                while end + 1 in ps:
                    end += 1
                want.append((k, p, end, piece, at))
                piece, at = piece + 1, at + end - p + 1
    assert collected(got, "k", "s", "e", "piece", "at") == sorted(want, key=repr)
    lines = spark.createDataFrame([(1, p) for p in range(30)] + [(1, 2), (9, 1)], "k int, p long")
    held = sweeps.owners(lines, got, ["k"], "p", "s", "e", ["piece"], block)
    spot = lambda k, p: next((x[3] for x in want if x[0] == k and x[1] <= p <= x[2]), None)
    assert collected(held, "k", "p", "piece") == sorted(((k, p, spot(k, p)) for k, p in [*((1, p) for p in range(30)), (1, 2), (9, 1)]), key=repr)


def tree(steps):
    """partner, parent, depth of each token, with a stack of its own."""
    partner, stack = {}, []
    for p, d in steps:
        if d == 1:
            stack.append(p)
        elif d == -1 and stack:
            partner[p] = stack.pop()
            partner[partner[p]] = p
    out, stack = [], []
    for p, d in steps:
        if d == -1 and p in partner:
            stack.pop()
        out.append((p, partner.get(p), stack[-1] if stack else None, len(stack)))
        if d == 1 and p in partner:
            stack.append(p)
    return out


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_bracket_tree_with_unmatched_ends(spark, block):
    rng = random.Random(5)
    rows = [(k, p, rng.choice([1, -1, 0, None] if k else [1, -1])) for k in range(6) for p in sorted(rng.sample(range(200), 60))]
    rows += [(7, p, 1) for p in range(5)] + [(8, p, -1) for p in range(5)]
    got = sweeps.bracket_tree(spark.createDataFrame(rows, "k int, p int, d int"), ["k"], "p", "d", block)
    want = [(k, *t) for k in range(9) for t in tree([(p, d) for j, p, d in rows if j == k])]
    assert collected(got, "k", "p", "partner", "parent", "depth") == sorted(want, key=repr)


def test_a_long_text_of_brackets_is_split_over_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("p"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("d"))
    got = sweeps.bracket_tree(rows, ["k"], "p", "d").cache()
    assert got.filter("depth = 0 AND parent IS NULL AND abs(partner - p) = 1").count() == 1_000_000
    assert len({r.n for r in sweeps.blocked(rows, F.col("p"), sweeps.BLOCK).groupBy("k", "_b").agg(F.count("*").alias("n")).filter("n > 65536").collect()}) == 0
    got.unpersist()


def ancestors(parents, c):
    out, open_ = set(), [c]
    while open_:
        x = open_.pop()
        if x in parents and x not in out:
            out.add(x)
            open_ += parents[x]
    return out


def test_merge_bases_and_ranges_on_random_graphs(spark):
    rng = random.Random(6)
    parents = {c: sorted(set(rng.sample(range(max(0, c - 8), c), min(c, rng.randint(0, 2))))) for c in range(40)}
    parents[39] = [38, 1000]  # a parent that isn't there
    asked = [(q, rng.randrange(40), rng.randrange(40)) for q in range(12)] + [(50, 7, 7), (51, None, 3), (52, 999, 5)]
    commits = spark.createDataFrame(list(parents.items()), "commit long, parents array<long>")
    queries = spark.createDataFrame(asked, "query int, base long, head long")
    gens = graph.generations(commits)
    for r in gens.collect():
        known = [p for p in parents[r.commit] if p in parents]
        assert r.gen == 0 if not known else r.gen > 0
    bases, range_ = [], []
    for q, b, h in asked:
        x, y = ancestors(parents, b), ancestors(parents, h)
        both = x & y
        bases += [(q, c) for c in both if not any(c != d and c in ancestors(parents, d) for d in both)]
        range_ += [(q, c) for c in y - x]
    assert collected(graph.merge_bases(queries, commits, gens), "query", "commit") == sorted(bases, key=repr)
    assert collected(graph.between(queries, commits, gens), "query", "commit") == sorted(range_, key=repr)


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.generations(spark.createDataFrame([(1, [2]), (2, [1]), (3, [])], "commit long, parents array<long>"))


def test_a_chain_of_a_thousand_commits_in_ten_rounds(spark, monkeypatch):
    labels, was = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: labels.append(label) or was(df, label))
    commits = spark.range(1000).select(F.col("id").alias("commit"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"))
    got = graph.first_parents(spark.createDataFrame([(999,), (5000,)], "head long"), commits)
    assert collected(got, "n", "commit") == sorted(((k, 999 - k) for k in range(1000)), key=repr)
    assert labels.count("jump") <= 11
    assert collected(graph.first_parents(spark.createDataFrame([(999,)], "head long"), commits, limit=3), "n", "commit") == [(0, 999), (1, 998), (2, 997)]


def test_line_origins_with_several_hunks_a_commit(spark):
    rng = random.Random(7)
    text, hunks, n_versions = [(0, k) for k in range(1, 31)], [], 37
    for n in range(1, n_versions + 1):
        at, out, new = 0, [], []
        for start in sorted(rng.sample(range(len(text) + 1), 3)):
            if start < at:
                continue
            new += text[at:start]
            gone = rng.randint(0, min(2, len(text) - start))
            put = rng.randint(0, 3)
            if gone or put:
                hunks.append((1, n, start + 1, gone, len(new) + 1, put))
            new += [(n, None)] * put
            at = start + gone
        new += text[at:]
        # a new line's number is where it stands in its own version
        text = [(v, i + 1 if l is None else l) for i, (v, l) in enumerate(new)]
        if not any(h[1] == n for h in hunks):
            hunks.append((1, n, 1, 0, 1, 0))
    frame = spark.createDataFrame(hunks, "f int, n int, old_start int, old_count int, new_start int, new_count int")
    lines = spark.createDataFrame([(1, n_versions, k + 1) for k in range(len(text))] + [(1, 0, 4), (1, None, 1)], "f int, v int, line int")
    got = linemaps.origins(lines, linemaps.pieces(frame, ["f"]), ["f"], "v", "line")
    want = [(n_versions, k + 1, v, l) for k, (v, l) in enumerate(text)] + [(0, 4, 0, 4), (None, 1, None, None)]
    assert collected(got, "v", "line", "born", "born_line") == sorted(want, key=repr)


def test_followed_names(spark):
    renames = spark.createDataFrame([(1, 2, "a", "b"), (1, 5, "b", "c"), (1, 6, "x", "b"), (2, 3, "q", "a")], "r int, n int, old string, new string")
    paths = spark.createDataFrame([(1, "c", 9), (1, "b", 9), (1, "b", 4), (1, "z", 9)], "r int, path string, n int")
    got = linemaps.followed(paths, renames, ["r"])
    assert collected(got, "path", "n", "step", "name", "since") == sorted([("c", 9, 0, "c", 5), ("c", 9, 1, "b", 2), ("c", 9, 2, "a", None), ("b", 9, 0, "b", 6), ("b", 9, 1, "x", None), ("b", 4, 0, "b", 2), ("b", 4, 1, "a", None), ("z", 9, 0, "z", None)], key=repr)


def test_lines_walk_and_climb_to_the_same_origins(spark, monkeypatch):
    """Blocks of any number of versions, composed maps, crowds of lines dealt out; short histories write few tables."""
    rng, labels, was = random.Random(9), [], linemaps.materialise
    monkeypatch.setattr(linemaps, "materialise", lambda df, label: labels.append(label) or was(df, label))
    hunks = [(r, f, n, p, rng.randint(0, 2), p, rng.randint(0, 3)) for r, f, last in (("a", 1, 30), ("a", 2, 9), ("b", 1, 17)) for n in range(1, last + 1) if n % 7 or f == 2 for p in [rng.randint(1, 20)]]
    steps = linemaps.pieces(spark.createDataFrame(hunks, "r string, f int, n int, old_start int, old_count int, new_start int, new_count int"), ["r", "f"])
    asked = [(r, f, v, k) for r, f, v in (("a", 1, 30), ("a", 1, 6), ("a", 2, 9), ("b", 1, 17), ("b", 1, 20), ("c", 1, 3)) for k in range(-1, 25)] + [(None, 1, 3, 4), ("a", None, 3, 4), ("a", 1, 30, 5)]
    lines = spark.createDataFrame(asked, "r string, f int, v int, line int")
    edits = {(h[0], h[1], h[2]): h[3:] for h in hunks}

    def origin(r, f, v, k):
        while v:
            if (r, f, v) not in edits:  # a version without a row has no map
                return v, k
            old, gone, new, put = edits[r, f, v]
            if k < 1 or new <= k < new + put:
                return v, k
            k, v = (k if k < new else k - put + gone), v - 1
        return v, k

    want = sorted(((r, f, v, k, *((None, None) if r is None or f is None else origin(r, f, v, k))) for r, f, v, k in asked), key=repr)
    for span, rounds, pack in ((256, 8, 200_000), (4, 100, 20), (4, 2, 200_000)):
        labels.clear()
        monkeypatch.setattr(linemaps, "PACK", pack)
        got = linemaps.origins(lines, steps, ["r", "f"], "v", "line", span, rounds)
        assert collected(got, "r", "f", "v", "line", "born", "born_line") == want, (span, rounds)
        assert len(labels) <= 5 or span == 4

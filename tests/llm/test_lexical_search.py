import math
import random
import re

import numpy as np
import pytest

from driftloom.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    rows = [(i, words(t)) for i, t in docs]
    rows = [(i, w) for i, w in rows if w]
    n, total = len(rows), sum(len(w) for _, w in rows)
    out = []
    for item, text in items:
        found = []
        for i, own in rows:
            score = 0
            for t in words(text):
                tf = own.count(t)
                if tf:
                    df = sum(t in w for _, w in rows)
                    m = 75 + 25 * len(own) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x", "clash") for i, t in docs], "doc_id long, text string, n int, terms string, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in ls.search(d, q, **how).collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    topics = [[f"w{t}x{k}" for k in range(12)] for t in range(6)]
    common = ["the", "of", "and"]
    return [(i, " ".join(rng.choice(common if rng.random() < 0.3 else topics[i % 6]) for _ in range(rng.randint(1, 25)))) for i in range(n)], topics


ODD = [(900, None), (901, ""), (902, " .,;"), (None, "w0x1 w0x2"), (903, "W0X1-w0x1_Ünï É"), (903, "W0X1-w0x1_Ünï É"), (904, "w1x1 " * 20_000), (905, "w0x1\x7fw0x2[w0x3")]


@pytest.mark.parametrize("how", [{}, {"block": 64, "leaf": 8, "sample": 100}, {"block": 40, "leaf": 5, "top": 3, "turn": 4}])
def test_search_against_brute_force(spark, how):
    docs, topics = corpus(300, 1)
    docs += [(1000 + i, t) for i, t in docs[:40]] + ODD  # copies: ties
    items = [(k, " ".join(topics[k % 6][k % 5 : k % 5 + 4]) + " the The") for k in range(8)] + [(8, None), (9, "nothing here"), (10, "Ünï É é"), (10, "w1x1 w1x1"), (None, "w2x3")]
    want = brute(docs, items, how.get("top", 20))
    assert not set(run(spark, docs, items, **how)) ^ set(want) and len(want) > 30


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, "a")]) == []


def postings(lists):
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([t for x in lists for t in x])


def test_bisection_brings_topics_together_and_routes_alike():
    rng = np.random.default_rng(2)
    topic = rng.integers(0, 4, 800)
    lists = [sorted(set((t * 50 + rng.integers(0, 50, 12)).tolist()) | {200, 201}) for t in topic]
    doc, terms = postings(lists)
    leaf, weights, limits = ls.bisected(doc, terms, 800, 2, learn=202)
    assert np.bincount(leaf).max() - np.bincount(leaf).min() <= 2
    purity = sum(np.bincount(topic[leaf == k]).max() for k in range(4)) / 800
    assert purity > 0.9
    assert (ls.routed(doc, terms, 800, 2, weights, limits) == leaf).mean() > 0.9


def test_clusters_that_cannot_reach_the_threshold_are_left_out():
    weight, known = np.array([5, 7]), {b"a": 0, b"b": 1}
    from collections import Counter

    q = ls.Items([1], [Counter({b"a": 2, b"b": 1})], known, weight)
    assert q.bounds(np.array([0, 1]), np.array([10, 3])).tolist() == [121]
    best = ls.Best(np.ones(1, np.int64), 2)
    best.add(np.zeros(3, int), np.array([9, 4, 7]), np.array([5, 5, 6]))
    assert best.rows[0][0].tolist() == [7, 4] and best.least[0] == 5

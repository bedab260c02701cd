import math
import random
import zlib
from collections import Counter
from contextlib import contextmanager, nullcontext

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import quality, suffix_tree_lm, toxicity

DOCS = "doc_id long, text string, score string, y int, held_out string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in rows], DOCS).repartition(3)


def fold(i, by):
    return zlib.crc32(("" if i is None else str(i)).encode()) % by


def prose(rnd, n=60):
    return " ".join(rnd.choice(["the", "of", "and", "tion", "ering", "onthe", "shea", "blen"]) for _ in range(n)) + "."


def test_quality_learns_and_holds_edges(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.6
        text = prose(rnd) if good else " ".join(w + rnd.choice(["%%%", "$$$"]) for w in prose(rnd).split())
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(None, "no id"), (900, None), (901, ""), (902, "x" * 200_000), (5, rows[5][1])]
    labels += [(None, 1), (7777, 0), (10, None), (11, labels[11][1])]
    got = quality.score_quality(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    truth = dict(labels[:400])
    held = [r for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(table(spark, [(1, "a")]), empty).collect()] == [0.5]
    assert quality.score_quality(table(spark, []), empty).count() == 0


def test_accepted_keeps_columns(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd) if i % 2 else "%%% $$$ " * 40, "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns and {r.doc_id % 2 for r in out.collect()} == {1}
    for sample in (20_000, 60):  # the sample's features alone give the model that all of them give
        kept = {r.doc_id for r in quality.accepted(docs, labels, sample_rows=sample).collect()}
        assert kept == {r.doc_id for r in quality.score_quality(docs, labels, sample_rows=sample).collect() if r.predicted}


def test_additive_tables_are_what_the_score_adds():
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction that no single feature shows
    model = quality.fit(x, y, rounds=60)
    total = model.intercept + sum(t[np.searchsorted(e, x[:, f], "right")] for f, (e, t) in enumerate(zip(model.edges, model.tables)))
    total = total + sum(t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")] for i, j, a, b, t in model.pairs)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))
    assert (0, 1) in {(i, j) for i, j, *_ in model.pairs} and ((model.score(x) > 0.5) == y).mean() > 0.9  # the coarse bins blur the axes


LM = [(i, t) for i, t in enumerate(["a b c a b c d", "A b c", "", None, "z", "é É", "a b c a b d", "new words here", "a\x1fb a b", "c b a " * 400, "p x y u " * 4, "q x y v " * 4, "m y w " * 8] * 6)] + [(None, "a b q"), (3, "a b c a")]


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def brute_tree(rows, least):
    """The same model in dictionaries: log10 probability of a text, and of one token behind a context."""
    texts = [tokens(t) for i, t in rows if fold(i, 7) != 2]
    c = Counter(w for t in texts for w in t)
    n, v = sum(c.values()), len(c)
    grams, states, memo = Counter(), {}, {}
    for t in texts:
        for k in range(1, 8):
            grams.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))

    def logp(context, x):
        """In the longest suffix of the context that is a state."""
        while context and context not in states:
            context = context[1:]
        if not context:
            return math.log((c[x] + 1) / (n + v + 1))
        explicit, mass = states[context]
        return explicit[x] if x in explicit else mass + logp(context[1:], x)

    for depth in range(1, 7):
        found = {}
        for g, m in grams.items():
            s, x = g[:-1], g[-1]
            if len(s) == depth and m >= least and (depth == 1 or s[1:] in states):
                found.setdefault(s, {})[x] = m
        level = {}
        for s, nexts in found.items():
            total = grams[s]
            below = {x: logp(s[1:], x) for x in nexts}
            gain = {x: m * (math.log((m - 0.5) / total) - below[x]) - 3 - 0.5 * math.log(total) for x, m in nexts.items()}
            good = [x for x in nexts if gain[x] > 0]
            mass = math.log(max(1e-12, 1 - sum((nexts[x] - 0.5) / total for x in good)) / max(1e-12, 1 - sum(math.exp(below[x]) for x in good)))
            if good and sum(gain[x] for x in good) + (total - sum(nexts[x] for x in good)) * mass > 0:
                level[s] = ({x: math.log((nexts[x] - 0.5) / total) for x in good}, mass)
        if not level:
            break
        states |= level
    return c, n, v, states, logp


def test_lm_equals_brute_force(spark):
    for least in (4, 2):
        c, n, v, states, logp = brute_tree(LM, least)
        assert max(map(len, states)) >= (3 if least == 2 else 1)
        want = sorted((repr(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6), round(sum(logp(tuple(tokens(t)[max(0, k - 8) : k]), w) for k, w in enumerate(tokens(t))) / math.log(10), 6)) for i, t in LM)
        for head, tables in ((1 << 20, True), (0, True), (2, False)):  # all in the tasks, all in the join, both
            with nullcontext() if tables else no_table():
                got = suffix_tree_lm.score_corpus(table(spark, LM), least=least, least_gain=0.0, head_rows=head).collect()
            assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
            assert all(r.train_tokens == n and r.held_out == (fold(r.doc_id, 7) == 2) and r.score < 0 for r in got)
        assert sum(r.score for r in got) > sum(r.base_score for r in got)


@contextmanager
def no_table():
    whole, suffix_tree_lm.bit_table = suffix_tree_lm.bit_table, lambda *a: None
    try:
        yield
    finally:
        suffix_tree_lm.bit_table = whole


def test_lm_states_are_distributions():
    c, n, v, states, logp = brute_tree(LM, 2)
    for s in [(), *states]:
        assert abs(sum(math.exp(logp(s, x)) for x in [*c, "unknown"]) - 1) < 1e-9


def test_lm_long_texts_go_in_pieces(spark):
    docs = [(100, "c b a d " * 60), *LM[:30], (101, "x y u m y w " * 50)]
    rows = table(spark, docs).withColumn("train", F.lit(True)).withColumn("row", F.monotonically_increasing_id())
    parts = suffix_tree_lm.chunks(rows.coalesce(1), piece=64, segment=100).collect()
    assert {r.lead for r in parts} == {0, suffix_tree_lm.LEAD} and len(parts) > 20
    got = [sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree_lm.score_corpus(table(spark, docs), least=2, **cut).collect()) for cut in ({}, {"piece": 64, "segment": 100})]
    assert got[0] == got[1]


def test_lm_empty(spark):
    assert suffix_tree_lm.score_corpus(table(spark, [])).count() == 0
    assert [r.n_known for r in suffix_tree_lm.score_corpus(table(spark, [(4, "only held out")])).collect() if fold(4, 7) == 2] in ([], [0])


def test_gru_gradients():
    rnd = np.random.default_rng(1)
    net = toxicity.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rnd.standard_normal((3, toxicity.T, toxicity.INPUT))
    mask = np.arange(toxicity.T)[None] < np.array([[toxicity.T], [5], [1]])
    y, w = np.array([1.0, 0, 1]), np.ones(3)
    grad, dx, _ = net.backward(y, w, x, mask)

    def loss():
        logit = net.run(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"], mask)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    for name in ("Wf", "Ub", "cf", "A", "a", "o", "bias"):
        flat, k = net.p[name].reshape(-1), 0
        old, h = flat[k], 1e-3
        flat[k] = old + h
        hi = loss()
        flat[k] = old - h
        lo = loss()
        flat[k] = old
        assert abs((hi - lo) / (2 * h) - np.asarray(grad[name]).reshape(-1)[k]) < 1e-3, name
    assert dx.shape == x.shape


def test_windows_cover_every_word():
    for n in range(300):
        starts = toxicity.window_starts(n)
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.T))}
        assert covered == set(range(n)) and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity_finds_planted_words(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words, bad = prose(rnd, 80).split(), i % 3 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["vexgrub", "vexgrubs", "snarlpit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (1003, (prose(rnd, 5000) + " vexgrubly snarlpit vexgrub " + prose(rnd, 300))), (None, "no id here")]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i, _ in labels if fold(i, 5) == 0]
    assert sum(got[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.95
    assert got[1003].predicted == 1 and got[1000].score == got[1001].score == got[1002].score < 0.5


def test_toxicity_learns_from_long_texts(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(150):
        words, bad = prose(rnd, 400).split(), i % 2 == 0
        if bad:
            for k in range(0, 400, 5):
                words[k] = rnd.choice(["vexgrub", "snarlpit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_bytes=600).collect()}
    held = [i for i, _ in labels if fold(i, 5) == 0]
    assert sum(got[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.9


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(table(spark, [(1, "a b")]), none).collect()] == [0.5]
    assert toxicity.score_toxicity(table(spark, []), none).count() == 0


def test_the_toxic_window_of_a_long_text_is_sent_wherever_it_stands(spark):
    filler = [" ".join(f"plain{k % 97}" for k in range(i, i + 400)) for i in range(30)]
    rows = [(k, (filler[k] if k % 2 else filler[k][: 90 * k] + " vile slur here " + filler[k][90 * k :]), 1 - k % 2) for k in range(30)] + [(90, "", 0), (91, None, 1)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int").fillna("", ["text"])
    got = {r.doc_id: bytes(r.text) for r in toxicity.sent_windows(sample, 600).collect()}
    assert len(got) == 32 and all(len(t) <= 600 for t in got.values()) and all(b"vile slur" in got[k] for k in range(0, 30, 2))
    whole = {r.doc_id: bytes(r.text).decode() for r in toxicity.sent_windows(sample, 10_000).collect()}
    assert whole == {k: t or "" for k, t, _ in rows}

import numpy as np
import pytest

from driftloom.llm import embedding_dedup as e
from driftloom.llm import whitening as w

KIND = "vec_id long, embedding array<float>, node string, cnt int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1, "clash") for i, v in rows], KIND).repartition(3)


def brute(rows, least=0.95):
    """Rows as vec_id, n_links, component_id, by comparing all pairs."""
    use = []
    for k, (i, v) in enumerate(rows):
        x = None if v is None or i is None or None in v else np.array(v, np.float32).astype(float)
        use.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for d in {len(x) for x in use if x is not None}:
        at = [k for k, x in enumerate(use) if x is not None and len(x) == d]
        x = np.array([use[k] for k in at])
        linked[np.ix_(at, at)] = x @ x.T >= least * np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    np.fill_diagonal(linked, False)
    comp = np.arange(n)
    while (new := np.minimum(comp, np.where(linked, comp, n).min(1, initial=n))).tolist() != comp.tolist():
        comp = new
    comp = comp.tolist()
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[comp[k]] = min(i, least_id.get(comp[k], i))
    return sorted((repr(i), int(linked[k].sum()), repr(None if i is None else least_id[comp[k]])) for k, (i, _) in enumerate(rows))


def check(spark, rows, **how):
    got = e.linked_groups(table(spark, rows), **how).collect()
    wrong = set(brute(rows)) ^ {(repr(r.vec_id), r.n_links, repr(r.component_id)) for r in got}
    assert len(got) == len(rows) and not sorted(wrong)[:10]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return got


def crowd(rng, n, d, base, noise):
    return base + noise * rng.normal(size=(n, d)) / np.sqrt(d)


def test_odd_rows(spark):
    """Nulls, zeros, entries that aren't numbers, lengths that differ, copies, ids that repeat or lack, extra columns."""
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, [1, 0]), (2, [2, 0]), (2, [2, 0]), (3, [0, 1]), (4, None), (5, [0, 0]), (6, [nan, 1]), (7, [inf, 1]), (8, [None, 1]), (9, []), (10, [1, 0, 0]), (11, [1, 0.1]), (None, [1, 0]), (12, [-1, 0]), (13, [1, -0.0]), (11, [0, 1])])
    assert e.linked_groups(table(spark, [])).count() == 0


def test_one_shard_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 16)), crowd(rng, 60, 16, base[0] / np.linalg.norm(base[0]), 0.3)])
    check(spark, list(zip((rng.permutation(1000)[: len(x)]).tolist(), x.tolist(), strict=True)))


@pytest.mark.parametrize("noise", [0.1, 0.22])
def test_many_shards_balls_and_doubtful_members(spark, noise):
    """Splits down to small shards; a crowd that is tight, and one that reaches over its ball's edge."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 12))
    hot = base[0] / np.linalg.norm(base[0])
    x = np.concatenate([base, base[:60] + 0.1 * rng.normal(size=(60, 12)), crowd(rng, 200, 12, hot, noise), base[5:6].repeat(30, 0)])
    got = check(spark, list(zip(range(len(x)), x.tolist(), strict=True)), cap=300, per_shard=30, sample=256, least_share=0.05)
    assert got[0].audit_recall == 1


def test_a_crowd_too_wide_for_a_ball(spark):
    """Its pairs are parted by shards of a tenth of it; what is found is true, and the audit measures what is not."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 12))
    x = np.concatenate([base, crowd(rng, 200, 12, base[0] / np.linalg.norm(base[0]), 0.33)])
    rows = list(zip(range(len(x)), x.tolist(), strict=True))
    got = {r.vec_id: r for r in e.linked_groups(table(spark, rows), cap=160, per_shard=16, sample=256, least_share=0.05).collect()}
    want = {int(i): n for i, n, _ in brute(rows)}
    found, true = sum(r.n_links for r in got.values()), sum(want.values())
    assert all(got[i].n_links <= n for i, n in want.items()) and got[0].audit_recall == found / true >= 0.9


def test_robust_pruning_keeps_every_node_reachable():
    x = e.unit(np.random.default_rng(3).normal(size=(700, 8)))
    adj = e.shard_graph(x)
    seen, front = {0}, [0]
    while front:
        front = [b for a in front for b in adj[a].tolist() if b >= 0 and b not in seen and not seen.add(b)]
    assert len(seen) == len(x) and adj.shape[1] <= 2 * e.DEGREE
    a, b = e.range_search(x, adj, np.full(len(x), np.arccos(0.9) / 2), e.medoids(x))
    want = {(i, j) for i, j in np.argwhere(x @ x.T >= 0.9).tolist()}
    assert len(want & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.99 * len(want)


def brute_whitened(vectors):
    """n, deviations and the covariance of what whitening reads, in whole numbers and by one full matrix."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    far = n * x - s
    return n, (far * far).sum(1), (far.T @ far).astype(float) / n**3, far.astype(float) / n


def test_whitened_against_full_decomposition(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 40)) * np.linspace(1, 3, 40)
    nan = float("nan")
    odd = [(900, None), (901, [None] + [1.0] * 39), (902, [nan] * 40), (903, [1.0, 2.0]), (904, [])]
    rows = [*zip(range(500), x.tolist(), strict=True), (7, x[7].tolist()), *odd]
    got = w.whitened(table(spark, rows)).toPandas()
    n, far, v, centred = brute_whitened([r for _, r in rows[:501]])
    assert len(got) == 501 * 32 and set(got.n) == {501} and got.identity_error.max() < 1e-10
    assert sorted(got[got.component == 1].deviation) == sorted(far.tolist())
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    for c in range(32):
        own = got[got.component == c + 1].sort_values(["vec_id", "whitened"])
        assert abs(own.explained.iloc[0] - e[c] / np.trace(v)) < 1e-12
        want = (centred @ u[:, c] / np.sqrt(e[c]))[np.argsort([i for i, _ in rows[:501]], kind="stable")]
        assert min(np.abs(own.whitened.to_numpy() - want).max(), np.abs(own.whitened.to_numpy() + want).max()) < 1e-8


def test_whitened_without_full_rank_or_rows(spark):
    assert w.whitened(table(spark, [])).count() == 0
    assert w.whitened(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    got = w.whitened(table(spark, [(k, [k, 2 * k, 0]) for k in range(10)])).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-10


@pytest.mark.parametrize("values", [np.ones(60), np.repeat([5.0, 1.0], [40, 20]), 0.5 ** np.arange(60), np.concatenate((np.ones(3), np.zeros(57))), np.concatenate((1e6 * 0.1 ** np.arange(20), np.full(40, 1e-16)))])
def test_lanczos_multiplicities_breakdown_and_decay(values):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    a = (q * values) @ q.T
    e, u, passes = w.leading(lambda b: a @ b, 60, 12, block=4)
    assert np.allclose(e, np.sort(values)[::-1][:12], rtol=1e-10, atol=1e-12 * values.max()) and np.allclose(u.T @ u, np.eye(12), atol=1e-10)
    assert np.linalg.norm(a @ u - u * e) <= 1e-10 * values.max() and passes <= 15


def test_lanczos_ends_before_the_whole_space():
    values = np.concatenate((np.linspace(100, 50, 8), np.full(392, 1.0)))
    q = np.linalg.qr(np.random.default_rng(6).normal(size=(400, 400)))[0]
    e, _, passes = w.leading(lambda b: (q * values) @ (q.T @ b), 400, 8, block=8)
    assert np.allclose(e, values[:8]) and passes < 20

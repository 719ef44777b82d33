"""Retention operators against values worked out with numpy from their published formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import linear as L
from evalloom.operators import relations
from evalloom.operators import retention as R

SIZE, N = 4, 12


def relation(spark, keys, values=None, layer=0):
    rows = [(layer, h, p, list(map(float, k)), list(map(float, (values if values is not None else keys)[h][p]))) for h, head in enumerate(keys) for p, k in enumerate(head)]
    return relations.with_length(spark.createDataFrame(rows, "layer int, head int, pos long, key array<double>, value array<double>"))


@pytest.fixture(scope="module")
def random_keys():
    return np.random.default_rng(4).normal(size=(2, N, SIZE))


def causal(keys, n, scale=0.5):
    """Weights of the last n queries (which are the keys themselves) over what they see."""
    out = np.zeros((len(keys), n, N))
    for h, head in enumerate(keys):
        for i, q in enumerate(range(N - n, N)):
            e = np.exp(scale * head[: q + 1] @ head[q])
            out[h, i, : q + 1] = e / e.sum()
    return out


def scores(df):
    out = np.zeros((2, N))
    for r in df.collect():
        out[r.head, r.pos] = r.score
    return out


@pytest.mark.parametrize("normalize", [True, False])
def test_finch_weighs_queries_by_their_positions(spark, random_keys, normalize):
    kv = relation(spark, random_keys)
    w = causal(random_keys, 3)
    want = (w * (np.arange(N - 3, N)[None, :, None] if normalize else 1)).mean(axis=1)[:, : N - 3]
    found = scores(R.finch(kv, relations.last_queries(kv, 3), 3, 0.5, normalize))
    assert np.allclose(found[:, : N - 3], want)
    assert np.allclose(found[:, N - 3 :], want.max())


def test_finch_by_chunks_keeps_the_best_of_each(spark, random_keys):
    kv = relation(spark, random_keys)
    q = relations.last_queries(kv, 2)
    s = scores(R.finch(kv, q, 2, 0.5))
    kept = {(r.head, r.pos) for r in R.finch_kept(kv, q, 0.5, 2, 0.5, chunk=5).collect()}
    want = {(h, a + p) for h in range(2) for a, b in ((0, 5), (5, 10), (10, 12)) for p in np.argsort(-np.round(s[h, a:b], 9), kind="stable")[: max(1, int((b - a) * 0.5))]}
    assert kept == want
    with pytest.raises(ValueError, match="longer"):
        R.finch_kept(kv, q, 0.5, 2, 0.5, chunk=4)
    moved = R.finch_kept(kv, q, 0.5, 2, 0.5, frequencies=[1.0, 0.5]).collect()
    assert sorted((r.head, r.new_pos) for r in moved) == [(h, p) for h in range(2) for p in range(6)]


def test_tova_looks_at_the_last_query_alone(spark, random_keys):
    kv = relation(spark, random_keys)
    want = causal(random_keys, 1)[:, 0].mean(axis=0)
    for n in (1, 4):
        found = scores(R.tova(kv, relations.last_queries(kv, n), 0.5))
        assert np.allclose(found[:, :-1], want[:-1]) and np.allclose(found[:, -1], want.max())


def test_lazy_layers_look_at_the_last_query_alone(spark, random_keys):
    kv = relation(spark, random_keys)
    w = causal(random_keys, 1)[:, 0]
    mass = w[:, [0, 1, *range(N - 1 - 3, N - 1)]].sum() / 2
    for threshold, lazy in ((mass - 1e-6, True), (mass + 1e-6, False)):
        kept = R.lazy_layers(kv, relations.last_queries(kv, 4), 0.5, threshold, 2, 3).count()
        assert (kept < 2 * N) == lazy


def test_pyramid_budgets(spark):
    pin = lambda layers, ratio, window, beta, n: [int(r.b) for r in spark.createDataFrame([(k, n) for k in range(layers)], "layer int, k_len int").orderBy("layer").select(R.pyramid_budgets(layers, ratio, window, beta).alias("b")).collect()]
    assert pin(2, 0.5, 64, 20.0, 1000) == [936, 64]
    assert pin(5, 0.5, 10, 2.0, 100) == [75, 62, 50, 38, 25]
    assert pin(4, 0.5, 64, 20.0, 100) == [50] * 4
    assert pin(6, 0.5, 64, 20.0, 1000) == [936, 762, 587, 413, 238, 64]
    assert pin(3, 0.75, 16, 8.0, 2048) == [960, 512, 64]


def test_pyramid_keeps_each_layers_budget(spark):
    rng = np.random.default_rng(1)
    kv = relations.with_length(relation(spark, rng.normal(size=(1, 100, SIZE))).drop("k_len").withColumn("layer", F.explode(F.array(*map(F.lit, range(5))))))
    kept = R.pyramidkv(kv, relations.last_queries(kv, 10), 0.5, 10, 0.5, 5, kernel=3, beta=2.0)
    assert [r["count"] for r in kept.groupBy("layer").count().orderBy("layer").collect()] == [75, 62, 50, 38, 25]


def test_shares_of_nothing_are_nothing(spark):
    keys = np.ones((1, 40, SIZE))
    kv = relation(spark, keys, np.zeros((1, 40, SIZE)))
    assert [r.score for r in R.cur(kv, window=8, sinks=2).orderBy("pos").collect()] == [1.0, 1.0] + [0.0] * 38
    flat = [r.score for r in R.lagkv(kv, SIZE, sinks=2, lag=8).orderBy("pos").collect()]
    assert flat[:2] == [1.0, 1.0] and all(math.isfinite(x) for x in flat)
    # All tokens of a block are alike, so they are ranked by their places.
    assert flat[2:10] == [k / 8 for k in range(8)]


def plain_walk(keys, values, draw, gamma, block, rounds):
    """The walk of one head by its definition, row after row: order and weights of what stays."""
    order, weight, n = np.arange(len(keys)), np.ones(len(keys)), len(keys)
    for t in range(rounds):
        signs = np.zeros(n)
        for b in range(0, n, block):
            at = np.arange(b, min(b + block, n))
            k = np.zeros((block, keys.shape[1]))
            k[: len(at)] = keys[order[at]]
            v = np.zeros((block, values.shape[1]))
            v[: len(at)] = values[order[at]] * weight[at, None]
            k = k - k.mean(axis=0)
            kernel = np.exp(k @ k.T / math.sqrt(keys.shape[1])) * (1e-8 + v @ v.T + 0.025)
            s = np.zeros(block)
            s[0] = 1
            for i in range(1, len(at)):
                s[i] = 2 * (draw(t, at[i]) < 0.5 - gamma * kernel[i] @ s) - 1
            signs[at] = s[: len(at)]
        half = n // 2
        firsts = [np.flatnonzero(np.cumsum(signs == x) == half) for x in (-1, 1)]
        c = max((int(f[0]) if len(f) else 0) for f in firsts)
        new = np.where(np.arange(n) > c, np.abs(signs), 2 * signs * (-1 if signs[c] == 1 else 1))
        stay = np.argsort(-new, kind="stable")[:half]
        order, weight, n = order[stay], weight[stay] * new[stay], half
    return order, weight


@pytest.mark.parametrize("ratio,rounds,gamma", [(0.5, 1, 4.0), (0.75, 2, 0.05)])
def test_balanced_halving_is_the_walk_by_definition(spark, ratio, rounds, gamma):
    rng = np.random.default_rng(3)
    keys, values = rng.normal(size=(2, 45, SIZE)), rng.normal(size=(2, 45, SIZE))
    kv = relation(spark, keys, values)
    drawn = {}
    for t in range(rounds):
        for r in spark.range(40).selectExpr("0 AS layer", "explode(array(0, 1)) AS head", "id AS _at").withColumn("u", L._uniform(42, t)).collect():
            drawn[t, r["head"], r["_at"]] = r.u
    found = {(r["head"], r.pos): r.value for r in L.balanced_halving(kv, ratio, 3, 4, 8, gamma).collect()}
    for h in range(2):
        order, weight = plain_walk(keys[h, 3:41], values[h, 3:41], lambda t, i, h=h: drawn[t, h, i], gamma, 8, rounds)
        want = {3 + int(p): values[h, 3 + p] * w / 2**rounds for p, w in zip(order, weight, strict=True)}
        want |= {p: values[h, p] for p in (*range(3), *range(41, 45))}
        got = {p: v for (head, p), v in found.items() if head == h}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[p], want[p]) for p in want)


def test_blocks_of_a_scorer_that_sees_its_neighbours(spark, random_keys):
    kv = relation(spark, random_keys)
    snap = lambda x: R.snapkv(x, relations.last_queries(x, 2), 2, 0.5, 3)
    kept = None
    for first in (0, 4, 8):
        new = kv.where(f"pos >= {first} and pos < {first + 4}").drop("k_len")
        seen = relations.with_length(new if kept is None else kept.unionByName(new))
        kept = R.retain(snap(seen), 0.5, F.lit(6)).drop("score", "k_len")
    assert {(r.head, r.pos) for r in R.in_blocks(kv, snap, 0.5, 4).collect()} == {(r.head, r.pos) for r in kept.collect()}
    assert R.in_blocks(kv, R.knorm, 0.5, 4).count() == 12


def test_projected_norms(spark, random_keys):
    from evalloom.operators import vectors as V

    kv = relation(spark, random_keys)
    g = V.gaussian(3, SIZE, 7)
    k2 = ((random_keys @ np.array(g).T) ** 2).sum(axis=2)
    want = k2 * k2 / (k2 * k2).sum(axis=1, keepdims=True)
    assert np.allclose(scores(R.cur(kv, None, 0, projection=g)), want)


def test_positions_of_a_relation(spark, random_keys):
    from evalloom.plans import compose

    kv = relation(spark, random_keys)
    found = {(r["head"], r.pos): r.key for r in compose.positioned(kv, "key", "pos", "linear_pi", 100.0, SIZE, 2.0).collect()}
    for (h, p), key in found.items():
        a = p / 2 * 100.0 ** (-2 * np.arange(2) / SIZE)
        x = random_keys[h, p]
        assert np.allclose(key, [*(x[:2] * np.cos(a) - x[2:] * np.sin(a)), *(x[2:] * np.cos(a) + x[:2] * np.sin(a))])
    scale = compose.positions("yarn", 100.0, SIZE, 4.0)[2]
    first = compose.positioned(kv, "key", "pos", "yarn", 100.0, SIZE, 4.0).where("pos = 0 and head = 1").first().key
    assert np.allclose(first, random_keys[1, 0] * scale)


def test_gates_keep_sinks_and_recent_positions(spark, random_keys):
    kv = relation(spark, random_keys).withColumn("hidden", F.col("key"))
    rng = np.random.default_rng(2)
    p = {(0, h): {"wq": rng.normal(size=(2, 3, SIZE)), "bq": np.zeros((2, 3)), "wk": rng.normal(size=(3, SIZE)), "nq": np.ones(3), "nk": np.ones(3), "base": rng.normal(size=(2, 3)), "b": np.zeros(2)} for h in range(2)}
    for r in L.gate_kept(kv, p, 0.5, sinks=2, share=0.25).groupBy("head").agg(F.sort_array(F.collect_list("pos")).alias("at")).collect():
        assert len(r.at) == 6 and {0, 1, 9, 10, 11} <= set(r.at)
    assert {x.pos for x in L.gate_kept(kv, p, 0.75, sinks=0, window=3, long=10).collect()} == {9, 10, 11}


def test_mlp_surrogate(spark, random_keys):
    kv = relation(spark, random_keys)
    rng = np.random.default_rng(6)
    first, second = rng.normal(size=(5, SIZE)), rng.normal(size=5)
    weights = spark.createDataFrame([(0, first.tolist(), second.tolist())], "layer int, first array<array<double>>, second array<double>")
    gelu = np.vectorize(lambda h: 0.5 * h * (1 + math.erf(h / math.sqrt(2))))
    assert np.allclose(scores(L.surrogate(kv, weights)), gelu(random_keys @ first.T) @ second)

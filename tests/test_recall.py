import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import chunked_attention as K
from evalloom.operators import linear as L
from evalloom.operators import relations

SIZE = 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 40
    keys, values = rng.standard_normal((2, n, SIZE)), rng.standard_normal((2, n, SIZE))
    rows = [(0, h, p, keys[h, p].tolist(), values[h, p].tolist()) for h in range(2) for p in range(n)]
    kv = relations.with_length(spark.createDataFrame(rows, "layer int, head int, pos long, key array<double>, value array<double>")).cache()
    return kv, kv.select("layer", "head", F.col("pos").alias("qpos"), F.col("key").alias("query")), keys, values


def turned(x, p):
    half = SIZE // 2
    a = p * 10000.0 ** (-2 * np.arange(half) / SIZE)
    return np.concatenate([x[:half] * np.cos(a) - x[half:] * np.sin(a), x[half:] * np.cos(a) + x[:half] * np.sin(a)])


def plain(keys, values, bounds, sinks, local, k, span, contiguous):
    out = {}
    for s, e, g in bounds:
        view = set(range(e))
        if K.recalls(e, g, sinks, local):
            low, high = sinks, e - local
            view = set(range(sinks)) | set(range(high, e))
            for h in range(2):
                for q in range(s, e):
                    best = sorted(range(low, high), key=lambda p: (-round(float(keys[h, q] @ keys[h, p]), 9), p))[:k]
                    view |= {min(max(p + o, low), high - 1) for p in best for o in range(-(span // 2), (span + 1) // 2)}
        view = sorted(view)
        for h in range(2):
            for q in range(s, e):
                moved = contiguous and K.recalls(e, g, sinks, local)
                at = len(view) - (e - q) if moved else q
                seen = [(i if moved else p, p) for i, p in enumerate(view) if p <= q]
                logits = np.array([turned(keys[h, q], at) @ turned(keys[h, p], i) for i, p in seen]) / math.sqrt(SIZE)
                w = np.exp(logits - logits.max())
                out[h, q] = (w / w.sum()) @ np.array([values[h, p] for _, p in seen])
    return out


@pytest.mark.parametrize("contiguous", [False, True])
def test_exact_recall_matches_a_plain_version(data, contiguous):
    kv, q, keys, values = data
    bounds = K.chunk_bounds(40, 7)
    found = K.exact_recall(q, kv, SIZE, bounds, 3, 9, 2, 3, contiguous=contiguous)
    want = plain(keys, values, bounds, 3, 9, 2, 3, contiguous)
    got = {(r.head, r.qpos): r.out for r in found.collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert np.allclose(got[key], want[key])


def test_full_attention_does_not_depend_on_chunks(data):
    kv, q, *_ = data
    a, b = (K.exact_recall(q, kv, SIZE, K.chunk_bounds(40, n), 3, 9, 2, 3, option="full_attn") for n in (5, 40))
    one, two = ({(r.head, r.qpos): r.out for r in x.collect()} for x in (a, b))
    assert all(np.allclose(one[key], two[key]) for key in one)


def test_schedules():
    bounds = K.chunk_bounds(1000, 256, 32, 256, aligned=True)
    assert bounds[0][0] == 0 and bounds[-1] == (999, 1000, True)
    assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert K.chunk_bounds(1, 5) == [(0, 1, True)] and K.chunk_bounds(5, 2) == [(0, 2, False), (2, 4, False), (4, 5, False)]
    assert K.aligned_local(32 + 256 + 128, 32, 256) == 128 and K.aligned_local(100, 8, 64) == 64
    assert not K.recalls(10, False, 5, 5) and not K.recalls(99, False, 5, 5, "generate_only")


def test_shrunk_hits_its_target(spark):
    seeds = spark.createDataFrame([(0, 5, 9), (0, 20, 5), (0, 40, 1), (1, 10, 1)], "layer int, pos long, times long")
    lengths = spark.createDataFrame([(0, 50), (1, 50)], "layer int, n int")
    found = K.shrunk(seeds, lengths, 12, 5).groupBy("layer").agg(F.collect_list("pos").alias("p")).collect()
    got = {r.layer: sorted(r.p) for r in found}
    assert got[0] == [3, 4, 5, 6, 7, 18, 19, 20, 21, 22, 48, 49]
    assert len(got[1]) == 12 and {8, 9, 10, 11, 12} <= set(got[1])
    assert sorted(r.pos for r in K.shrunk(seeds, lengths, 3, 9).where("layer = 0").collect()) == [4, 5, 6]


def test_gate(spark):
    rng = np.random.default_rng(1)
    p = {"wq": rng.standard_normal((2, 4, 6)), "bq": rng.standard_normal((2, 4)), "wk": rng.standard_normal((4, 6)), "nq": np.ones(4), "nk": np.ones(4), "base": rng.standard_normal((3, 4)), "b": rng.standard_normal(2)}
    x = rng.standard_normal((5, 6))
    kv = spark.createDataFrame([(0, 0, i, v.tolist()) for i, v in enumerate(x)], "layer int, head int, pos long, hidden array<double>")
    for r in L.gate(kv, {(0, 0): p}).collect():
        v = x[r.pos]
        unit = lambda a: a / np.sqrt((a**2).mean() + 1e-6)
        k, total = unit(p["wk"] @ v), 0.0
        for g in range(2):
            q = unit(p["wq"][g] @ v + p["bq"][g])
            logit = k @ q / 2 + p["b"][g]
            total += 1 / (1 + sum(math.exp(b @ q / 2 - logit) for b in p["base"]))
        assert r.score == pytest.approx(total / 2)

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.catalog.base import keys
from evalloom.operators import linear as L
from evalloom.operators import relations


@pytest.fixture(scope="module")
def kv(spark):
    return keys(spark, "/root/testdata/sf0.001").cache()


def matrix(kv, head):
    return np.array([r.key for r in kv.where(f"head = {head}").orderBy("pos").collect()])


def test_grams_and_ridge_leverage(kv):
    m = matrix(kv, 0)
    g = L.grams(kv, 64)
    assert np.allclose(g[0, 0], m.T @ m)
    out = L.quadratic(kv, L.inverses(g, 1e-2), "key", "tau")
    tau = [r.tau for r in out.where("head = 0").orderBy("pos").collect()]
    assert np.allclose(tau, ((m @ np.linalg.inv(m.T @ m + 1e-2 * np.eye(64))) * m).sum(axis=1))
    assert sum(tau) <= 64


def test_ends_stay_and_modes_differ(kv):
    q = relations.last_queries(kv, 10_000)
    for mode in ("additive", "multiplicative", "envelope", "fixed_envelope"):
        out = L.ridge(kv, q, 64, mode=mode, first=3, last=5)
        assert out.where("score >= 1e29").count() == kv.where("pos < 3 or pos >= k_len - 5").count()


def test_leverage_is_standardised(kv):
    r = L.leverage(kv, 64).agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s")).first()
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_halving_keeps_ends_and_halves_the_middle(kv):
    out = L.balanced_halving(kv, 0.5, 4, 4, 16)
    ends = "pos < 4 or pos >= k_len - 4"
    assert out.where(ends).count() == kv.where(ends).count()
    assert out.where(f"not ({ends})").count() <= kv.where(f"not ({ends})").count() / 2
    assert L.balanced_halving(kv.where("pos < 5").withColumn("k_len", F.lit(5)), 0.5, 4, 4, 16).count() == kv.where("pos < 5").count()


def test_jitter_gives_up_on_indefinite_matrices():
    with pytest.raises(ValueError, match="positive definite"):
        L.jittered({(0, 0): -1e6 * np.eye(2)})


def test_blend_rules(spark):
    tails = spark.createDataFrame([(0.0, 0.9, 0.1, 0.9), (0.5, 0.4, 0.3, 0.4), (1.0, 0.3, 0.5, 0.5)], "alpha double, ridge_tail double, query_tail double, risk double")
    assert L.chosen_blend(tails, "tail_risk") == 0.5
    assert L.chosen_blend(tails, "query_constrained", slack=0.2) == 0.5
    assert L.chosen_blend(tails, "query_constrained", penalty=0.0) == 0.0
    with pytest.raises(ValueError):
        L.chosen_blend(tails, "other")


def test_weighted_envelope_boosts_queries_where_rankings_differ(kv):
    q = relations.last_queries(kv, 10_000)
    plain, boosted = ({(r["head"], r.pos): r.score for r in L.ridge(kv, q, 64, mode=m, first=3, last=5, ratio=0.5, boost=b).collect()} for m, b in (("envelope", 0.0), ("weighted_envelope", 0.0)))
    assert plain == pytest.approx(boosted)
    more = {(r["head"], r.pos): r.score for r in L.ridge(kv, q, 64, mode="weighted_envelope", first=3, last=5, ratio=0.5, boost=2.0).collect()}
    assert all(more[k] >= plain[k] - 1e-12 for k in plain) and any(more[k] > plain[k] * 1.0001 for k in plain)


def test_draws_follow_the_scores(spark):
    rows = spark.range(4000).selectExpr("0 AS layer", "cast(id div 4 as int) AS head", "id % 4 AS pos", "array(8.0D, 2.0D, 0.0D, 2.0D)[id % 4] AS score", "4 AS k_len")
    kept = {r.pos: r["count"] for r in L.drawn(rows, 0.75).groupBy("pos").count().collect()}
    assert sum(kept.values()) == 1000 and 2 not in kept and abs(kept[0] - 8000 / 12) < 60
    assert L.drawn(rows.withColumn("score", F.lit(0.0)), 0.5).count() == 2000
    assert L.drawn(rows.withColumn("score", F.when(F.col("pos") == 2, 1e30).otherwise(F.col("score"))), 0.75).where("pos <> 2").count() == 0


def test_gated_blend(spark):
    tails = spark.createDataFrame([(0.0, 0.9, 0.1, 0.9), (0.5, 0.4, 0.3, 0.4), (1.0, 0.3, 0.5, 0.5)], "alpha double, ridge_tail double, query_tail double, risk double")
    gate = lambda **k: L.chosen_blend(tails, "gated_query_constrained", slack=0.2, fallback=0.8, **k)
    assert gate(peak=5.0, least_peak=4.0, most_excess=0.7) == 0.5
    assert gate(peak=3.0, least_peak=4.0, most_excess=0.7) == gate(peak=5.0, least_peak=4.0, most_excess=0.5) == 0.8
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, 2.0), (0, 1, 2.0)], "layer int, head int, omega double")
    assert L.peakiness(rows) == 1.25

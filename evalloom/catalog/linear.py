"""Scorers with a matrix per head over the vectors table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as L
from ..operators import relations
from ..operators import retention as R
from .base import KEYS, dot, keys, norm, query
from .retention import D, _out

C = F.col


def _all(s, d):
    kv = keys(s, d)
    return kv, relations.every_query(kv)


@query("kv_leverage")
def _(s, d):
    return _out(R.retain(L.leverage(keys(s, d), D), 0.5))


@query("kv_non_causal", f"""WITH {KEYS}, j AS (SELECT q.layer, q.head, q.pos AS qpos, k.pos, k.k_len, k.value, q.pos // 16 AS c, {dot('q.key', 'k.key')} AS l FROM kv q JOIN kv k ON q.layer = k.layer AND q.head = k.head AND q.pos // 16 = k.pos // 16),
p AS (SELECT *, CASE WHEN c = k_len // 16 THEN (c + 1) * 16 - k_len ELSE 0 END AS pad FROM j), t AS (SELECT *, greatest(max(l) OVER (PARTITION BY layer, head, qpos), CASE WHEN pad > 0 THEN 0 END) AS m FROM p),
w AS (SELECT *, exp(l - m) / (sum(exp(l - m)) OVER (PARTITION BY layer, head, qpos) + pad * exp(-m)) AS w FROM t), a AS (SELECT layer, head, pos, (sum(w) + max(pad) / 16.0::DOUBLE) * {norm('any_value(value)')} AS s FROM w GROUP BY layer, head, pos),
o AS (SELECT *, sum(s) OVER (PARTITION BY layer, head ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS p FROM a)
SELECT layer, head, pos, round((p - avg(p) OVER (PARTITION BY layer)) / greatest(stddev_samp(p) OVER (PARTITION BY layer), 1e-6::DOUBLE), 5) AS score FROM o""")
def _(s, d):
    kv, q = _all(s, d)
    return L.non_causal(kv, q, 16).select("layer", "head", "pos", F.round("score", 5).alias("score"))


@query("kv_compactor")
def _(s, d):
    kv, q = _all(s, d)
    return _out(R.retain(L.compactor(kv, q, D, 0.5, 16), 0.5))


@query("kv_ridge")
def _(s, d):
    kv, q = _all(s, d)
    return _out(R.retain(L.ridge(kv, q, D, last=8), 0.5))


@query("kv_balanced_halving")
def _(s, d):
    return L.balanced_halving(keys(s, d), 0.5, 4, 4, 16).select("layer", "head", "pos")


def _blend(s, d):
    kv = keys(s, d)
    total = lambda c: F.abs(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)) + 0.01
    norm2 = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return kv.select("layer", "head", "pos", "k_len", norm2("key").alias("tau"), total("key").alias("omega"), total("value").alias("omega_val"), (norm2("value") * (1 + C("pos") % 3)).alias("weight"))


_B = f"{KEYS}, r AS (SELECT layer, head, pos, k_len, {norm('key')} AS tau, abs(list_sum(key)) + 0.01::DOUBLE AS omega, abs(list_sum(value)) + 0.01::DOUBLE AS omega_val, {norm('value')} * (1 + pos % 3) AS weight FROM kv)"


@query("ridge_blend_tails", f"""WITH {_B}, p AS (SELECT *, tau / sum(tau) OVER (PARTITION BY layer, head) AS p, omega / sum(omega) OVER (PARTITION BY layer, head) AS q FROM r), a AS (SELECT *, unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS alpha FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY alpha, layer, head ORDER BY round((alpha * p + (1 - alpha) * q) * weight, 12) DESC, pos) <= floor(k_len * 0.5::DOUBLE) AS inn FROM a),
h AS (SELECT alpha, layer, head, greatest(1 - sum(tau * weight * inn::INT) / sum(tau * weight), 0) AS ridge, greatest(1 - sum(omega_val * weight * inn::INT) / sum(omega_val * weight), 0) AS query FROM s GROUP BY ALL)
SELECT alpha, round(avg(ridge), 6) AS ridge_tail, round(avg(query), 6) AS query_tail, round(avg(greatest(ridge, query)), 6) AS risk FROM h GROUP BY alpha""")
def _(s, d):
    return L.blend_tails(_blend(s, d), [0.0, 0.5, 1.0], 0.5).select("alpha", *(F.round(c, 6).alias(c) for c in ("ridge_tail", "query_tail", "risk")))


@query("ridge_blend_entropy", f"WITH {_B}, p AS (SELECT layer, head, omega / sum(omega) OVER (PARTITION BY layer, head) AS p FROM r), e AS (SELECT layer, head, sum(-p * ln(p)) / ln(count(*)) AS e FROM p GROUP BY ALL) SELECT round(0.2::DOUBLE + 0.6::DOUBLE * avg(e), 6) AS alpha FROM e")
def _(s, d):
    return L.entropy_blend(_blend(s, d), 0.2, 0.8).select(F.round("alpha", 6).alias("alpha"))

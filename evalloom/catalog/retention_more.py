"""Further retention operators over the vectors table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attention as A
from ..operators import relations
from ..operators import retention as R
from ..operators import vectors as V
from .base import KEYS, SCALE, dot, kept, keys, norm, query
from .retention import _FR, D, KNORM, _out, _all, _q, _rot, _w, weights

C = F.col


@query("kv_stored_expectation", _w(f"l AS (SELECT *, {dot('value', 'key')} * 0 + list_sum(key) / 8 + 2 * {dot('key', 'key')} / 128 AS l FROM kv), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY layer, head)) AS e FROM l), f AS (SELECT *, e / sum(e) OVER (PARTITION BY layer, head) * {norm('value')} AS sc FROM e), s AS (SELECT *, CASE WHEN pos < 4 THEN max(sc) OVER (PARTITION BY layer) ELSE sc END AS score FROM f)") + kept("s", 0.5))
def _(s, d):
    kv = keys(s, d)
    sigma = F.array(*(F.array(*(F.lit(2.0 if i == j else 0.0) for j in range(D))) for i in range(D)))
    stats = kv.select("layer", "head").distinct().withColumns({"mu": F.array(*[F.lit(1.0)] * D), "sigma": sigma})
    return _out(R.retain(R.stored_expectation(kv, stats, D), 0.5))


@query("kv_finch", _w(weights(8), "m AS (SELECT layer, head, pos, sum(w * qpos) / 8 AS a FROM w WHERE pos < k_len - 8 GROUP BY ALL), s AS (SELECT kv.*, coalesce(a, max(a) OVER (PARTITION BY layer)) AS score FROM kv LEFT JOIN m USING (layer, head, pos))") + kept("s", 0.5))
def _(s, d):
    kv, q = _q(s, d, 8)
    return _out(R.retain(R.finch(kv, q, 8, SCALE), 0.5))


@query("kv_finch_chunks", _w(weights(8), f"m AS (SELECT layer, head, pos, sum(w * qpos) / 8 AS a FROM w WHERE pos < k_len - 8 GROUP BY ALL), s AS (SELECT kv.*, coalesce(a, max(a) OVER (PARTITION BY layer)) AS score FROM kv LEFT JOIN m USING (layer, head, pos)), r AS (SELECT *, row_number() OVER (PARTITION BY layer, head, pos // 20 ORDER BY round(score, 9) DESC, pos) AS r FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY pos) - 1 AS new_pos FROM r WHERE r <= greatest(1, floor(least(20, k_len - pos // 20 * 20) * 0.5::DOUBLE)))") + f"SELECT layer, head, pos, new_pos, round(list_sum(list_transform({_rot('key', '(new_pos - pos)')}, lambda x, i: x * i)), 6) AS total FROM t")
def _(s, d):
    kv, q = _q(s, d, 8)
    out = R.finch_kept(kv, q, 0.5, 8, SCALE, chunk=20, frequencies=_FR)
    return out.select("layer", "head", "pos", "new_pos", F.round(V.total(F.transform("key", lambda x, i: x * (i + 1))), 6).alias("total"))


_V1 = "list_sum(list_transform(value, lambda x: abs(x)))"


@query("kv_critical_adaptive_mask", _w(KNORM, "a AS (SELECT * EXCLUDE (score), CASE WHEN row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) <= floor(floor(k_len * 0.5::DOUBLE) * 0.2::DOUBLE) THEN 1e30 ELSE score END AS score FROM s)", "b AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY round(score, 9) DESC, head, pos) <= (SELECT sum(floor(k_len * 0.5::DOUBLE)) FROM kv WHERE pos = 0) AS inn FROM a)", "c AS (SELECT *, sum(inn::INT) OVER (PARTITION BY layer, head) AS b, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS r FROM b)", f"e AS (SELECT * EXCLUDE (score), CASE WHEN r <= floor(b * 0.5::DOUBLE) THEN 1e30 ELSE (score + 1e-4::DOUBLE) * {_V1} END AS score FROM c)", "f AS (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS z FROM e)") + "SELECT layer, head, pos FROM f WHERE z > b")
def _(s, d):
    return R.critical_adaptive_mask(R.knorm(keys(s, d)), 0.5).select("layer", "head", "pos")


@query("kv_head_areas", f"WITH {KEYS}, u AS (SELECT layer, head, unnest(key) AS k, unnest(value) AS v, unnest(range(0, 64)) AS i FROM kv), m AS (SELECT layer, head, list(v ORDER BY i) AS q, list(k ORDER BY i) AS k FROM (SELECT layer, head, i, avg(k) AS k, avg(v) AS v FROM u GROUP BY ALL) GROUP BY ALL), p AS (SELECT layer, head, pos, {dot(_rot('q', '49'), _rot('k', 'pos'))} / 8 AS l FROM m, (SELECT unnest(range(0, 50)) AS pos)), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY layer, head)) AS e FROM p), c AS (SELECT layer, head, sum(e) OVER (PARTITION BY layer, head ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY layer, head) AS c FROM e) SELECT layer, head, round(avg(c), 6) AS head_score FROM c GROUP BY ALL")
def _(s, d):
    means = keys(s, d).groupBy("layer", "head").agg(V.mean_vector(C("value"), D).alias("query"), V.mean_vector(C("key"), D).alias("key"))
    return R.head_areas(means, _FR, 50).withColumn("head_score", F.round("head_score", 6))


_REREAD = f"""h AS (SELECT DISTINCT layer, head, pos // 10 AS c FROM kv), j AS (SELECT q.layer, q.head, q.pos AS qpos, k.pos, h.c, {dot('q.key', 'k.key')} * {SCALE!r}::DOUBLE AS l FROM kv q JOIN h ON q.layer = h.layer AND q.head = h.head AND q.pos >= h.c * 10 - 8 AND q.pos < h.c * 10 + 10 JOIN kv k ON k.layer = q.layer AND k.head = q.head AND (k.pos // 10 = h.c OR k.pos < 1)),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY layer, head, qpos, c)) AS e FROM j), w AS (SELECT *, e / sum(e) OVER (PARTITION BY layer, head, qpos, c) AS w FROM e), b AS (SELECT layer, head, pos, max(w) AS b FROM w WHERE pos // 10 = c GROUP BY ALL),
s AS (SELECT kv.*, CASE WHEN pos < 1 THEN 1e30 ELSE b END AS score FROM kv JOIN b USING (layer, head, pos))"""


@query("kv_reread_mask", _w(_REREAD) + "SELECT layer, head, pos FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9), layer, head, pos) AS low FROM s) WHERE low <= floor((SELECT count(*) FROM kv) * 0.4::DOUBLE)")
def _(s, d):
    kv = keys(s, d)
    return R.layer_counts_mask(R.reread(kv, relations.every_query(kv), SCALE, 10), 0.4).select("layer", "head", "pos")


@query("attention_masked", _w(weights(None), "x AS (SELECT *, list_sum(list_transform(value, lambda x, i: x * i)) AS vs FROM lg WHERE pos % 3 <> 1), y AS (SELECT *, max(l) OVER (PARTITION BY layer, head, qpos) AS m FROM x)") + "SELECT layer, head, qpos, round(ln(sum(exp(l - m))) + max(m), 6) AS lse, round(sum(exp(l - m) * vs) / sum(exp(l - m)), 6) AS out FROM y GROUP BY layer, head, qpos")
def _(s, d):
    kv, q = _all(s, d)
    out = A.attention(q, R.unmasked(kv, kv.where("pos % 3 = 1").select("layer", "head", "pos")), D)
    return out.select("layer", "head", "qpos", F.round("lse", 6).alias("lse"), F.round(V.total(F.transform("out", lambda x, i: x * (i + 1))), 6).alias("out"))

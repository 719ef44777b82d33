"""Retention and attention operators over the vectors table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attention as A
from ..operators import relations
from ..operators import retention as R
from ..operators import tiles
from ..operators import vectors as V
from .base import KEYS, SCALE, dot, kept, keys, norm, query

C = F.col
D = 64
HEAD = "layer, head"
SC = f"{SCALE!r}::DOUBLE"


def _out(df):
    return df.select("layer", "head", "pos", F.round("score", 6).alias("score"))


def _q(s, d, n):
    kv = keys(s, d)
    return kv, relations.last_queries(kv, n)


def _all(s, d):
    """Keys, and every one of them as a query."""
    kv = keys(s, d)
    return kv, relations.every_query(kv)


def _w(*ctes):
    return "WITH " + ", ".join([KEYS, *ctes]) + " "


KNORM = f"s AS (SELECT *, -{norm('key')} AS score FROM kv)"
#: Softmax weights of the last n queries, or of all, over what they see.
def weights(n: int | None, name: str = "w", causal: bool = True) -> str:
    see = "AND k.pos <= q.qpos" if causal else ""
    return f"""q AS (SELECT layer, head, pos AS qpos, key AS query FROM kv{"" if n is None else f" WHERE pos >= k_len - {n}"}),
    lg AS (SELECT k.layer, k.head, q.qpos, k.pos, k.k_len, k.value, {dot('q.query', 'k.key')} * {SC} AS l FROM q JOIN kv k ON q.layer = k.layer AND q.head = k.head {see}),
    ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY layer, head, qpos)) AS e FROM lg),
    {name} AS (SELECT *, e / sum(e) OVER (PARTITION BY layer, head, qpos) AS w FROM ex)"""  # fmt: skip


@query("kv_knorm", _w(KNORM) + kept("s", 0.4))
def _(s, d):
    return _out(R.retain(R.knorm(keys(s, d)), 0.4))


@query("kv_keydiff", _w(f"u AS (SELECT layer, head, unnest(list_transform(key, lambda x: x / {norm('key')})) AS x, unnest(range(1, 65)) AS i FROM kv)", "m AS (SELECT layer, head, list(a ORDER BY i) AS anchor FROM (SELECT layer, head, i, avg(x) AS a FROM u GROUP BY ALL) GROUP BY layer, head)", f"s AS (SELECT kv.*, -{dot('key', 'anchor')} / ({norm('key')} * {norm('anchor')}) AS score FROM kv JOIN m USING (layer, head))") + kept("s", 0.5))
def _(s, d):
    return _out(R.retain(R.keydiff(keys(s, d), D), 0.5))


@query("kv_random", _w("s AS (SELECT *, ('0x' || substr(md5('3:' || layer::VARCHAR || ':' || head::VARCHAR || ':' || pos::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296 AS score FROM kv)") + kept("s", 0.3))
def _(s, d):
    return _out(R.retain(R.random_scores(keys(s, d), 3), 0.3))


@query("kv_streaming", _w("s AS (SELECT *, CASE WHEN pos >= 4 AND pos < 4 + k_len - floor(k_len * 0.6::DOUBLE) THEN 0::DOUBLE ELSE 1::DOUBLE END AS score FROM kv)") + kept("s", 0.4))
def _(s, d):
    return _out(R.retain(R.streaming(keys(s, d), 0.4), 0.4))


@query("kv_qfilter", _w("f AS (SELECT layer, head, value AS filter FROM kv WHERE pos = 0)", f"s AS (SELECT kv.*, -{dot('filter', 'key')} AS score FROM kv JOIN f USING (layer, head))") + kept("s", 0.5))
def _(s, d):
    kv = keys(s, d)
    return _out(R.retain(R.qfilter(kv, kv.where("pos = 0").select("layer", "head", C("value").alias("filter"))), 0.5))


@query("kv_linear_surrogate", _w(f"s AS (SELECT *, {dot('key', 'list_transform(range(0, 64), lambda i: (i % 7)::DOUBLE - 3)')} + 0.5::DOUBLE AS score FROM kv)") + kept("s", 0.5))
def _(s, d):
    return _out(R.retain(R.linear_surrogate(keys(s, d), [float(i % 7 - 3) for i in range(D)], 0.5), 0.5))


CUR = f"""c0 AS (SELECT *, {dot('key', 'key')} AS k2, {dot('value', 'value')} AS v2 FROM kv), c1 AS (SELECT *, k2 / sum(k2) OVER b * (v2 / sum(v2) OVER b) AS p FROM c0 WINDOW b AS (PARTITION BY layer, head, pos // 16)),
s AS (SELECT *, CASE WHEN pos < 4 THEN 1::DOUBLE ELSE p / sum(p) OVER (PARTITION BY layer, head) END AS score FROM c1)"""


@query("kv_cur", _w(CUR) + kept("s", 0.5))
def _(s, d):
    return _out(R.retain(R.cur(keys(s, d)), 0.5))


def _lag(c):
    return f"""{c}u AS (SELECT layer, head, pos, b, unnest({c}) AS x, unnest(range(0, 64)) AS i FROM inn), {c}r AS (SELECT layer, head, b - 1 AS b, i, min(x) AS lo, max(x) AS hi FROM {c}u GROUP BY ALL),
    {c}s AS (SELECT layer, head, pos, b, stddev_samp((x - lo) / (hi - lo)) AS sd FROM {c}u JOIN {c}r USING (layer, head, b, i) GROUP BY ALL), {c}e AS (SELECT *, exp(sd - max(sd) OVER (PARTITION BY layer, head, b)) AS e FROM {c}s), {c}w AS (SELECT layer, head, pos, b, e / sum(e) OVER (PARTITION BY layer, head, b) AS w FROM {c}e)"""


@query("kv_lagkv", _w("inn AS (SELECT *, (pos - 4) // 8 AS b FROM kv WHERE pos >= 4 AND pos < 4 + (k_len - 4) // 8 * 8 AND k_len >= 20)", _lag("key"), _lag("value"), "r AS (SELECT k.layer, k.head, k.pos, (row_number() OVER (PARTITION BY k.layer, k.head, k.b ORDER BY round((k.w + v.w) / 2, 9), k.pos) - 1)::DOUBLE / 8 AS sc FROM keyw k JOIN valuew v USING (layer, head, pos))", "s AS (SELECT kv.*, CASE WHEN k_len < 20 THEN CASE WHEN pos < 4 THEN 1::DOUBLE ELSE (pos - 4)::DOUBLE / (k_len - 4) END ELSE coalesce(sc, 1::DOUBLE) END AS score FROM kv LEFT JOIN r USING (layer, head, pos))") + kept("s", 0.4))
def _(s, d):
    return _out(R.retain(R.lagkv(keys(s, d), D, lag=8), 0.4))


SNAP = "sm AS (SELECT layer, head, pos, sum(w) / 8 AS a FROM w WHERE pos < k_len - 8 GROUP BY ALL), sp AS (SELECT kv.*, CASE WHEN pos < k_len - 8 THEN sum(a) OVER (PARTITION BY layer, head, pos < k_len - 8 ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END AS p FROM kv LEFT JOIN sm USING (layer, head, pos)), s AS (SELECT *, coalesce(p, max(p) OVER (PARTITION BY layer)) AS score FROM sp)"


@query("kv_snapkv", _w(weights(8), SNAP) + kept("s", 0.5))
def _(s, d):
    kv, q = _q(s, d, 8)
    return _out(R.retain(R.snapkv(kv, q, 8, SCALE), 0.5))


_PYRAMID = """bu AS (SELECT *, k_len * 0.5::DOUBLE AS mean, k_len - 8 AS rest, 2 * (k_len * 0.5::DOUBLE) - k_len * 0.5::DOUBLE / 4 AS top FROM s),
bv AS (SELECT *, CASE WHEN top >= rest THEN rest ELSE top END AS high, CASE WHEN top >= rest THEN 2 * mean - rest ELSE mean / 4 END AS low FROM bu),
bw AS (SELECT *, round_even(CASE WHEN k_len >= high AND high >= low AND low >= 8 THEN high - layer * (high - low) / 2 ELSE mean END, 0) AS most, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM bv)"""


@query("kv_pyramid", _w(weights(8), SNAP, _PYRAMID).replace("SELECT 0 AS layer", "SELECT label % 3 AS layer") + "SELECT layer, head, pos, round(score, 6) AS score FROM bw WHERE rk <= most")
def _(s, d):
    kv = keys(s, d).withColumn("layer", C("head") % 3)
    return _out(R.pyramidkv(kv, relations.last_queries(kv, 8), 0.5, 8, SCALE, 3, beta=4.0))


@query("kv_tova", _w(weights(1), "tm AS (SELECT layer, pos, sum(w) / (SELECT count(DISTINCT head) FROM kv) AS a FROM w GROUP BY ALL), tj AS (SELECT kv.*, coalesce(a, 0) AS a FROM kv LEFT JOIN tm USING (layer, pos)), s AS (SELECT *, CASE WHEN pos = k_len - 1 THEN max(a) OVER (PARTITION BY layer) ELSE a END AS score FROM tj)") + kept("s", 0.5))
def _(s, d):
    kv, q = _q(s, d, 8)
    return _out(R.retain(R.tova(kv, q, SCALE), 0.5))


_MASS = "am AS (SELECT layer, head, pos, sum(w) AS a FROM w GROUP BY ALL), aj AS (SELECT kv.*, coalesce(a, 0) AS a FROM kv LEFT JOIN am USING (layer, head, pos))"


@query("kv_h2o", _w(weights(None), _MASS, "s AS (SELECT *, CASE WHEN pos >= k_len - 4 THEN max(a) OVER (PARTITION BY layer) ELSE a END AS score FROM aj)") + kept("s", 0.5))
def _(s, d):
    kv, q = _all(s, d)
    return _out(R.retain(R.h2o(kv, q, SCALE, 4), 0.5))


@query("kv_observed_attention", _w(weights(None), _MASS, "s AS (SELECT *, a / (k_len - pos) AS score FROM aj)") + kept("s", 0.5))
def _(s, d):
    kv, q = _all(s, d)
    return _out(R.retain(R.observed(kv, q, SCALE), 0.5))


@query("kv_recalled", _w(weights(4, causal=False), "rm AS (SELECT layer, head, pos, max(l) AS score FROM lg GROUP BY ALL), s AS (SELECT kv.*, score FROM kv JOIN rm USING (layer, head, pos))") + kept("s", 0.5))
def _(s, d):
    kv, q = _q(s, d, 4)
    return _out(R.retain(R.recalled(kv, q, SCALE), 0.5))


_MEAN = "qu AS (SELECT layer, head, pos, unnest(key) AS x, unnest(range(0, 64)) AS i FROM kv WHERE pos >= k_len - 8), mu AS (SELECT layer, head, list(a ORDER BY i) AS mu FROM (SELECT layer, head, i, avg(x) AS a FROM qu GROUP BY ALL) GROUP BY ALL)"


@query("kv_expected_attention", _w(_MEAN, f"cq AS (SELECT kv.layer, kv.head, list_transform(list_zip(key, mu), lambda z: z[1] - z[2]) AS c FROM kv JOIN mu USING (layer, head) WHERE pos >= k_len - 8), sp AS (SELECT k.layer, k.head, k.pos, avg(pow({dot('k.key', 'cq.c')}, 2)) AS qd FROM kv k JOIN cq ON k.layer = cq.layer AND k.head = cq.head GROUP BY ALL), el AS (SELECT kv.*, {dot('mu', 'key')} / 8 + qd / 128 AS l FROM kv JOIN mu USING (layer, head) JOIN sp USING (layer, head, pos)), ee AS (SELECT *, exp(l - max(l) OVER (PARTITION BY layer, head)) AS e FROM el), es AS (SELECT *, e / sum(e) OVER (PARTITION BY layer, head) * {norm('value')} AS sc FROM ee), s AS (SELECT *, CASE WHEN pos < 4 THEN max(sc) OVER (PARTITION BY layer) ELSE sc END AS score FROM es)") + kept("s", 0.5))
def _(s, d):
    kv, q = _q(s, d, 8)
    return _out(R.retain(R.expected_attention(kv, q, D), 0.5))


# Wrappers


@query("kv_chunk", _w(KNORM) + "SELECT layer, head, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY layer, head, pos // 10 ORDER BY round(score, 9) DESC, pos) AS rk, least(10, k_len - pos // 10 * 10) AS n FROM s) WHERE rk <= greatest(1, floor(n * 0.5::DOUBLE))")
def _(s, d):
    return _out(R.in_chunks(R.knorm(keys(s, d)), 0.5, 10))


@query("kv_chunkkv", _w("mx AS (SELECT max(k_len) AS m, greatest(1, floor(ceil(max(k_len) / 7.0) * 0.5)) AS n FROM kv)", f"cs AS (SELECT layer, pos, pos // 7 AS chunk, sum(-{norm('key')}) AS sc FROM kv GROUP BY ALL), cm AS (SELECT layer, chunk, avg(sc) AS mean FROM cs GROUP BY ALL), cc AS (SELECT layer, chunk, row_number() OVER (PARTITION BY layer ORDER BY round(mean, 9) DESC, chunk) <= (SELECT n FROM mx) AS whole FROM cm), ca AS (SELECT layer, pos, row_number() OVER (PARTITION BY layer ORDER BY whole DESC, CASE WHEN NOT whole THEN round(sc, 9) END DESC NULLS LAST, pos) AS place FROM cs JOIN cc USING (layer, chunk))") + f"SELECT layer, head, pos, round(-{norm('key')}, 6) AS score FROM kv WHERE pos IN (SELECT pos FROM ca WHERE place <= (SELECT least(n * 7, m) FROM mx))")
def _(s, d):
    return _out(R.whole_chunks(R.knorm(keys(s, d)), 0.5, 7))


@query("kv_block", _w(KNORM) + kept("s", 0.6))
def _(s, d):
    return _out(R.in_blocks(keys(s, d), R.knorm, 0.6, 16))


@query("kv_block_of_attention")
def _(s, d):
    kv = keys(s, d)
    # Attention of the last queries rates positions together, so blocks are scored one after another.
    return R.in_blocks(kv, lambda x: R.snapkv(x, relations.last_queries(x, 4), 4, SCALE), 0.5, max(16, 1 + kv.agg(F.max("k_len")).first()[0] // 3)).select("layer", "head", "pos")


@query("kv_composed", _w(KNORM, f"a AS (SELECT layer, head, pos, key, value, count(*) OVER (PARTITION BY layer, head) AS k_len FROM (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM s) WHERE rk <= floor(k_len * 0.7::DOUBLE)), b AS (SELECT *, {norm('value')} * {norm('key')} AS score FROM a)") + kept("b", 0.2))
def _(s, d):
    by_value = lambda kv: kv.withColumn("score", V.l2(C("value")) * V.l2(C("key")))
    run = R.composed(lambda kv: R.retain(R.knorm(kv), 0.3), lambda kv: R.retain(by_value(kv), 0.2))
    return _out(by_value(run(keys(s, d))))


@query("kv_per_layer", _w("kl AS (SELECT vec_id % 2 AS layer, head, row_number() OVER (PARTITION BY vec_id % 2, head ORDER BY vec_id) - 1 AS pos, key, value, count(*) OVER (PARTITION BY vec_id % 2, head) AS k_len FROM kv)", f"s AS (SELECT *, -{norm('key')} AS score FROM kl)") + "SELECT layer::INT AS layer, head, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM s) WHERE rk <= floor(k_len * CASE layer WHEN 0 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END)")
def _(s, d):
    from pyspark.sql.window import Window as W

    kv = keys(s, d).withColumn("layer", (C("vec_id") % 2).cast("int"))
    kv = relations.with_length(kv.withColumn("pos", F.row_number().over(W.partitionBy("layer", "head").orderBy("vec_id")) - 1).drop("k_len"))
    return _out(R.per_layer(R.knorm(kv), {0: 0.3, 1: 0.6}))


_V1 = "list_sum(list_transform(value, lambda x: abs(x)))"


@query("kv_critical", _w(KNORM, f"cr AS (SELECT * EXCLUDE (score), CASE WHEN row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) <= floor(0.5::DOUBLE * k_len * 0.5) THEN 1e30 ELSE (score + 1e-4::DOUBLE) * {_V1} END AS score FROM s)") + "SELECT layer, head, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM cr) WHERE rk <= floor(k_len * 0.5::DOUBLE)")
def _(s, d):
    return _out(R.retain(R.critical(R.knorm(keys(s, d)), 0.5), 0.5))


_ADA = "ad AS (SELECT * EXCLUDE (score), CASE WHEN row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) <= floor(floor(k_len * 0.5::DOUBLE) * 0.2::DOUBLE) THEN 1e30 ELSE score END AS score FROM s), al AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY round(score, 9), head DESC, pos DESC) AS low, sum(CASE WHEN pos = 0 THEN k_len - floor(k_len * 0.5::DOUBLE) END) OVER (PARTITION BY layer) AS n FROM ad)"


@query("kv_adaptive_mask", _w(KNORM, _ADA) + "SELECT layer, head, pos FROM al WHERE low <= n")
def _(s, d):
    return R.adaptive_mask(R.knorm(keys(s, d)), 0.5).select("layer", "head", "pos")


@query("kv_unmasked", _w(KNORM, _ADA) + "SELECT layer, head, pos FROM kv WHERE (layer, head, pos) NOT IN (SELECT (layer, head, pos) FROM al WHERE low <= n)")
def _(s, d):
    kv = keys(s, d)
    return R.unmasked(kv, R.adaptive_mask(R.knorm(kv), 0.5).select("layer", "head", "pos")).select("layer", "head", "pos")


@query("kv_threshold_mask", _w(KNORM) + "SELECT layer, head, pos FROM s WHERE pos < k_len - 10 AND score < -1.6::DOUBLE")
def _(s, d):
    return R.threshold_mask(R.knorm(keys(s, d)), -1.6, 10).select("layer", "head", "pos")


@query("kv_streaming_heads_mask", _w("hm AS (SELECT layer, head, avg(list_sum(key)) AS m FROM kv GROUP BY ALL), hs AS (SELECT layer, head, row_number() OVER (ORDER BY round(m, 9), layer, head) AS r FROM hm)") + "SELECT layer, head, pos FROM kv JOIN hs USING (layer, head) WHERE r <= floor((SELECT count(*) FROM hs) * 0.3::DOUBLE) AND pos >= 4 AND pos < k_len - 8")
def _(s, d):
    kv = keys(s, d)
    heads = kv.groupBy("layer", "head").agg(F.avg(V.total(C("key"))).alias("head_score"))
    return R.streaming_heads_mask(kv, heads, 0.3, 4, 8).select("layer", "head", "pos")


@query("kv_lowest_mask", _w(KNORM) + "SELECT layer, head, pos FROM (SELECT *, row_number() OVER (ORDER BY round(CASE WHEN pos < 1 THEN 1e30 ELSE score END, 9), layer, head, pos) AS low FROM s) WHERE low <= floor((SELECT count(*) FROM kv) * 0.4::DOUBLE)")
def _(s, d):
    return R.lowest_mask(R.knorm(keys(s, d)), 0.4).select("layer", "head", "pos")


@query("kv_lazy_layers", _w(weights(1), "lz AS (SELECT layer, sum(w) / (SELECT count(DISTINCT head) FROM kv) > 0.2 AS lazy FROM w WHERE pos < 4 OR (pos >= k_len - 11 AND pos < k_len - 1) GROUP BY layer)") + "SELECT layer, head, pos FROM kv JOIN lz USING (layer) WHERE NOT lazy OR pos < 4 OR pos >= k_len - 9")
def _(s, d):
    kv, q = _q(s, d, 5)
    return R.lazy_layers(kv, q, SCALE, 0.2, 4, 10).select("layer", "head", "pos")


@query("kv_pruned_channels", _w("tk AS (SELECT layer, head, pos, k_len, unnest(key) AS x, unnest(range(0, 64)) AS i FROM kv), tp AS (SELECT layer, head, i, avg(x * x) * (avg(x * x) FILTER (WHERE pos >= k_len - 8)) AS p FROM tk GROUP BY ALL), tr AS (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(p, 9), i) AS r FROM tp)") + "SELECT layer, head, pos, round(sum(CASE WHEN r > 19 THEN x * (i + 1) ELSE 0 END), 6) AS total FROM tk JOIN tr USING (layer, head, i) GROUP BY ALL")
def _(s, d):
    kv, q = _q(s, d, 8)
    out = R.pruned_channels(kv, q, 0.3, D)
    return out.select("layer", "head", "pos", F.round(V.total(F.transform("key", lambda x, i: x * (i + 1))), 6).alias("total"))


@query("kv_accounting", _w(KNORM, "k AS (SELECT layer, head, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM s) WHERE rk <= floor(k_len * 0.25::DOUBLE) GROUP BY ALL)") + "SELECT layer, (SELECT count(*) FROM kv) AS total, sum(n)::BIGINT AS kept, min(n) AS shortest, max(n) AS longest, sum(n)::DOUBLE / (SELECT count(*) FROM kv) AS share FROM k GROUP BY layer")
def _(s, d):
    kv = keys(s, d)
    return R.accounting(kv, R.retain(R.knorm(kv), 0.75))


_FR = A.inverse_frequencies(10000.0, D)
_FSQL = "[" + ", ".join(f"{f!r}::DOUBLE" for f in _FR) + "]"


def _rot(a: str, p: str, fr: str = _FSQL) -> str:
    z = f"list_zip({a}[1:32], {a}[33:64], {fr})"
    return f"list_concat(list_transform({z}, lambda z: z[1] * cos(z[3] * {p}) - z[2] * sin(z[3] * {p})), list_transform({z}, lambda z: z[2] * cos(z[3] * {p}) + z[1] * sin(z[3] * {p})))"


_SUM = "round(list_sum(list_transform({0}, lambda x, i: x * i)), 6)"


_FUTURE = 16


def _mean(f: str) -> str:
    return f"list_transform({_FSQL}, lambda f: list_avg(list_transform(range(k_len, k_len + {_FUTURE}), lambda p: {f}(f * p))))"


_TURNED = f"fu AS (SELECT *, {_mean('cos')} AS mc, {_mean('sin')} AS ms FROM kv), fk AS (SELECT *, list_concat(list_transform(range(1, 33), lambda i: key[i] * mc[i] + key[i + 32] * ms[i]), list_transform(range(1, 33), lambda i: key[i + 32] * mc[i] - key[i] * ms[i])) AS fkey FROM fu)"


@query("kv_expected_attention_ahead", _w(_MEAN, _TURNED, f"cq AS (SELECT kv.layer, kv.head, list_transform(list_zip(key, mu), lambda z: z[1] - z[2]) AS c FROM kv JOIN mu USING (layer, head) WHERE pos >= k_len - 8), sp AS (SELECT k.layer, k.head, k.pos, avg(pow({dot('k.fkey', 'cq.c')}, 2)) AS qd FROM fk k JOIN cq ON k.layer = cq.layer AND k.head = cq.head GROUP BY ALL), el AS (SELECT fk.*, {dot('mu', 'fkey')} / 8 + qd / 128 AS l FROM fk JOIN mu USING (layer, head) JOIN sp USING (layer, head, pos)), ee AS (SELECT *, exp(l - max(l) OVER (PARTITION BY layer, head)) AS e FROM el), es AS (SELECT *, e / sum(e) OVER (PARTITION BY layer, head) * {norm('value')} AS sc FROM ee), s AS (SELECT *, CASE WHEN pos < 4 THEN max(sc) OVER (PARTITION BY layer) ELSE sc END AS score FROM es)") + kept("s", 0.5))
def _(s, d):
    kv, q = _q(s, d, 8)
    return _out(R.retain(R.expected_attention(kv, q, D, frequencies=_FR, future=_FUTURE), 0.5))


@query("kv_rerotated", _w(KNORM, f"r AS (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY pos) - 1 AS new_pos FROM (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM s) WHERE rk <= floor(k_len * 0.5::DOUBLE)), t AS (SELECT layer, head, pos, new_pos, {_rot('key', '(new_pos - pos)')} AS k FROM r)") + f"SELECT layer, head, pos, new_pos, {_SUM.format('k')} AS total FROM t")
def _(s, d):
    out = R.rerotated(R.retain(R.knorm(keys(s, d)), 0.5), _FR)
    return out.select("layer", "head", "pos", "new_pos", F.round(V.total(F.transform("key", lambda x, i: x * (i + 1))), 6).alias("total"))


# Attention


def _att(df):
    return df.select("layer", "head", "qpos", F.round("lse", 6).alias("lse"), F.round(V.total(F.transform("out", lambda x, i: x * (i + 1))), 6).alias("out"))


_ATT = "SELECT layer, head, qpos, round(ln(sum(e0)) + max(mx), 6) AS lse, round(sum(w * vs), 6) AS out FROM (SELECT *, exp(l - max(l) OVER p) AS e0, max(l) OVER p AS mx, list_sum(list_transform(value, lambda x, i: x * i)) AS vs FROM w WINDOW p AS (PARTITION BY layer, head, qpos)) GROUP BY layer, head, qpos"


@query("attention_causal", _w(weights(None)) + _ATT)
def _(s, d):
    kv, q = _all(s, d)
    return _att(A.attention(q, kv, D))


@query("attention_merged", _w(weights(None)) + _ATT)
def _(s, d):
    kv, q = _all(s, d)
    parts = [A.attention(q, kv.where(C("pos") % 3 == k), D) for k in range(3)]
    return _att(A.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]), D))


@query("attention_grouped_heads", _w("q AS (SELECT layer, head AS q_head, head // 2 AS head, pos AS qpos, key AS query FROM kv)") + f"SELECT q.q_head, q.head, q.qpos, round(max({dot('q.query', 'k.key')}), 6) AS best FROM q JOIN kv k ON q.layer = k.layer AND q.head = k.head GROUP BY ALL")
def _(s, d):
    kv, q = _all(s, d)
    return tiles.top_keys(A.spread_heads(q, 2), kv, D, 1, 1.0, None).select("q_head", "head", "qpos", F.round("logit", 6).alias("best"))


@query("attention_top_keys", _w(weights(None)) + "SELECT layer, head, qpos, pos, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY layer, head, qpos ORDER BY round(l, 9) DESC, pos) AS rk FROM w) WHERE rk <= 4")
def _(s, d):
    kv, q = _all(s, d)
    return tiles.top_keys(q, kv, D, 4, SCALE).select("layer", "head", "qpos", "pos", "rank")


@query("attention_best_key", _w(weights(None)) + "SELECT layer, head, qpos, pos FROM w QUALIFY row_number() OVER (PARTITION BY layer, head, qpos ORDER BY round(l, 9) DESC, pos DESC) = 1")
def _(s, d):
    kv, q = _all(s, d)
    return tiles.top_keys(q, kv, D, 1, SCALE, latest=True).select("layer", "head", "qpos", "pos")


@query("attention_top_blocks", _w(weights(None)) + ", b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY layer, head, qpos, pos // 8 ORDER BY round(l, 9) DESC, pos) = 1) SELECT layer, head, qpos, pos FROM b QUALIFY row_number() OVER (PARTITION BY layer, head, qpos ORDER BY round(l, 9) DESC, pos) <= 4")
def _(s, d):
    kv, q = _all(s, d)
    return tiles.top_keys(q, kv, D, 4, SCALE, block=8).select("layer", "head", "qpos", "pos")


@query("rotary_apply", _w(f"t AS (SELECT layer, head, pos, {_rot('key', 'pos')} AS k FROM kv)") + f"SELECT layer, head, pos, {_SUM.format('k')} AS total FROM t")
def _(s, d):
    return keys(s, d).select("layer", "head", "pos", F.round(V.total(F.transform(A.rotated(C("key"), C("pos").cast("double"), _FR), lambda x, i: x * (i + 1))), 6).alias("total"))


@query("rotary_undo", _w() + f"SELECT layer, head, pos, {_SUM.format('key')} AS total FROM kv")
def _(s, d):
    p = C("pos").cast("double")
    back = A.rotated(A.rotated(C("key"), p, _FR), p, _FR, undo=True)
    return keys(s, d).select("layer", "head", "pos", F.round(V.total(F.transform(back, lambda x, i: x * (i + 1))), 6).alias("total"))


_NTK = A.inverse_frequencies(A.ntk_base(10000.0, 4.0, D), D)
_NSQL = "list_transform(range(0, 32), lambda i: pow(10000::DOUBLE * pow(4::DOUBLE, 64::DOUBLE / 62), -2 * i::DOUBLE / 64))"


@query("rotary_ntk_and_linear", _w(f"t AS (SELECT layer, head, pos, {_rot('key', 'pos', _NSQL)} AS k, {_rot('key', '(pos::DOUBLE / 4)')} AS l FROM kv)") + f"SELECT layer, head, pos, {_SUM.format('k')} AS ntk, {_SUM.format('l')} AS linear FROM t")
def _(s, d):
    p = C("pos").cast("double")
    total = lambda a: F.round(V.total(F.transform(a, lambda x, i: x * (i + 1))), 6)
    return keys(s, d).select("layer", "head", "pos", total(A.rotated(C("key"), p, _NTK)).alias("ntk"), total(A.rotated(C("key"), p / 4, _FR)).alias("linear"))


_YARN = """c AS (SELECT 64 * ln(2048::DOUBLE / (32 * 2 * pi())) / (2 * ln(10000::DOUBLE)) AS a, 64 * ln(2048::DOUBLE / (2 * pi())) / (2 * ln(10000::DOUBLE)) AS b),
r AS (SELECT i, pow(10000::DOUBLE, -2 * i::DOUBLE / 64) AS f, least(greatest((i - greatest(floor(a), 0)) / greatest(least(ceil(b), 63) - greatest(floor(a), 0), 0.001), 0), 1) AS ramp FROM range(0, 32) t(i), c),
fl AS (SELECT list(f / 4 * ramp + f * (1 - ramp) ORDER BY i) AS fr FROM r)"""


@query("rotary_yarn", _w(_YARN, f"t AS (SELECT layer, head, pos, {_rot('key', 'pos', 'fr')} AS k FROM kv, fl)") + f"SELECT layer, head, pos, {_SUM.format('k')} AS total, round(0.1::DOUBLE * ln(4::DOUBLE) + 1, 9) AS scale FROM t")
def _(s, d):
    """Keys rotated to their positions by the blended frequencies, and the scale of attention over them."""
    fr, scale = A.yarn(10000.0, D, 4.0, 2048)
    turned = A.rotated(C("key"), C("pos").cast("double"), fr)
    return keys(s, d).select("layer", "head", "pos", F.round(V.total(F.transform(turned, lambda x, i: x * (i + 1))), 6).alias("total"), F.lit(round(scale, 9)).alias("scale"))


@query("vector_quantize", _w("t AS (SELECT layer, head, pos, key, greatest(list_max(list_transform(key, lambda x: abs(x))), 1e-12::DOUBLE) / 127 AS s FROM kv)") + "SELECT layer, head, pos, round(s, 9) AS scale, list_sum(list_transform(key, lambda x, i: round_even(x / s, 0) * i))::BIGINT AS total FROM t")
def _(s, d):
    x = keys(s, d).withColumn("x", V.quantize(C("key")))
    return x.select("layer", "head", "pos", F.round("x.scale", 9).alias("scale"), F.aggregate(F.transform("x.q", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("vector_softmax_and_entropy", _w(weights(8)) + "SELECT layer, head, qpos, round(-sum(w * ln(w)), 6) AS entropy, round(max(w) / avg(w), 6) AS peak, round(sum(w), 9) AS total FROM w GROUP BY ALL")
def _(s, d):
    kv, q = _q(s, d, 8)
    w = R.window_attention(kv, q, SCALE)
    return w.groupBy("layer", "head", "qpos").agg(F.round(-F.sum(C("w") * F.log("w")), 6).alias("entropy"), F.round(F.max("w") / F.avg("w"), 6).alias("peak"), F.round(F.sum("w"), 9).alias("total"))


@query("window_top_p", _w(weights(4)) + "SELECT layer, head, qpos, pos FROM (SELECT *, sum(w) OVER (PARTITION BY layer, head, qpos ORDER BY round(w, 9) DESC, pos ROWS UNBOUNDED PRECEDING) - w AS before FROM w) WHERE round(before, 9) <= 0.5")
def _(s, d):
    from pyspark.sql.window import Window as W

    kv, q = _q(s, d, 4)
    order = W.partitionBy("layer", "head", "qpos").orderBy(F.round("w", 9).desc(), "pos").rowsBetween(W.unboundedPreceding, 0)
    return R.window_attention(kv, q, SCALE).withColumn("b", F.sum("w").over(order) - C("w")).where(F.round("b", 9) <= 0.5).select("layer", "head", "qpos", "pos")

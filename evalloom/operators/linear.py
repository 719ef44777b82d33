"""Scorers that need a small matrix per head: leverage, ridge, query metrics, balanced halving.

A head's Gram matrix is summed from one partial per Arrow batch, so positions are never gathered. The
matrices (heads x dimension squared) are bounded by the model's geometry, not by the data; they
are inverted on the driver and sent to the executors, after their size is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import attention as A
from . import vectors as V
from .relations import HEAD
from .retention import retain

C = F.col
#: Most matrix cells sent to executors (8 bytes each).
MOST_CELLS = 32_000_000
Matrices = dict[tuple[int, int], np.ndarray]


def grams(df: DataFrame, size: int, column: str = "key") -> Matrices:
    """Sum of outer products of the vectors of each (layer, head)."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            out = []
            for (layer, head), g in pdf.groupby(["layer", "head"]):
                m = np.stack(g["v"].to_list())
                out += [(layer, head, i, row) for i, row in enumerate((m.T @ m).tolist())]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["layer", "head", "i", "row"]).astype({"layer": "int32", "head": "int32", "i": "int32"}), preserve_index=False)

    rows = df.select(C("layer").cast("int").alias("layer"), C("head").cast("int").alias("head"), C(column).alias("v"))
    rows = rows.mapInArrow(partial, "layer int, head int, i int, row array<double>")
    sums = rows.groupBy(*HEAD, "i").agg(F.array(*(F.sum(F.get("row", F.lit(j))) for j in range(size))).alias("row"))
    heads = df.select(*HEAD).distinct().count()
    if heads * size * size > MOST_CELLS:
        raise ValueError(f"{heads} heads of dimension {size} are too many to hold their matrices")
    out: Matrices = {}
    for r in sums.collect():
        out.setdefault((r.layer, r.head), np.zeros((size, size)))[r.i] = r.row
    return out


def quadratic(df: DataFrame, matrices: Matrices, column: str, name: str) -> DataFrame:
    """Adds v' M v for the matrix of the row's head."""
    sent = df.sparkSession.sparkContext.broadcast(matrices)

    @F.pandas_udf(T.DoubleType())
    def form(layer: pd.Series, head: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        for key, at in pd.DataFrame({"l": layer, "h": head}).groupby(["l", "h"]).indices.items():
            m = np.stack(v.iloc[at].to_list())
            out[at] = ((m @ sent.value[key]) * m).sum(axis=1)
        return pd.Series(out)

    return df.withColumn(name, form(*(C(h) for h in HEAD), C(column)))


def inverses(matrices: Matrices, ridge: float) -> Matrices:
    """Inverses of M + ridge I, pseudo-inverses where that is singular."""
    out = {}
    for k, m in matrices.items():
        reg = m + ridge * np.eye(len(m))
        try:
            out[k] = np.linalg.inv(reg)
        except np.linalg.LinAlgError:
            out[k] = np.linalg.pinv(reg)
    return out


def jittered(matrices: Matrices, first: float = 1e-2, tries: int = 5, relative: bool = False) -> Matrices:
    """Inverses by Cholesky under a ladder of jitters, each ten times the last; with ``relative`` a
    second ladder in units of the mean diagonal."""
    out = {}
    for k, m in matrices.items():
        scales = [1.0, float(np.trace(m)) / len(m)] if relative else [1.0]
        for jitter in (first * 10**t * s for s in scales for t in range(tries)):
            try:
                half = np.linalg.inv(np.linalg.cholesky(m + jitter * np.eye(len(m))))
            except np.linalg.LinAlgError:
                continue
            out[k] = half.T @ half
            break
        else:
            raise ValueError(f"the matrix of head {k} is not positive definite")
    return out


def z_score(c: str) -> Column:
    """Over all heads of a layer, by the sample deviation."""
    w = W.partitionBy("layer")
    return (C(c) - F.avg(c).over(w)) / F.greatest(F.stddev_samp(c).over(w), F.lit(1e-6))


def leverage(kv: DataFrame, size: int, sketch: int = 48, seed: int = 42) -> DataFrame:
    """Leverage of the centred keys under a Gaussian sketch, as z-scores."""
    mean = kv.groupBy(*HEAD).agg(V.mean_vector(C("key"), size).alias("_m"))
    gauss = np.random.default_rng(seed).standard_normal((size, sketch)) / np.sqrt(sketch)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_list()) @ gauss)) if len(v) else pd.Series([], dtype=object)

    out = kv.join(mean, [*HEAD]).withColumn("_c", project(F.zip_with("key", "_m", lambda a, b: a - b)))
    out = quadratic(out, jittered(grams(out, sketch, "_c"), relative=True), "_c", "_l")
    return out.withColumn("_l", F.greatest("_l", F.lit(0.0))).withColumn("score", z_score("_l")).drop("_m", "_c", "_l")


def non_causal(kv: DataFrame, queries: DataFrame, chunk: int = 256) -> DataFrame:
    """Attention without a mask or scale inside chunks of positions, summed per key, times the value's
    norm, pooled over three positions, as z-scores. The last chunk is filled up with empty positions,
    whose logits are 0 for the queries and next to 0 for the keys, as padding leaves them."""
    q = queries.withColumn("_c", F.floor(C("qpos") / chunk))
    k = kv.withColumn("_c", F.floor(C("pos") / chunk))
    rows = q.join(k, [*HEAD, "_c"]).withColumn("logit", V.dot(C("query"), C("key")))
    padding = F.when(C("_c") == F.floor(C("k_len") / chunk), (C("_c") + 1) * chunk - C("k_len")).otherwise(0)
    w = W.partitionBy(*A.ROW)
    top = F.greatest(F.max("logit").over(w), F.when(padding > 0, 0.0))
    rows = rows.withColumn("_t", top).withColumn("_e", F.exp(C("logit") - C("_t")))
    rows = rows.withColumn("w", C("_e") / (F.sum("_e").over(w) + padding * F.exp(-C("_t"))))
    mass = rows.groupBy(*HEAD, "pos").agg((F.sum("w") + F.max(padding) / F.lit(float(chunk))).alias("_a"))
    out = kv.join(mass, [*HEAD, "pos"]).withColumn("_s", C("_a") * V.l2(C("value")))
    order = W.partitionBy(*HEAD).orderBy("pos").rowsBetween(-1, 1)
    return out.withColumn("_p", F.sum("_s").over(order) / 3).withColumn("score", z_score("_p")).drop("_a", "_s", "_p")


def compactor(kv: DataFrame, queries: DataFrame, size: int, blending: float, chunk: int = 256, first: int = 8, last: int = 4) -> DataFrame:
    """Blend of leverage and non-causal attention; both ends stay."""
    a = leverage(kv, size).select(*HEAD, "pos", C("score").alias("_l"))
    out = non_causal(kv, queries, chunk).join(a, [*HEAD, "pos"]).withColumn("_s", F.lit(blending) * C("_l") + C("score"))
    ends = (C("pos") < first) | (C("pos") >= C("k_len") - last)
    return out.withColumn("score", F.when(ends, F.max("_s").over(W.partitionBy("layer"))).otherwise(C("_s"))).drop("_l", "_s")


def ridge(kv: DataFrame, queries: DataFrame, size: int, lam: float = 1e-2, gamma: float = 1.0, mode: str = "fixed_envelope", alpha: float = 0.5, power: float = 1.0, first: int = 8, last: int = 64, ratio: float = 0.5, boost: float = 1.0) -> DataFrame:
    """Ridge leverage of the keys and their response to the queries, combined and weighted by the
    value's norm; both ends stay, whatever the budget.

    Modes: additive (alpha * p_ridge + (1 - alpha) * p_query), multiplicative
    (p_ridge^alpha * p_query^(1 - alpha)), envelope (the larger), fixed_envelope (the larger of p_ridge
    and gamma * p_query), weighted_envelope (the same with a gamma of 1 plus ``boost`` times the share in which
    the best by p_ridge and by p_query differ, of as many as ``ratio`` leaves between the ends). p are shares
    of the head's sum.
    """
    inner = kv.where((C("pos") >= first) & (C("pos") < C("k_len") - last))
    out = quadratic(inner, inverses(grams(inner, size), lam), "key", "_tau")
    counts = {(r.layer, r.head): r.n for r in queries.groupBy(*HEAD).agg(F.count("*").alias("n")).collect()}
    metric = {k: m / counts[k] for k, m in grams(queries, size, "query").items()}
    out = quadratic(out, metric, "key", "_omega").withColumns({"_tau": F.greatest("_tau", F.lit(1e-12)), "_omega": F.greatest(F.sqrt(F.greatest("_omega", F.lit(0.0))), F.lit(1e-12))})
    w = W.partitionBy(*HEAD)
    out = out.withColumns({"_p": C("_tau") / F.sum("_tau").over(w), "_q": C("_omega") / F.sum("_omega").over(w)})
    p, q = C("_p"), C("_q")
    if mode == "weighted_envelope":
        k = F.least(F.greatest(F.floor(C("k_len") * F.lit(1.0 - ratio)) - first - last, F.lit(1)), F.count("*").over(w))
        place = lambda c: F.row_number().over(W.partitionBy(*HEAD).orderBy(F.round(c, 12).desc(), "pos"))
        out = out.withColumns({"_k": k, "_rp": place("_p"), "_rq": place("_q")})
        shared = F.sum(((C("_rp") <= C("_k")) & (C("_rq") <= C("_k"))).cast("double")).over(w) / C("_k")
        out = out.withColumn("_g", 1 + boost * (1 - shared))
    both = {"additive": alpha * p + (1 - alpha) * q, "multiplicative": F.pow(p, F.lit(alpha)) * F.pow(q, F.lit(1 - alpha)), "envelope": F.greatest(p, q), "fixed_envelope": F.greatest(p, gamma * q), "weighted_envelope": F.greatest(p, F.col("_g") * q)}[mode]
    scores = out.withColumn("_s", both * F.pow(V.l2(C("value")), F.lit(power))).select(*HEAD, "pos", "_s")
    joined = kv.join(scores, [*HEAD, "pos"], "left")
    return joined.withColumn("score", F.coalesce("_s", F.lit(1e30))).drop("_s")


def _uniform(seed: int, turn: int) -> Column:
    """A number of [0, 1) for each row of a head's order."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{turn}"), "layer", "head", "_at"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def walked_signs(keys: np.ndarray, values: np.ndarray, draws: np.ndarray, block: int, gamma: float, temperature: float = 1.0, shift: float = 0.0) -> np.ndarray:
    """Signs of a self-balancing walk over one block of rows. The first is +1; a later one is +1 if its draw is
    below 1/2 - gamma * (signed sum of its kernel with those before it). Keys are centred as if the
    block were filled up with zeros."""
    centred = keys - keys.sum(axis=0) / block
    kernel = np.exp(temperature * centred @ centred.T / np.sqrt(keys.shape[1]) - shift) * (1e-8 + values @ values.T + 0.025)
    signs = np.zeros(len(keys))
    signs[:1] = 1
    for i in range(1, len(keys)):
        signs[i] = 1 if draws[i] < 0.5 - gamma * float(kernel[i, :i] @ signs[:i]) else -1
    return signs


def balanced_halving(kv: DataFrame, ratio: float, sinks: int = 32, recent: int = 32, block: int = 128, gamma: float = 4.0, temperature: float = 1.0, shift: float = 0.0, seed: int = 42) -> DataFrame:
    """Halves the middle positions of each head by self-balancing walks, so that those kept stand for
    those dropped; the values of survivors are scaled by their weights over 2^halvings.

    A round walks the blocks of a head's order, each a group of bounded size. Its signs give weights: with
    c the place at which the signs of either kind have reached half of the head (the later of both, 0 for a
    kind that never does), rows up to c weigh twice their sign, negated if the sign at c is +1, and
    rows behind c weigh 1. The half of the largest weights stays, in the order of weights, and
    weights multiply from round to round. A head with too few positions stays whole.
    """
    rounds = max(1, round(float(np.log2(1 / (1 - ratio))))) if ratio > 0 else 2
    long_enough = C("k_len") - sinks - recent >= 2**rounds
    middle = (C("pos") >= sinks) & (C("pos") < C("k_len") - recent) & long_enough
    rest = kv.where(~middle)
    now = kv.where(middle).withColumns({"_at": C("pos") - sinks, "_n": C("k_len") - sinks - recent, "_w": F.lit(1.0)})
    head, order = W.partitionBy(*HEAD), W.partitionBy(*HEAD).orderBy("_at")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    for turn in range(rounds):
        rows = now.withColumns({"_b": F.floor(C("_at") / block), "_u": _uniform(seed, turn)})

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_at")
            values = np.stack(pdf["value"].to_list()) * pdf["_w"].to_numpy()[:, None]
            pdf["_sign"] = walked_signs(np.stack(pdf["key"].to_list()), values, pdf["_u"].to_numpy(), block, gamma, temperature, shift)
            return pdf.drop(columns=["_b", "_u"])

        schema = T.StructType([*now.schema.fields, T.StructField("_sign", T.DoubleType())])
        signed = rows.groupBy(*HEAD, "_b").applyInPandas(walk, schema)
        half = F.floor(C("_n") / 2)
        signed = signed.withColumns({f"_{s}": F.sum(F.when(C("_sign") == v, 1).otherwise(0)).over(upto) for s, v in (("minus", -1), ("plus", 1))})
        firsts = [F.coalesce(F.min(F.when(C(c) == half, C("_at"))).over(head), F.lit(0)) for c in ("_minus", "_plus")]
        signed = signed.withColumn("_c", F.greatest(*firsts))
        at_c = F.max(F.when(C("_at") == C("_c"), C("_sign"))).over(head)
        weight = F.when(C("_at") > C("_c"), 1.0).otherwise(2 * C("_sign") * F.when(at_c == 1, -1).otherwise(1))
        signed = signed.withColumn("_new", weight)
        place = F.row_number().over(W.partitionBy(*HEAD).orderBy(C("_new").desc(), "_at")) - 1
        now = signed.withColumn("_at2", place).where(C("_at2") < half).withColumns({"_n": half, "_w": C("_w") * C("_new"), "_at": C("_at2")}).select(*now.columns)
    scaled = F.transform("value", lambda x: x * C("_w") / F.lit(2.0**rounds))
    return rest.unionByName(now.withColumn("value", scaled).drop("_at", "_n", "_w"))


@F.pandas_udf(T.DoubleType())
def _gelu_mlp(x: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    from math import erf

    out = []
    for v, a, b in zip(x, first, second, strict=True):
        hidden = np.stack(a) @ np.asarray(v)
        out.append(float(np.dot(b, [0.5 * h * (1 + erf(h / 2**0.5)) for h in hidden])))
    return pd.Series(out)


def surrogate(kv: DataFrame, weights: DataFrame) -> DataFrame:
    """A linear, GELU, linear score per layer: weights (layer, first array<array>, second array)."""
    return kv.join(weights, "layer").withColumn("score", _gelu_mlp("key", "first", "second")).drop("first", "second")


def gate(kv: DataFrame, parameters: dict[tuple[int, int], dict[str, np.ndarray]], column: str = "hidden") -> DataFrame:
    """Scores of a trained low-rank gate, averaged over the query group.

    parameters of each (layer, head): wq (group, rank, input), bq (group, rank), wk (rank, input), nq and
    nk (rank) norm weights, base (sink, rank), b (group). Their size is the model's, not the data's.
    """
    if sum(v.size for p in parameters.values() for v in p.values()) > MOST_CELLS:
        raise ValueError("the gates are too large to send")
    sent = kv.sparkSession.sparkContext.broadcast(parameters)

    def normed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x**2).mean(axis=-1, keepdims=True) + 1e-6) * w

    @F.pandas_udf(T.DoubleType())
    def score(layer: pd.Series, head: pd.Series, hidden: pd.Series) -> pd.Series:
        out = np.zeros(len(hidden))
        for key, at in pd.DataFrame({"l": layer, "h": head}).groupby(["l", "h"]).indices.items():
            p, x = sent.value[key], np.stack(hidden.iloc[at].to_list())
            q = normed(np.einsum("gri,ni->ngr", p["wq"], x) + p["bq"], p["nq"])
            k = normed(x @ p["wk"].T, p["nk"])
            rank = np.sqrt(k.shape[1])
            logit = np.einsum("nr,ngr->ng", k, q) / rank + p["b"]
            base = np.einsum("sr,ngr->nsg", p["base"], q) / rank
            out[at] = (1 / (1 + np.exp(base - logit[:, None, :]).sum(axis=1))).mean(axis=1)
        return pd.Series(out)

    return kv.withColumn("score", score(*(C(h) for h in HEAD), C(column)))


def gate_kept(kv: DataFrame, parameters: dict[tuple[int, int], dict[str, np.ndarray]], ratio: float, column: str = "hidden", sinks: int = 4, share: float = 0.02, window: int = 4096, long: int = 32_000) -> DataFrame:
    """What the gate's scores leave. Sinks and the recent window score 1, the most a gate gives: the whole part
    of ``share`` of the length, or ``window`` positions from ``long`` on."""
    recent = F.when(C("k_len") < long, F.floor(C("k_len") * F.lit(share))).otherwise(window)
    scored = gate(kv, parameters, column)
    always = (C("pos") < sinks) | (C("pos") >= C("k_len") - recent)
    return retain(scored.withColumn("score", F.when(always, 1.0).otherwise(C("score"))), ratio)


def blend_tails(rows: DataFrame, grid: list[float], ratio: float) -> DataFrame:
    """(alpha, ridge_tail, query_tail, risk) for each alpha: the share of ridge mass and of query mass
    that a selection by alpha * p_ridge + (1 - alpha) * p_query loses, averaged over heads; risk is
    the mean of the larger. rows: (layer, head, pos, k_len, tau, omega, omega_val, weight); omega scores,
    omega_val judges, so that queries can be split between the two.
    """
    w = W.partitionBy(*HEAD)
    p = rows.withColumns({"_p": C("tau") / F.sum("tau").over(w), "_q": C("omega") / F.sum("omega").over(w), "_t": C("tau") * C("weight"), "_o": C("omega_val") * C("weight")})
    p = p.withColumn("alpha", F.explode(F.array(*map(F.lit, grid)))).withColumn("_s", (C("alpha") * C("_p") + (1 - C("alpha")) * C("_q")) * C("weight"))
    place = F.row_number().over(W.partitionBy("alpha", *HEAD).orderBy(F.round("_s", 12).desc(), "pos"))
    p = p.withColumn("_in", (place <= F.floor(C("k_len") * F.lit(1.0 - ratio))).cast("double"))
    lost = lambda c: 1 - F.sum(C(c) * C("_in")) / F.sum(c)
    tails = p.groupBy("alpha", *HEAD).agg(F.greatest(lost("_t"), F.lit(0.0)).alias("ridge"), F.greatest(lost("_o"), F.lit(0.0)).alias("query"))
    return tails.groupBy("alpha").agg(F.avg("ridge").alias("ridge_tail"), F.avg("query").alias("query_tail"), F.avg(F.greatest("ridge", "query")).alias("risk"))


def peakiness(rows: DataFrame) -> float:
    """How far the largest query mass of a head stands out of its mean, on average over heads."""
    heads = rows.groupBy(*HEAD).agg((F.max("omega") / F.avg("omega")).alias("peak"))
    return heads.agg(F.avg("peak")).first()[0]


def drawn(scored: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Keeps a sample without replacement, positions drawn in proportion to their scores: the first to
    come when each waits for a time of that rate. A head whose scores are all 0 is drawn evenly."""
    digest = F.md5(F.concat_ws(":", F.lit(f"draw{seed}"), "layer", "head", "pos"))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    weight = F.greatest(C("score"), F.lit(0.0))
    even = F.max(weight).over(W.partitionBy(*HEAD)) <= 0
    # Scores of 1e30 and more, which keep a position, come first.
    wait = -F.log(u) / F.when(even, 1.0).otherwise(weight)
    place = F.row_number().over(W.partitionBy(*HEAD).orderBy(F.coalesce(F.when(~even & (weight <= 0), F.lit(float("inf"))).otherwise(wait), F.lit(float("inf"))), "pos"))
    return scored.withColumn("_r", place).where(C("_r") <= F.floor(C("k_len") * F.lit(1.0 - ratio))).drop("_r")


def chosen_blend(tails: DataFrame, rule: str, slack: float = 0.05, penalty: float = 10.0, peak: float = 0.0, least_peak: float = 0.0, most_excess: float = float("inf"), fallback: float = 0.5) -> float:
    """The alpha of least risk (``tail_risk``), or of least query tail plus a penalty on ridge tail
    beyond that of alpha 1 (``query_constrained``); the smaller alpha on a tie. A grid is small.

    ``gated_query_constrained`` uses the second rule only where queries stand out (``peak``, see ``peakiness``, is
    at least ``least_peak``) and alpha 0 loses at most ``most_excess`` more ridge mass than alpha 1; else
    it is ``fallback``."""
    rows = sorted(tails.collect())
    if rule == "tail_risk":
        return min(rows, key=lambda r: (round(r.risk, 12), r.alpha)).alpha
    if rule not in ("query_constrained", "gated_query_constrained"):
        raise ValueError(f"unknown rule {rule}")
    reference = next(r.ridge_tail for r in rows if r.alpha == 1.0)
    if rule == "gated_query_constrained":
        excess = next(r.ridge_tail for r in rows if r.alpha == 0.0) - reference
        if peak < least_peak or excess > most_excess:
            return fallback
    return min(rows, key=lambda r: (round(r.query_tail + penalty * max(0.0, r.ridge_tail - reference - slack), 12), r.alpha)).alpha


def entropy_blend(rows: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(alpha): from low where query mass is concentrated to high where it is spread evenly."""
    w = W.partitionBy(*HEAD)
    p = rows.withColumn("_p", C("omega") / F.sum("omega").over(w))
    heads = p.groupBy(*HEAD).agg((F.sum(-C("_p") * F.log("_p")) / F.log(F.count("*"))).alias("e"))
    return heads.agg(F.least(F.greatest(F.lit(low) + (high - low) * F.avg("e"), F.lit(low)), F.lit(high)).alias("alpha"))

"""Attention as joins and aggregates. Queries are (layer, head, qpos, query).

``attention`` works on tiles; ``logits`` and what follows it hold a row per pair, for windows of few queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import tiles
from . import vectors as V
from .relations import HEAD

ROW = (*HEAD, "qpos")


def spread_heads(queries: DataFrame, groups: int) -> DataFrame:
    """Queries of query heads under the key head they share: ``head`` becomes head div groups."""
    return queries.withColumns({"q_head": F.col("head"), "head": F.floor(F.col("head") / groups).cast("int")})


def logits(queries: DataFrame, kv: DataFrame, scale: float, offset: int | None = 0) -> DataFrame:
    """Scaled products of each query with the keys it may see (pos <= qpos + offset; None: all)."""
    joined = queries.join(kv, [*HEAD])
    if offset is not None:
        joined = joined.where(F.col("pos") <= F.col("qpos") + offset)
    return joined.withColumn("logit", V.dot(F.col("query"), F.col("key")) * scale).drop("query")


def softmax(df: DataFrame, by: tuple[str, ...] = ROW, c: str = "logit") -> DataFrame:
    """Adds w, the softmax of c over the rows that share ``by``, shifted by the maximum."""
    w = W.partitionBy(*by)
    out = df.withColumn("_e", F.exp(F.col(c) - F.max(c).over(w)))
    return out.withColumn("w", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def attend(rows: DataFrame, size: int, by: tuple[str, ...] = ROW) -> DataFrame:
    """Partial attention of rows (logit, value): output and log-sum-exp, in two aggregations that
    combine before the shuffle."""
    top = rows.groupBy(*by).agg(F.max("logit").alias("m"))
    shifted = rows.join(top, [*by]).withColumn("e", F.exp(F.col("logit") - F.col("m")))
    sums = shifted.groupBy(*by).agg(F.first("m").alias("m"), F.sum("e").alias("z"), V.weighted_sum(F.col("e"), F.col("value"), size).alias("o"))
    return sums.select(*by, V.scale(F.col("o"), 1 / F.col("z")).alias("out"), (F.col("m") + F.log("z")).alias("lse"))


def merge_partials(parts: DataFrame, size: int, by: tuple[str, ...] = ROW) -> DataFrame:
    """Combines (out, lse) over disjoint key sets with softmax weights of the lse."""
    return attend(parts.withColumnsRenamed({"lse": "logit", "out": "value"}), size, by)


def attention(queries: DataFrame, kv: DataFrame, size: int, scale: float | None = None, offset: int | None = 0) -> DataFrame:
    """Output and log-sum-exp of each query over the keys it may see, by tiles of both."""
    return tiles.attention(queries, kv, size, scale, offset)


def top_keys(rows: DataFrame, k: int) -> DataFrame:
    """The k best keys of each query, ties by position."""
    rank = F.row_number().over(W.partitionBy(*ROW).orderBy(F.round("logit", 9).desc(), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def best_key(rows: DataFrame) -> DataFrame:
    """The best key of each query, the later one on a tie."""
    return rows.groupBy(*ROW).agg(F.max_by("pos", F.struct(F.round("logit", 9).alias("l"), "pos")).alias("pos"))


def top_blocks(rows: DataFrame, k: int, block: int) -> DataFrame:
    """Approximate top k: only the best key of each block of positions competes."""
    within = W.partitionBy(*ROW, F.floor(F.col("pos") / block)).orderBy(F.round("logit", 9).desc(), "pos")
    return top_keys(rows.withColumn("_r", F.row_number().over(within)).where("_r = 1").drop("_r"), k)


# Rotary positions


def inverse_frequencies(base: float, dim: int) -> list[float]:
    return [base ** (-2 * i / dim) for i in range(dim // 2)]


def rotated(a: Column, position: Column, frequencies: list[float], undo: bool = False) -> Column:
    """a rotated to a position: pairs are (i, i + half)."""
    half = len(frequencies)
    angle = F.transform(F.array(*map(F.lit, frequencies)), lambda f: f * position)
    cos, sin = F.transform(angle, F.cos), F.transform(angle, lambda x: F.sin(x) * (-1.0 if undo else 1.0))
    low, high = F.slice(a, 1, half), F.slice(a, half + 1, half)
    mul = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    first = F.zip_with(mul(low, cos), mul(high, sin), lambda p, q: p - q)
    second = F.zip_with(mul(high, cos), mul(low, sin), lambda p, q: p + q)
    return F.concat(first, second)


def ntk_base(base: float, factor: float, dim: int) -> float:
    return base * factor ** (dim / (dim - 2))


def yarn(base: float, dim: int, factor: float, original: int, fast: float = 32.0, slow: float = 1.0) -> tuple[list[float], float]:
    """Frequencies blended between interpolation and extrapolation, and the attention scale."""
    at = lambda turns: dim * math.log(original / (turns * 2 * math.pi)) / (2 * math.log(base))
    low, high = max(math.floor(at(fast)), 0), min(math.ceil(at(slow)), dim - 1)
    out = []
    for i, f in enumerate(inverse_frequencies(base, dim)):
        ramp = min(max((i - low) / max(high - low, 1e-3), 0.0), 1.0)
        out.append(f / factor * ramp + f * (1 - ramp))
    return out, attention_scale(factor)


def attention_scale(factor: float, c: float = 0.1) -> float:
    return c * math.log(factor) + 1 if factor > 1 else 1.0


def recovered_base(frequencies: list[float]) -> tuple[float, int]:
    """(base, dim) of a list of inverse frequencies."""
    dim = 2 * len(frequencies)
    return frequencies[1] ** (-dim / 2), dim

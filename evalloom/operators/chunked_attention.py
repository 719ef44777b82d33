"""Dual-chunk attention and recall-based retention."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import attention as A
from . import tiles
from . import vectors as V
from .relations import HEAD

C = F.col


def _dual_rotated(queries: DataFrame, kv: DataFrame, size: int, chunk_size: int, local: int, base: float) -> tuple[DataFrame, DataFrame, int]:
    """Queries with their vectors for the own chunk, the one before and all older ones (q0, q1, q2), keys at their
    position inside the chunk, and the length of a chunk."""
    length = chunk_size - local
    fr = A.inverse_frequencies(base, size)
    inside = C("qpos") % length
    q = queries.withColumns({
        "q0": A.rotated(C("query"), inside.cast("double"), fr),
        "q1": A.rotated(C("query"), F.least(inside + length, F.lit(chunk_size)).cast("double"), fr),
        "q2": A.rotated(C("query"), F.lit(float(min(2 * length - 1, chunk_size))), fr),
    }).drop("query")
    return q, kv.withColumn("key", A.rotated(C("key"), (C("pos") % length).cast("double"), fr)), length


def dual_chunk(queries: DataFrame, kv: DataFrame, size: int, chunk_size: int, local: int, base: float = 10000.0) -> DataFrame:
    """Attention whose positions never exceed the chunk size.

    A query sees its own chunk causally, the chunk before and all older chunks as a whole, each under
    its own rotation of the query; keys are rotated to their position inside the chunk. One pass over tiles
    covers the three ranges, since they are disjoint and give one softmax.
    """
    q, k, length = _dual_rotated(queries, kv, size, chunk_size, local, base)
    q = q.withColumn("query", tiles.beside(C("q0"), C("q1"), C("q2"))).drop("q0", "q1", "q2")
    return tiles.attention(q, k, size, choice=lambda qpos, pos: np.clip(qpos // length - pos // length, 0, 2))


def dual_chunk_decode(queries: DataFrame, kv: DataFrame, size: int, chunk_size: int, local: int, base: float = 10000.0) -> DataFrame:
    """Attention of the last queries of a head, one or several, over a cache that ends with them.

    The three ranges go by the chunk in which the cache (of ``k_len`` positions) ends, for every query of the block, and
    their partial results are merged by the log-sum-exp. A query sees no later position.
    """
    q, k, length = _dual_rotated(queries, kv, size, chunk_size, local, base)
    back = F.least(F.floor((C("k_len") - 1) / length) - F.floor(C("pos") / length), F.lit(2))
    parts = [tiles.attention(q.withColumn("query", C(f"q{b}")).drop("q0", "q1", "q2"), k.where(back == b), size) for b in range(3)]
    return A.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]), size)


def attention_scale(length: int, pretrained: int, c: float = 0.1) -> float:
    return A.attention_scale(length / pretrained, c)


def recall_weighted(kv: DataFrame, kind: str) -> DataFrame:
    """Keys scaled by the value's norm: qk not at all, qkv by the sum of absolutes, qkv2 by length."""
    factor = {"qk": F.lit(1.0), "qkv": V.l1(C("value")), "qkv2": V.l2(C("value"))}[kind]
    return kv.withColumn("key", V.scale(C("key"), factor))


def recalled_positions(kv: DataFrame, queries: DataFrame, sinks: int, recent: int, k: int, span: int, clip: int = -1, kind: str = "qk") -> DataFrame:
    """(layer, pos) that stay: sinks, the recent positions, and spans about the middle positions that
    some query of some head has among its k best. Where heads of a layer differ in length, a position stays
    if it does for one of them."""
    lengths = kv.groupBy("layer").agg(F.max("k_len").alias("n"))
    middle = recall_weighted(kv, kind).where((C("pos") >= sinks) & (C("pos") < C("k_len") - recent))
    chosen = A.top_keys(A.logits(queries, middle, 1.0, None), k).groupBy("layer", "pos").agg(F.count("*").alias("times"))
    if clip >= 0:
        place = F.row_number().over(W.partitionBy("layer").orderBy(C("times").desc(), "pos"))
        chosen = chosen.withColumn("_r", place).where(C("_r") <= clip)
    wide = chosen.join(lengths, "layer").where(C("n") > sinks + recent)
    low, high = F.lit(sinks), C("n") - recent - 1
    if span > 0:
        wide = wide.select("layer", "n", F.explode(F.sequence(C("pos") - span // 2, C("pos") + (span + 1) // 2 - 1)).alias("pos"))
    wide = wide.select("layer", F.least(F.greatest("pos", low), high).alias("pos")).distinct()
    every = kv.select("layer", "pos", "k_len").distinct()
    ends = every.where((C("pos") < sinks) | (C("pos") >= C("k_len") - recent) | (C("k_len") <= sinks + recent)).select("layer", "pos")
    return wide.union(ends).distinct()


def recall(kv: DataFrame, queries: DataFrame, **how) -> DataFrame:
    return kv.join(recalled_positions(kv, queries, **how), ["layer", "pos"], "left_semi")


def padded(chosen: DataFrame, kv: DataFrame, target: int) -> DataFrame:
    """Positions filled up to a target per layer with the most recent that are not chosen."""
    rest = kv.select("layer", "pos").distinct().join(chosen, ["layer", "pos"], "left_anti")
    have = chosen.groupBy("layer").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("layer").orderBy(C("pos").desc()))
    more = rest.join(have, "layer", "left").withColumn("_r", place).where(C("_r") <= target - F.coalesce("n", F.lit(0)))
    return chosen.select("layer", "pos").union(more.select("layer", "pos"))


def compacted(kept: DataFrame, end: int, base: float, size: int) -> DataFrame:
    """Kept keys moved to the positions before ``end``: re-rotated from where they were."""
    w = W.partitionBy(*HEAD)
    out = kept.withColumn("new_pos", F.row_number().over(w.orderBy("pos")) - 1 + end - F.count("*").over(w))
    return out.withColumn("key", A.rotated(C("key"), (C("new_pos") - C("pos")).cast("double"), A.inverse_frequencies(base, size)))


def view_positions(kept: DataFrame, n_queries: Column | int) -> DataFrame:
    """Consecutive positions of a view: keys from 0, the queries at its end."""
    out = kept.withColumn("view_pos", F.row_number().over(W.partitionBy(*HEAD).orderBy("pos")) - 1)
    return out.withColumn("query_start", F.count("*").over(W.partitionBy(*HEAD)) - n_queries)


def chunk_bounds(n: int, size: int, sinks: int = 0, local: int = 0, aligned: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, generating) of the chunks of one pass over n positions.

    Uniform chunks, or with ``aligned`` a first chunk that makes later ones end on multiples of 128
    beyond the sinks and the local window, and the last position as a chunk of its own.
    """
    if n == 1:
        return [(0, 1, True)]
    if not aligned:
        return [(s, min(s + size, n), False) for s in range(0, n, size)]
    first = max(1, min(sinks + local - (128 - (n - 1 - sinks + local) % 128), n - 1))
    cuts = [0, first, *range(first + size, n - 1, size)]
    cuts += [n - 1] if cuts[-1] != n - 1 else []
    return [(a, b, b - a == 1) for a, b in zip(cuts, cuts[1:], strict=False)] + [(n - 1, n, True)]


def recalls(seen: int, generating: bool, sinks: int, local: int, option: str = "whole") -> bool:
    """Whether a chunk that has seen so many positions attends over a recalled view."""
    if option not in ("whole", "default", "generate_only", "prefill_only", "full_attn"):
        raise ValueError(f"unknown recall option {option}")
    blocked = option == "full_attn" or (option == "generate_only" and not generating) or (option == "prefill_only" and generating)
    return seen > sinks + local and not blocked


def aligned_local(seen: int, sinks: int, local: int) -> int:
    """The local window shrunk so that the middle is a multiple of 128; by 128 if it is one already."""
    out = local - (128 - (seen - sinks - local) % 128)
    return out if out >= 1 else local


def chunk_of(pos: Column, bounds: list[tuple[int, int, bool]]) -> Column:
    """The number of the chunk that holds a position, by arithmetic: all chunks but the first and the
    last two have one size, as ``chunk_bounds`` makes them."""
    starts = [s for s, _, _ in bounds]
    if len(bounds) < 3:
        out = F.lit(0)
        for c, s in enumerate(starts[1:], 1):
            out = F.when(pos >= s, c).otherwise(out)
        return out.cast("int")
    size = starts[2] - starts[1]
    if any(b - a != size for a, b in zip(starts[1:-2], starts[2:-1], strict=False)):
        raise ValueError("inner chunks must have one size")
    inner = F.least(F.lit(len(bounds) - 2), 1 + F.floor((pos - starts[1]) / size))
    return F.when(pos < starts[1], 0).when(pos >= starts[-1], len(bounds) - 1).otherwise(inner).cast("int")


def exact_recall(queries: DataFrame, kv: DataFrame, size: int, bounds: list[tuple[int, int, bool]], sinks: int, local: int, k: int, span: int, option: str = "whole", base: float = 10000.0, contiguous: bool = False) -> DataFrame:
    """Attention of each chunk of queries over a view of the keys seen so far; no key is dropped.

    The view of a chunk is the sinks, the local window and spans about the positions that some of
    its queries has among its k best in between. Keys and queries are unrotated; they are rotated to
    their own positions, or with ``contiguous`` to consecutive ones that end with the chunk. All
    chunks are one plan of equi-joins: a query finds its chunk by arithmetic, a chunk lists the positions
    of its view, and keys are repeated for the chunks that view them only.
    """
    viewed = [recalls(e, g, sinks, local, option) for _, e, g in bounds]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), C("chunk") + 1)
    named = {"start": pick([s for s, _, _ in bounds]).cast("long"), "end": pick([e for _, e, _ in bounds]).cast("long"), "view": pick(viewed)}
    q = queries.where(C("qpos") < bounds[-1][1]).withColumn("chunk", chunk_of(C("qpos"), bounds)).withColumns(named)
    pairs = q.where("view").select(*HEAD, "qpos", "chunk", "query", "end").join(kv.where(C("pos") >= sinks).select(*HEAD, "pos", "key"), [*HEAD])
    scored = pairs.where(C("pos") < C("end") - local).withColumn("logit", V.dot(C("query"), C("key")))
    top = A.top_keys(scored, k).select("layer", "chunk", "end", "pos").distinct()
    wide = top.select("layer", "chunk", "end", F.explode(F.sequence(C("pos") - span // 2, C("pos") + (span + 1) // 2 - 1)).alias("pos")) if span > 0 else top
    wide = wide.select("layer", "chunk", F.least(F.greatest("pos", F.lit(sinks)), C("end") - local - 1).alias("pos"))
    spans = [F.struct(F.lit(c).alias("chunk"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for c, ((_, e, _), v) in enumerate(zip(bounds, viewed, strict=True)) for a, b in ([(0, sinks), (e - local, e)] if v else [(0, e)]) if b > a]
    ends = kv.select("layer").distinct().select("layer", F.explode(F.array(*spans)).alias("x")).select("layer", "x.chunk", F.explode(F.sequence(C("x.a"), C("x.b") - 1)).alias("pos"))
    view = wide.union(ends).distinct()
    keys = kv.select(*HEAD, "pos", "key", "value").join(view, ["layer", "pos"]).withColumns(named)
    fr = A.inverse_frequencies(base, size)
    if contiguous:
        w = W.partitionBy(*HEAD, "chunk")
        keys = keys.withColumns({"_at": F.row_number().over(w.orderBy("pos")) - 1, "_n": F.count("*").over(w)})
        q = q.join(keys.select(*HEAD, "chunk", "_n").distinct(), [*HEAD, "chunk"]).withColumn("_q", F.when(C("view"), C("_n") - (C("end") - C("qpos"))).otherwise(C("qpos"))).drop("_n")
        keys = keys.withColumn("_at", F.when(C("view"), C("_at")).otherwise(C("pos"))).drop("_n")
    else:
        q, keys = q.withColumn("_q", C("qpos")), keys.withColumn("_at", C("pos"))
    q = q.select(*HEAD, "qpos", "chunk", A.rotated(C("query"), C("_q").cast("double"), fr).alias("query"))
    keys = keys.select(*HEAD, "pos", "chunk", "value", A.rotated(C("key"), C("_at").cast("double"), fr).alias("key"))
    rows = q.join(keys, [*HEAD, "chunk"]).where(C("pos") <= C("qpos"))
    return A.attend(rows.withColumn("logit", V.dot(C("query"), C("key")) / math.sqrt(size)), size)


def shrunk(seeds: DataFrame, lengths: DataFrame, target: int, span: int) -> DataFrame:
    """Positions of each layer: the spans of the most frequent seeds that fit into the target, filled
    up with the most recent other positions; if one span is too large, what is next to its seed.

    seeds (layer, pos, times) and lengths (layer, n) are relative to the middle range; the seeds of a
    layer are at most its positions.
    """
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        ranked = pdf.sort_values(["times", "pos"], ascending=[False, True])["pos"].tolist()

        def spread(some: list[int]) -> set[int]:
            return {min(max(p + o, 0), n - 1) for p in some for o in (range(-(span // 2), (span + 1) // 2) if span > 0 else (0,))}

        room = min(target, n)
        low, high = 0, len(ranked)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(spread(ranked[:middle])) <= room else (low, middle - 1)
        kept = spread(ranked[:low]) if low else set(sorted(spread(ranked[:1]), key=lambda p: (abs(p - ranked[0]), p))[:room])
        for p in range(n - 1, -1, -1):
            if len(kept) >= room:
                break
            kept.add(p)
        return pd.DataFrame({"layer": pdf["layer"].iloc[0], "pos": sorted(kept)})

    return seeds.join(lengths, "layer").groupBy("layer").applyInPandas(fit, "layer int, pos long")

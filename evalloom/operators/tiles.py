"""Products of all queries with all keys, by tiles: no row per pair.

Vectors of ``size`` neighbouring positions of a head make up a tile, one row of flat arrays. Query tiles
meet the key tiles that they may see under ``BAND`` of them at a time, so that the work of one head, however long, is dealt to
as many tasks as it has bands, and a key tile is sent once for each band that sees it. A kernel multiplies one pair
of tiles after the other and keeps a running result per query; results of one query tile that come from several
tasks are merged by a second pass over them. Memory is that of a few tiles.

Queries are (layer, head, qpos, query), and q_head where several query heads share a key head; keys are
(layer, head, pos, key, value). Positions of a head differ. A query that sees no key has no row. Rows with
null heads or positions have no tile; empty relations give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .relations import HEAD

#: Positions of a tile, and query tiles of a band.
SIZE, BAND = 256, 16
#: Most bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20
C = F.col
#: Which of a query's vectors meets a key, from the positions of both: (n, 1) and (1, m) arrays to (n, m).
Choice = Callable[[np.ndarray, np.ndarray], np.ndarray]


def tiled(rows: DataFrame, by: tuple[str, ...], pos: str, vectors: tuple[str, ...], size: int) -> DataFrame:
    """(by, tile, pos as an array in order, and each vector column as one flat array)."""
    inside = F.sort_array(F.collect_list(F.struct(C(pos).cast("long").alias("p"), *vectors))).alias("_rows")
    tiles = rows.groupBy(*by, F.floor(C(pos) / size).cast("long").alias("tile")).agg(inside)
    flat = [F.flatten(C(f"_rows.{v}")).alias(v) for v in vectors]
    return tiles.where(C("tile").isNotNull()).select(*by, "tile", C("_rows.p").alias(pos), *flat)


def _query_keys(queries: DataFrame) -> tuple[str, ...]:
    return (*HEAD, "q_head") if "q_head" in queries.columns else HEAD


def tile_pairs(queries: DataFrame, kv: DataFrame, offset: int | None, size: int, vectors: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """Each query tile (qpos, query) beside each key tile that one of its queries may see (pos <= qpos + offset; None: all)."""
    by = _query_keys(queries)
    q = tiled(queries, by, "qpos", ("query",), size).withColumn("band", F.floor(C("tile") / BAND))
    bands = q.select(*HEAD, "band").distinct()
    k = tiled(kv, HEAD, "pos", vectors, size).withColumnRenamed("tile", "k_tile").join(bands, [*HEAD])
    if offset is not None:
        k = k.where(C("k_tile") * size <= (C("band") + 1) * (BAND * size) - 1 + offset)
    both = q.join(k, [*HEAD, "band"]).drop("band")
    return both if offset is None else both.where(C("k_tile") * size <= (C("tile") + 1) * size - 1 + offset)


def bounded(rows: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """rows.mapInArrow with batches of at most ``BATCH_BYTES``: a row holds tiles or blocks of vectors, so a number of rows does
    not bound a batch."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def _values(column: pa.Array, k: int, dtype: type) -> np.ndarray:
    return np.asarray(column[k].values.to_numpy(zero_copy_only=False), dtype=dtype)


def _running(by: tuple[str, ...], start: Callable, add: Callable, finish: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that keeps one state for neighbouring rows of a query tile: start(row) gives it,
    add(state, row) takes a row in, finish(key, state) gives the batch of a tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            columns = {n: b.column(n) for n in b.schema.names}
            for k, key in enumerate(zip(*(columns[c].to_pylist() for c in (*by, "tile")), strict=True)):
                if key != now:
                    if now is not None:
                        yield finish(now, state)
                    now, state = key, start(columns, k)
                add(state, columns, k)
        if now is not None:
            yield finish(now, state)

    return run


class _Softmax:
    """Running maximum, sum of weights and weighted sum of values for each query of a tile."""

    def __init__(self, qpos: np.ndarray, size: int):
        self.qpos, n = qpos, len(qpos)
        self.m, self.z, self.o = np.full(n, -np.inf), np.zeros(n), np.zeros((n, size))

    def take(self, m: np.ndarray, z: np.ndarray, o: np.ndarray) -> None:
        """Adds partial results over other keys."""
        top = np.maximum(self.m, m)
        fixed = np.where(np.isneginf(top), 0.0, top)
        old, new = np.exp(self.m - fixed), np.exp(m - fixed)
        self.m, self.z, self.o = top, self.z * old + z * new, self.o * old[:, None] + o * new[:, None]


def _logits(columns: dict, k: int, size: int, scale: float, offset: int | None, choice: Choice | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qpos, pos = _values(columns["qpos"], k, np.int64), _values(columns["pos"], k, np.int64)
    key = _values(columns["key"], k, np.float64).reshape(len(pos), size)
    query = _values(columns["query"], k, np.float64).reshape(len(qpos), -1, size)
    out = query[:, 0] @ key.T
    if choice is not None:
        which = choice(qpos[:, None], pos[None, :])
        for v in range(1, query.shape[1]):
            if (which == v).any():
                out = np.where(which == v, query[:, v] @ key.T, out)
    out = out * scale
    return (out if offset is None else np.where(pos[None, :] > qpos[:, None] + offset, -np.inf, out)), qpos, pos


def attention(queries: DataFrame, kv: DataFrame, size: int, scale: float | None = None, offset: int | None = 0, choice: Choice | None = None, tile: int = SIZE, width: int | None = None) -> DataFrame:
    """Per query ``out``, the softmax-weighted sum of the values that it sees, and ``lse``, the log of the sum of weights.

    With ``choice``, a query is several vectors one after another, and choice says which of them meets a key. Values have
    ``width`` numbers, as many as keys if it is not given.
    """
    scale, width = scale or 1 / math.sqrt(size), width or size
    by = _query_keys(queries)
    fields = [queries.schema[c] for c in by]
    many = ArrayType(DoubleType())
    part = StructType([*fields, StructField("tile", LongType()), StructField("qpos", ArrayType(LongType())), *(StructField(c, many) for c in "mzo")])
    whole = StructType([*fields, StructField("qpos", LongType()), StructField("out", many), StructField("lse", DoubleType())])

    def start(columns: dict, k: int) -> _Softmax:
        return _Softmax(_values(columns["qpos"], k, np.int64), width)

    def meet(state: _Softmax, columns: dict, k: int) -> None:
        logit, _, pos = _logits(columns, k, size, scale, offset, choice)
        m = logit.max(axis=1)
        e = np.exp(logit - np.where(np.isneginf(m), 0.0, m)[:, None])
        state.take(m, e.sum(axis=1), e @ _values(columns["value"], k, np.float64).reshape(len(pos), width))

    def partial(key: tuple, state: _Softmax) -> pa.RecordBatch:
        columns = [pa.array([x]) for x in (*key, state.qpos.tolist(), state.m.tolist(), state.z.tolist(), state.o.reshape(-1).tolist())]
        return pa.RecordBatch.from_arrays(columns, names=part.names)

    def merge(state: _Softmax, columns: dict, k: int) -> None:
        m, z, o = (_values(columns[c], k, np.float64) for c in "mzo")
        state.take(m, z, o.reshape(len(m), width))

    def result(key: tuple, state: _Softmax) -> pa.RecordBatch:
        seen = state.z > 0
        out = state.o[seen] / state.z[seen, None]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * width, pa.int32()), pa.array(out.reshape(-1)))
        columns = [*(pa.array([x] * len(out)) for x in key[:-1]), pa.array(state.qpos[seen]), rows, pa.array(state.m[seen] + np.log(state.z[seen]))]
        return pa.RecordBatch.from_arrays(columns, names=whole.names)

    parts = bounded(tile_pairs(queries, kv, offset, tile), _cast(_running(by, start, meet, partial), part), part)
    dealt = parts.repartition(*by, "tile").sortWithinPartitions(*by, "tile")
    return bounded(dealt, _cast(_running(by, start, merge, result), whole), whole)


def received(queries: DataFrame, kv: DataFrame, size: int, scale: float | None = None, offset: int | None = 0, tile: int = SIZE) -> DataFrame:
    """(layer, head, pos, mass): the attention that each key receives from all queries that see it.

    A first pass gives the log of each query's sum of weights, a second one the weights of a pair of tiles, summed up for each key.
    """
    scale = scale or 1 / math.sqrt(size)
    keys = kv.select(*HEAD, "pos", "key")
    lse = attention(queries, keys.withColumn("value", F.array(F.lit(0.0))), size, scale, offset, tile=tile, width=1).select(*HEAD, "qpos", "lse")
    # The sum of weights travels behind the query's vector.
    known = queries.join(lse, [*HEAD, "qpos"]).select(*HEAD, "qpos", F.concat("query", F.array("lse")).alias("query"))
    part = StructType([*(kv.schema[c] for c in HEAD), StructField("k_tile", LongType()), StructField("pos", ArrayType(LongType())), StructField("mass", ArrayType(DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(n) for n in b.schema.names}
            for k in range(b.num_rows):
                qpos, pos = _values(columns["qpos"], k, np.int64), _values(columns["pos"], k, np.int64)
                query = _values(columns["query"], k, np.float64).reshape(len(qpos), size + 1)
                logit = query[:, :size] @ _values(columns["key"], k, np.float64).reshape(len(pos), size).T * scale - query[:, size:]
                if offset is not None:
                    logit = np.where(pos[None, :] > qpos[:, None] + offset, -np.inf, logit)
                columns_out = [*(columns[c].slice(k, 1) for c in (*HEAD, "k_tile")), pa.array([pos]), pa.array([np.exp(logit).sum(axis=0)])]
                yield pa.RecordBatch.from_arrays(columns_out, names=part.names)

    parts = bounded(tile_pairs(known, keys, offset, tile, ("key",)), _cast(run, part), part)
    each = parts.select(*HEAD, F.explode(F.arrays_zip("pos", "mass")).alias("_x"))
    return each.groupBy(*HEAD, C("_x.pos").alias("pos")).agg(F.sum("_x.mass").alias("mass"))


def _cast(run: Callable, schema: StructType) -> Callable:
    """run, whose batches get the types of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return lambda batches: (pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow, strict=True)], schema=arrow) for b in run(batches))


def top_keys(queries: DataFrame, kv: DataFrame, size: int, k: int, scale: float = 1.0, offset: int | None = 0, block: int | None = None, latest: bool = False, tile: int = SIZE) -> DataFrame:
    """(layer, head, qpos, pos, logit, rank): the k best keys of each query by the logit, compared after rounding to nine digits. Ties go to
    the smaller position, or with ``latest`` to the larger. With ``block`` only the best key of each block of
    positions competes; tiles hold whole blocks.
    """
    if block and tile % block:
        raise ValueError(f"a tile of {tile} positions does not hold whole blocks of {block}")
    by, sign = _query_keys(queries), -1 if latest else 1
    fields = [queries.schema[c] for c in by]
    longs, doubles = ArrayType(LongType()), ArrayType(DoubleType())
    part = StructType([*fields, StructField("tile", LongType()), StructField("qpos", longs), StructField("best", longs), StructField("by", doubles)])
    whole = StructType([*fields, *(StructField(c, LongType()) for c in ("qpos", "pos")), StructField("logit", DoubleType()), StructField("rank", LongType())])

    def start(columns: dict, at: int) -> dict:
        qpos = _values(columns["qpos"], at, np.int64)
        return {"qpos": qpos, "pos": np.full((len(qpos), k), -1), "logit": np.full((len(qpos), k), -np.inf)}

    def take(state: dict, pos: np.ndarray, logit: np.ndarray) -> None:
        pos, logit = np.concatenate([state["pos"], pos], axis=1), np.concatenate([state["logit"], logit], axis=1)
        order = np.lexsort((sign * pos, -np.round(logit, 9)), axis=1)[:, :k]
        state["pos"], state["logit"] = np.take_along_axis(pos, order, axis=1), np.take_along_axis(logit, order, axis=1)

    def meet(state: dict, columns: dict, at: int) -> None:
        logit, _, pos = _logits(columns, at, size, scale, offset, None)
        pos = np.broadcast_to(pos, logit.shape)
        if block:
            cuts = np.flatnonzero(np.append(True, np.diff(pos[0] // block) != 0))
            near = np.round(logit, 9)
            first = lambda a, b: b - 1 - np.argmax(near[:, a:b][:, ::-1], axis=1) if latest else a + np.argmax(near[:, a:b], axis=1)
            best = np.stack([first(a, b) for a, b in zip(cuts, [*cuts[1:], len(pos[0])], strict=True)], axis=1)
            logit, pos = np.take_along_axis(logit, best, axis=1), np.take_along_axis(pos, best, axis=1)
        take(state, pos, logit)

    def partial(key: tuple, state: dict) -> pa.RecordBatch:
        columns = [pa.array([x]) for x in (*key, state["qpos"].tolist(), state["pos"].reshape(-1).tolist(), state["logit"].reshape(-1).tolist())]
        return pa.RecordBatch.from_arrays(columns, names=part.names)

    def merge(state: dict, columns: dict, at: int) -> None:
        take(state, _values(columns["best"], at, np.int64).reshape(-1, k), _values(columns["by"], at, np.float64).reshape(-1, k))

    def result(key: tuple, state: dict) -> pa.RecordBatch:
        seen = ~np.isneginf(state["logit"])
        n, rank = np.repeat(state["qpos"], k)[seen.reshape(-1)], np.broadcast_to(np.arange(1, k + 1), seen.shape)[seen]
        columns = [*(pa.array([x] * len(n)) for x in key[:-1]), pa.array(n), pa.array(state["pos"][seen]), pa.array(state["logit"][seen]), pa.array(rank)]
        return pa.RecordBatch.from_arrays(columns, names=whole.names)

    parts = bounded(tile_pairs(queries, kv, offset, tile, ("key",)), _cast(_running(by, start, meet, partial), part), part)
    dealt = parts.repartition(*by, "tile").sortWithinPartitions(*by, "tile")
    return bounded(dealt, _cast(_running(by, start, merge, result), whole), whole)


def beside(*vectors: Column) -> Column:
    """Several vectors of a query one after another, for a choice."""
    return F.concat(*vectors)

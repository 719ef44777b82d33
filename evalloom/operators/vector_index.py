"""A stored index of vectors: an inverted file with exact re-ranking, and exact searches beside it.

``build`` fits centroids on at most ``SAMPLE`` vectors (Lloyd's rounds on the driver), assigns every row to the
nearest, and writes the rows in blocks, partitioned by list. Building again at a path replaces the index. ``search`` reads
only the lists of the best ``probes`` centroids of each query and ranks their rows by the inner product itself.
``search_exactly`` first searches so, then reads the lists whose bound, the product with the centroid plus the query's
length times the list's radius, still reaches the last rank: its rows are those of a full scan. ``calibrated`` gives the
probes that a wanted recall takes: few where vectors lie in clusters, most lists where they do not. ``nearest`` ranks without an
index, among the rows that share columns.

Blocks hold at most ``BLOCK`` vectors as one flat array; a kernel multiplies a block of queries with a block of
vectors and hands on the k best of each query, so no row per pair is made and each partial ranking is merged by a
last one over them. Rows of one list or key are dealt by salts, one more
for each ``DEALT`` rows, up to ``SALTS``.

Ids are whole numbers; rows without an id or a vector are left out, and vectors have one length. Similarities are compared
after rounding to nine digits, ties go to the smaller id. Repeated rows are ranked each; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..checkpoints import cut
from .tiles import bounded

C = F.col
#: Vectors that centroids are fitted on, most lists, rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 12
BLOCK, SALTS = 512, 64
#: Rows from which on packing is dealt by one more salt: every row goes to a block either way.
DEALT = 500_000
BLOCKS = "ids array<long>, vectors array<double>, list int"
#: Rows from which on a search without an index is dealt by one more part.
PART = 10_000
#: Queries that a number of probes is chosen by.
TRIED = 200


@dataclass(frozen=True)
class Index:
    """The lists of an index: what a search needs to know before it reads rows. At most MOST_LISTS rows."""

    path: str
    lists: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's algorithm from drawn rows; one that loses all rows stays where it is."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        of = _distances(sample, centroids).argmin(axis=1)
        n = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :], 0)


def _rows(rows: DataFrame, ident: str, vector: str, *more: str) -> DataFrame:
    return rows.where(C(ident).isNotNull() & C(vector).isNotNull()).select(*more, C(ident).cast("long").alias("id"), C(vector).cast("array<double>").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, ids, vectors as one flat array) of about n rows (by, id, vector), at most ``BLOCK`` of them in a row, ids in order."""
    block, salts = BLOCK, min(SALTS, 1 + n // DEALT)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts))).repartition(*by, "_salt").sortWithinPartitions(*by, "_salt", "id")
    schema = StructType([*(rows.schema[c] for c in by), StructField("ids", ArrayType(LongType())), StructField("vectors", ArrayType(DoubleType()))])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, cells = None, [], []

        def out(n: int) -> pa.RecordBatch:
            nonlocal ids, cells
            i, x = np.concatenate(ids), np.concatenate(cells)
            ids, cells = [i[n:]], [x[n:]]
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key[:-1], kinds, strict=True)), pa.array([i[:n].tolist()]), pa.array([x[:n].reshape(-1).tolist()])], schema.names)

        for b in batches:
            columns = [b.column(c) for c in (*by, "_salt")]
            kinds = [c.type for c in columns[:-1]]
            keys = list(zip(*(c.to_pylist() for c in columns), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, e in zip(cuts, cuts[1:], strict=False):
                if a == e:
                    continue
                if keys[a] != key:
                    if ids and len(ids[0]):
                        yield out(len(np.concatenate(ids)))
                    key, ids, cells = keys[a], [], []
                ids.append(b.column("id").slice(a, e - a).to_numpy())
                cells.append(_matrix(b.column("vector").slice(a, e - a)))
                while sum(map(len, ids)) >= block:
                    yield out(block)
        if ids and sum(map(len, ids)):
            yield out(sum(map(len, ids)))

    return bounded(dealt, pack, schema)


def build(rows: DataFrame, path: str, ident: str, vector: str, lists: int | None = None) -> Index:
    """Writes the index of all rows at a path, in place of what is there, and opens it."""
    spark, rows = rows.sparkSession, _rows(rows, ident, vector)
    sample = [r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]
    n = rows.count()
    if sample:
        wanted = lists or round(math.sqrt(n))
        centroids = fitted(np.array(sample), max(1, min(wanted, MOST_LISTS, len(sample))))
    else:
        centroids = np.zeros((1, 1))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_distances(_matrix(b.column("vector")), centroids).argmin(axis=1).astype(np.int32)), *b.columns], ["list", "id", "vector"])

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("list").to_pylist()
            far = [float(np.sqrt(_distances(np.array(x).reshape(len(i), -1), centroids[k : k + 1]).max())) for k, i, x in zip(of, b.column("ids").to_pylist(), b.column("vectors").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("list"), pa.array([len(i) for i in b.column("ids").to_pylist()], pa.int64()), pa.array(far, pa.float64())], ["list", "n", "far"])

    packed(rows.mapInArrow(assign, "list int, id long, vector array<double>"), ["list"], n).write.mode("overwrite").partitionBy("list").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    of_list = bounded(blocks.select("list", "ids", "vectors"), reach, "list int, n long, far double").groupBy("list").agg(F.sum("n").alias("n"), F.max("far").alias("radius"))
    place = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>")
    of_list.join(F.broadcast(place), "list").write.mode("overwrite").parquet(f"{path}/lists")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    found = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return Index(path, np.array([r.list for r in found], dtype=int), np.array([r.centroid for r in found]), np.array([r.radius for r in found]), np.array([r.n for r in found], dtype=int))


def routed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(list, id, vector) of queries (id, vector), once for each of the lists whose centroids are most like it."""
    return _route(index, queries, lambda _, near: np.argsort(-near, axis=1, kind="stable")[:, :probes])


def _route(index: Index, queries: DataFrame, choose) -> DataFrame:
    """choose(batch, products with the centroids) gives an array of places per query, -1 for none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(index.lists):
                continue
            at = choose(b, _matrix(b.column("vector")) @ index.centroids.T)
            row, column = np.nonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(index.lists[at[row, column]].astype(np.int32)), b.column("id").take(pa.array(row)), b.column("vector").take(pa.array(row))], ["list", "id", "vector"])

    return queries.mapInArrow(run, "list int, id long, vector array<double>")


def _best(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, question, id, similarity): the k best of each query within each pair of blocks."""
    schema = StructType([*(pairs.schema[c] for c in by), StructField("question", LongType()), StructField("id", LongType()), StructField("similarity", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                asked, ids = (np.asarray(b.column(c)[r].values) for c in ("q_ids", "ids"))
                q, x = (np.asarray(b.column(c)[r].values).reshape(n, -1) for c, n in (("q_vectors", len(asked)), ("vectors", len(ids))))
                near = q @ x.T
                order = np.argsort(-np.round(near, 9), axis=1, kind="stable")[:, :k]
                n = order.size
                columns = [*(pa.array([b.column(c)[r].as_py()] * n, b.column(c).type) for c in by), pa.array(np.repeat(asked, order.shape[1])), pa.array(ids[order].reshape(-1)), pa.array(np.take_along_axis(near, order, axis=1).reshape(-1))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return bounded(pairs.select(*by, "q_ids", "q_vectors", "ids", "vectors"), run, schema)


def _ranked(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by, "question").orderBy(F.round("similarity", 9).desc(), "id"))
    return hits.withColumn("rank", place).where(C("rank") <= k)


def _found(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each routed query within each block of its lists."""
    spark = asked.sparkSession
    touched = asked.groupBy("list").count().collect()  # at most MOST_LISTS
    blocks = index.blocks(spark).where(C("list").isin([r.list for r in touched]))
    q = packed(asked, ["list"], sum(r["count"] for r in touched)).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    return _best(q.join(blocks, "list"), [], k)


def search(index: Index, queries: DataFrame, ident: str, vector: str, k: int, probes: int) -> DataFrame:
    """(question, id, similarity, rank): the k best rows of each query among the lists that it probes."""
    return _ranked(_found(index, routed(index, _rows(queries, ident, vector), probes), k), [], k)


def search_exactly(index: Index, queries: DataFrame, ident: str, vector: str, k: int, probes: int = 1) -> DataFrame:
    """(question, id, similarity, rank): the k best rows of each query among all. A query id stands once."""
    asked = _rows(queries, ident, vector)
    first = cut(_ranked(_found(index, routed(index, asked, probes), k), [], k))
    worst = first.groupBy("question").agg(F.min("similarity").alias("worst"), F.count("*").alias("n"))
    bound = asked.join(worst.where(C("n") == k).select(C("question").alias("id"), "worst"), "id", "left").select("id", "vector", "worst")

    def rest(b: pa.RecordBatch, near: np.ndarray) -> np.ndarray:
        worst = np.array([-np.inf if w is None else w for w in b.column("worst").to_pylist()])
        length = np.sqrt((_matrix(b.column("vector")) ** 2).sum(axis=1))
        open_ = near + length[:, None] * index.radius[None, :] >= worst[:, None] - 1e-6
        np.put_along_axis(open_, np.argsort(-near, axis=1, kind="stable")[:, :probes], False, axis=1)
        return np.where(open_, np.arange(near.shape[1]), -1)

    more = _found(index, _route(index, bound, rest), k)
    return _ranked(first.drop("rank").unionByName(more), [], k)


def calibrated(index: Index, queries: DataFrame, ident: str, vector: str, k: int, recall: float) -> int:
    """The least number of probes by which a share of the k best rows is found, for at most TRIED of the queries, in order of
    a hash. Their exact search reads the whole index once."""
    spark = queries.sparkSession
    tried = _rows(queries, ident, vector).orderBy(F.xxhash64("id"), "id").limit(TRIED).collect()
    if not tried or not len(index.lists):
        return 1
    asked = spark.createDataFrame(tried, "id long, vector array<double>")
    every = packed(routed(index, asked, len(index.lists)), ["list"], len(tried)).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    hits = _ranked(_best(every.join(index.blocks(spark), "list"), ["list"], k), [], k).select("question", "list").collect()
    order = np.argsort(-(np.array([r.vector for r in tried]) @ index.centroids.T), axis=1, kind="stable")
    row, place = {r.id: n for n, r in enumerate(tried)}, {int(v): n for n, v in enumerate(index.lists)}
    depth = np.argsort(order, axis=1)
    needed = sorted(int(depth[row[h.question], place[h.list]]) for h in hits)
    return needed[max(0, math.ceil(recall * len(needed)) - 1)] + 1


def rows_read(index: Index, queries: DataFrame, ident: str, vector: str, probes: int) -> DataFrame:
    """(question, rows): index rows in the lists that each query probes."""
    sizes = queries.sparkSession.createDataFrame([(int(a), int(n)) for a, n in zip(index.lists, index.sizes, strict=True)], "list int, n long")
    asked = routed(index, _rows(queries, ident, vector), probes).select("list", C("id").alias("question"))
    return asked.join(F.broadcast(sizes), "list").groupBy("question").agg(F.sum("n").alias("rows"))


def nearest(queries: DataFrame, rows: DataFrame, by: list[str], k: int, ident: tuple[str, str], vector: tuple[str, str]) -> DataFrame:
    """(by, question, id, similarity, rank): the k best of the rows with equal columns ``by``, without an index."""
    asked, rows = _rows(queries, ident[0], vector[0], *by), _rows(rows, ident[1], vector[1], *by)
    q = packed(asked, by, asked.count()).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    n = rows.count()
    # Rows that share columns, all of them maybe, are dealt to parts, each of which meets every block of queries.
    parts = min(SALTS, 1 + n // PART)
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = packed(rows, by, n).withColumn("_part", F.pmod(F.hash("ids"), F.lit(parts)))
    return _ranked(_best(q.join(dealt, [*by, "_part"]), by, k), by, k)

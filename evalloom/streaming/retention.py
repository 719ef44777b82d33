"""Retention over a stream of key-value rows: bounded state per (layer, head).

Rows (layer, head, pos, score) arrive in order of pos within a head, the rows of one batch in any order. State is kept by
element, in a map of slots or positions beside a few numbers, so that a batch costs what it changes and not the whole
cache of a head. Each operator has a batch form or a plain version in the tests that gives the same rows. Rows of a null
layer or head form a head of their own; a null score counts as lower than any other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..checkpoints import scratch

ROW = "layer int, head int, pos long, score double"
CELL = "pos long, score double"
C = F.col
#: Most partitions of a stream's state, and rows of a bounded stream that one micro-batch is to take.
PARTITIONS, PER_BATCH = 64, 8_000_000
#: State by element needs this store: a setting of Spark and its fixed value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def chunks(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A file stream that takes a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class _Head(StatefulProcessor):
    """Numbers of a head (``names``) and a map of its cells; a subclass takes the rows of a batch in order."""

    names: tuple[str, ...] = ("n",)
    columns: tuple[str, ...] = ("pos", "score")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", ", ".join(f"{c} long" for c in self.names))
        self.cells = handle.getMapState("cells", "slot long", CELL)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of Spark's interface
        numbers = list(self.numbers.get()) if self.numbers.exists() else [0] * len(self.names)
        new = pd.concat(list(rows)).sort_values("pos", kind="stable")
        out = self.take(numbers, new)
        self.numbers.update(tuple(int(x) for x in numbers))
        yield pd.DataFrame([(*key, *r) for r in out], columns=["_head", *self.columns])

    def put(self, slot: int, pos: int, score: float) -> None:
        self.cells.updateValue((int(slot),), (int(pos), float(score)))

    def every(self) -> list[tuple[int, float]]:
        return [(int(v[0]), float(v[1])) for _, v in self.cells.iterator()]

    def sync(self, kept: list[tuple[int, float]], stored: set[int]) -> None:
        """Brings the map, which holds the positions ``stored``, to the cells kept: once for a batch, since each call goes
        to the store."""
        for p in stored - {p for p, _ in kept}:
            self.cells.removeKey((p,))
        for p, s in kept:
            if p not in stored:
                self.put(p, p, s)

    def close(self) -> None:
        pass


def _best(kept: list[tuple[int, float]], target: int) -> list[tuple[int, float]]:
    """The best ``target`` of kept by score, ties to the smaller position, in order of position."""
    return sorted(sorted(kept, key=lambda x: (-x[1] if x[1] == x[1] else np.inf, x[0]))[:target])


class _Numbered(_Head):
    columns = ("pos", "row")

    def take(self, numbers: list, new: pd.DataFrame) -> list[tuple]:
        start = numbers[0]
        numbers[0] += len(new)
        return [(start + k, int(r)) for k, r in enumerate(new["pos"])]


class _Delayed(_Head):
    """A ring of the last ``window`` cells: a batch reads and writes a slot once at most."""

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold = window, threshold

    def take(self, numbers: list, new: pd.DataFrame) -> list[tuple]:
        n, fresh, w = numbers[0], list(zip(new["pos"], new["score"], strict=True)), self.window
        old = [tuple(self.cells.getValue((k % w,))) for k in range(max(0, n - w), min(n, n + len(fresh) - w))] if w else []
        last = max(0, len(fresh) - w)
        for k, cell in enumerate(fresh[last:], n + last):
            self.put(k % w, *cell)
        numbers[0] = n + len(fresh)
        return [(int(p), float(s)) for p, s in [*old, *fresh[:last]] if s < self.threshold]


class _Bounded(_Head):
    """Compacts to ``target`` cells whenever ``interval`` rows have come; with a prompt, whose rows are below
    ``prompt``, first to a share of it, as step 0."""

    names = ("since", "steps", "done")
    columns = ("step", "pos")

    def __init__(self, target: int, interval: int, prompt: int = 0, ratio: float = 0.0):
        self.target, self.interval, self.prompt, self.ratio = target, interval, prompt, ratio

    def take(self, numbers: list, new: pd.DataFrame) -> list[tuple]:
        kept = self.every()
        stored, out = {p for p, _ in kept}, []
        for pos, score in zip(new["pos"].astype(int), new["score"].astype(float), strict=True):
            if pos >= self.prompt and not numbers[2]:
                numbers[2] = 1
                if self.prompt:
                    kept = _best(kept, int(len(kept) * (1 - self.ratio)))
                    out += [(0, p) for p, _ in kept]
            kept.append((pos, score))
            if pos < self.prompt:
                continue
            numbers[0] += 1
            if numbers[0] >= self.interval:
                kept = _best(kept, self.target)
                numbers[0], numbers[1] = 0, numbers[1] + 1
                out += [(numbers[1], p) for p, _ in kept]
        self.sync(kept, stored)
        return out


class _Chunked(_Head):
    columns = ("chunk", "pos")

    def __init__(self, ratio: float):
        self.ratio = ratio

    def take(self, numbers: list, new: pd.DataFrame) -> list[tuple]:
        kept, out = self.every(), []
        stored = {p for p, _ in kept}
        for chunk, part in new.groupby("chunk", sort=True):
            kept += list(zip(part["pos"].astype(int), part["score"].astype(float), strict=True))
            kept = _best(kept, int(len(kept) * (1 - self.ratio)))
            out += [(int(chunk), p) for p, _ in kept]
        self.sync(kept, stored)
        return out


def _stateful(rows: DataFrame, processor: _Head, schema: str) -> DataFrame:
    # Keys are texts, since a null in a grouping column would share the state of another head; the processor goes to
    # workers by value, since Spark's own worker for streams has not the driver's module path.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("layer", "head"))
    keyed = rows.withColumn("_head", F.to_json(F.struct("layer", "head"))).drop("layer", "head")
    out = keyed.groupBy("_head").transformWithStateInPandas(processor, f"_head string, {schema}", "Append", "None")
    return out.withColumn("_head", F.from_json("_head", kinds)).select("_head.*", *out.columns[1:])


def ingested(rows: DataFrame) -> DataFrame:
    """Rows (layer, head, pos) of a stream with absolute positions: (layer, head, pos, row), where row is the column ``pos``
    that came in and pos counts the rows of a head from 0 across batches."""
    return _stateful(rows, _Numbered(), "pos long, row long")


def delayed_eviction(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """Rows that leave the recent window of their head with a score below the threshold.

    The state of a head is the scores of its last ``window`` positions; a row is judged once, when
    ``window`` later ones have come.
    """
    return _stateful(rows, _Delayed(window, threshold), CELL)


def delayed_eviction_batch(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("layer", "head").orderBy(C("pos").desc()))
    return rows.withColumn("_r", place).where((C("_r") > window) & (C("score") < threshold)).drop("_r")


def bounded_cache(rows: DataFrame, target: int, interval: int) -> DataFrame:
    """The cache after each compaction: when ``interval`` rows have come since the last one, the best
    ``target`` rows of a head stay, ties to the smaller position. Emits (layer, head, step, pos)."""
    return _stateful(rows, _Bounded(target, interval), "step long, pos long")


def phased_cache(rows: DataFrame, prompt: int, ratio: float, target: int, interval: int) -> DataFrame:
    """Two phases of one cache: when the prompt, the positions below ``prompt``, has come, the whole part of (1 - ratio) of
    it stays (step 0); later rows are compacted as by ``bounded_cache``. Emits (layer, head, step, pos)."""
    return _stateful(rows, _Bounded(target, interval, prompt, ratio), "step long, pos long")


def chunk_eviction(rows: DataFrame, ratio: float) -> DataFrame:
    """The cache after each chunk: the rows of a chunk join what has stayed, and the whole part of
    (1 - ratio) of both stays, the best by score, ties to the smaller position. rows have a ``chunk``
    number and come chunk by chunk; emits (layer, head, chunk, pos). The state of a head is its cache."""
    return _stateful(rows, _Chunked(ratio), "chunk long, pos long")


def scheduled(schedule: set[str], compress, sink):
    """A foreachBatch function for the phases ``streaming`` (each batch), ``post_prefill`` (the last
    batch of the prompt, marked by ``final``) and ``decode`` (later batches).

    compress takes a batch and gives the rows that stay; sink stores them with the batch id.
    """
    unknown = schedule - {"streaming", "post_prefill", "decode"}
    if unknown:
        raise ValueError(f"unknown phases {sorted(unknown)}")

    def run(batch: DataFrame, epoch: int) -> None:
        final = batch.agg(F.max(C("final").cast("int")).alias("f")).first().f
        phase = "decode" if final is None or final == 2 else "post_prefill" if final == 1 else "streaming"
        sink(compress(batch) if phase in schedule or ("streaming" in schedule and phase == "post_prefill") else batch, epoch)

    return run


def _available(stream: DataFrame, writer) -> None:
    """Runs a bounded stream to its end, with a store that holds state by element and at most ``PARTITIONS`` partitions of
    state, each of which costs every micro-batch a task."""
    conf = stream.sparkSession.conf
    few = min(PARTITIONS, int(conf.get("spark.sql.shuffle.partitions")))
    own = dict([STORE, ("spark.sql.shuffle.partitions", str(few))])
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a bounded stream to its end into a memory table; for tests and small streams."""
    _available(stream, stream.writeStream.format("memory").queryName(name))
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a bounded stream to its end into Parquet files of the shared folder, where its checkpoint is too: a lost
    executor costs a micro-batch at most."""
    spark = stream.sparkSession
    path, at = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    _available(stream, stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", at))
    return spark.read.schema(stream.schema).parquet(path)


def sliced(rows: DataFrame, path: str, by: str, slices: int) -> int:
    """Writes rows as files in order of a whole number, for a file stream: slices of equal ranges, one write after another,
    each in files of ranges, with times a second apart, since a stream takes files by their times. Gives the files that a
    micro-batch is to take: as many as make ``slices`` batches, or more batches of ``PER_BATCH`` rows, however many files
    Spark writes."""
    spark, written = rows.sparkSession, 0
    ends = rows.agg(F.min(by).alias("a"), F.max(by).alias("b"), F.count("*").alias("n")).first()
    width = 0 if ends.a is None else -(-(ends.b - ends.a + 1) // slices)
    hadoop, time = spark._jvm.org.apache.hadoop.fs, 1_000_000_000_000
    for k in range(slices if width else 0):
        part = rows.where((C(by) >= ends.a + k * width) & (C(by) < ends.a + (k + 1) * width))
        part.repartitionByRange(by).write.parquet(f"{path}/slice={k}")
        folder = hadoop.Path(f"{path}/slice={k}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for name in sorted(str(f.getPath().getName()) for f in files.listStatus(folder)):
            time, written = time + 1000, written + name.endswith(".parquet")
            files.setTimes(hadoop.Path(folder, name), time, -1)
    return max(1, -(-written // max(slices, -(-ends.n // PER_BATCH))))


def restored(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows of each layer up to the length recorded at a checkpoint."""
    return rows.join(lengths, "layer").where(C("pos") < C("length")).drop("length")

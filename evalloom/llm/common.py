"""Scratch tables in the shared folder, and access to the bytes of Arrow string columns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20
#: Bits of a sieve for each key, and the powers of two that they lie between.
SIEVE_BITS, LEAST_SIEVE, MOST_SIEVE = 16, 15, 27
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session on one machine has none, as in tests, a temporary folder is set and used; on a
    cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evalloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends here, so a
    lost executor costs at most the stages that follow."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes tables of ``table`` whose last reader has run."""
    for df in tables:
        forget(df.sparkSession, df.scratch)
        _written.remove((df.sparkSession, df.scratch))


def forget(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                forget(spark, path)
        except Exception:  # noqa: BLE001 - the session or its JVM may be gone already
            return


def map_arrow(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of at most ``BATCH_BYTES``: batches are bounded by bytes, since
    texts differ too much in length for a number of rows to bound them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(f, schema)


def sieved(rows: DataFrame, hashed: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose hash is surely not in the only column of keys, and the others, so that an exact join has to
    shuffle the second part alone. keys is a table, hashes are 64 bits; a null hash is in no table.

    A bit for each residue of the keys goes to the executors, 16 MB at most; beyond 2^MOST_SIEVE / SIEVE_BITS keys
    the second part grows instead.
    """
    power = min(max((SIEVE_BITS * keys.count()).bit_length(), LEAST_SIEVE), MOST_SIEVE)
    bit = lambda c: F.pmod(c, F.lit(1 << power))
    at, tag = bit(F.col(keys.columns[0])), "_sieve"
    while any(c.lower().startswith(tag) for c in rows.columns):
        tag += "_"
    held = keys.where(at.isNotNull()).groupBy(F.floor(at / 32768).cast("long").alias(f"{tag}bucket")).agg(F.bitmap_construct_agg(at % 32768).alias(f"{tag}held"))
    marked = rows.withColumn(f"{tag}bit", bit(hashed)).withColumn(f"{tag}bucket", F.floor(F.col(f"{tag}bit") / 32768).cast("long"))
    marked = marked.join(F.broadcast(held), f"{tag}bucket", "left")
    byte = F.conv(F.hex(F.substring(f"{tag}held", F.floor(F.col(f"{tag}bit") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (F.col(f"{tag}bit") % 8).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(~there).select(*own), marked.where(there).select(*own)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_views(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each string as an array over the column's buffer; null as no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield data[offsets[k] : offsets[k + 1]] if valid[k] else data[:0]


def as_lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column out of one array per row."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)

"""Key-value relations: one row per (layer, head, pos) with a key and a value vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HEAD = ("layer", "head")


def with_length(kv: DataFrame) -> DataFrame:
    """Adds k_len, the number of positions of the head."""
    return kv.withColumn("k_len", F.count("*").over(W.partitionBy(*HEAD)))


def keys_from_vectors(vectors: DataFrame) -> DataFrame:
    """A relation of one layer from labelled vectors; keys get lengths that differ by id."""
    factor = F.lit(1.0) + (F.col("vec_id") * 37 % 101).cast("double") / 100
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.lit(0).alias("layer"), F.col("label").alias("head"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("pos"), "vec_id", value.alias("value"))
    return with_length(rows.select("layer", "head", "pos", "vec_id", F.transform("value", lambda x: x * factor).alias("key"), "value"))


def last_queries(kv: DataFrame, n: int) -> DataFrame:
    """(layer, head, qpos, query) out of the last n positions of each head."""
    return kv.where(F.col("pos") >= F.col("k_len") - n).select(*HEAD, F.col("pos").alias("qpos"), F.col("key").alias("query"))


def every_query(kv: DataFrame) -> DataFrame:
    """(layer, head, qpos, query) out of all positions of each head."""
    return kv.select(*HEAD, F.col("pos").alias("qpos"), F.col("key").alias("query"))

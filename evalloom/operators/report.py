"""Experiment grids and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
#: Methods of the sweep by label, and the settings of its tuned method: fixed values.
METHODS = {"Knorm": "knorm", "CurDkv": "cur", "PyramidKv": "pyramidkv", "SnapKv": "snapkv", "Expected_attn": "expected_attention", "Key_Diff": "keydiff", "StreamingLLM": "streaming_llm", "Compactor": "compactor"}
RATIOS = (0.6, 0.9, 0.95)
GAMMAS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)


def grid(spark: SparkSession, methods=METHODS, ratios: Sequence[float] = RATIOS, gammas: Sequence[float] = GAMMAS) -> DataFrame:
    """(cell_id, label, method, ratio): the full cache, each method and each gamma at each ratio."""
    labels = [*methods.items(), *((f"Ridge_g{g}", "ridge") for g in gammas)]
    cell = F.explode(F.array(*(F.struct(F.lit(a).alias("label"), F.lit(m).alias("method")) for a, m in labels))).alias("x")
    return cells(spark.range(1).select(cell).select("x.*"), ratios)


def cell_id() -> Column:
    return F.concat("label", F.lit("__r"), C("ratio").cast("string"))


def cells(methods: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """The full cache, and each of the methods (label, method) at each ratio."""
    # Rows exploded by ratio: no join, no task for each pair of parameters.
    rows = methods.select("label", "method", F.explode(F.array(*(F.lit(float(r)) for r in ratios))).alias("ratio"))
    full = methods.sparkSession.range(1).select(F.lit("Full").alias("cell_id"), F.lit("Full").alias("label"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("ratio"))
    return full.unionByName(rows.withColumn("cell_id", cell_id()))


def row_label(cell: DataFrame, c: str = "cell_id") -> DataFrame:
    return cell.withColumn("row_label", F.substring_index(c, "__r", 1))


def missing(cells: DataFrame, done: DataFrame, key: str = "cell_id") -> DataFrame:
    return cells.join(done, key, "left_anti")


def pivoted(scores: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """A row per (ratio, label), a column per task, and Avg over those present."""
    wide = scores.groupBy("ratio", "label").pivot("task", list(tasks)).agg(F.first("score"))
    present = F.filter(F.array(*(C(f"`{t}`") for t in tasks)), lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present))
    return wide.withColumn("Avg", mean)


def compared(measured: DataFrame, published: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Measured scores with the published ones, their difference and a mark beyond the tolerance."""
    out = measured.join(published.withColumnRenamed("score", "published"), [*keys], "left")
    delta = C("score") - C("published")
    return out.withColumns({"delta": delta, "mark": F.when(F.abs(delta) > tolerance, "!!").otherwise("")})

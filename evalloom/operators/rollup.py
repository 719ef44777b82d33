"""Rollups of row scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 2) -> Column:
    """c rounded half to even by its exact binary value, as plain conversions do: 66.665 is a little above
    the middle and gives 66.67.

    The product with a power of ten is split in two doubles whose sum is exact, so the side of the
    middle on which it lies is known.
    """
    tens = float(10**digits)
    split = lambda x: (134217729.0 * x - (134217729.0 * x - x))  # noqa: E731  the upper half of the digits
    product, upper = c * tens, split(c)
    error = (upper * tens - product) + (c - upper) * tens
    whole = F.floor(product).cast("double")
    side = (product - whole - 0.5) + error
    up = F.when(side == 0, F.pmod(whole, F.lit(2.0))).otherwise((side > 0).cast("double"))
    return F.when(F.abs(c) < 1e12, (whole + up) / tens).otherwise(c)


def percent(c: str | Column) -> Column:
    return F.avg(c) * 100


def task_means(rows: DataFrame, score: str = "score", task: str = "task", digits: int | None = None) -> DataFrame:
    """(task, score, n), scores in percent; null tasks go. ``digits`` rounds as ``rounded`` does."""
    means = rows.where(F.col(task).isNotNull()).groupBy(F.col(task).alias("task")).agg(percent(score).alias("score"), F.count("*").alias("n"))
    return means if digits is None else means.withColumn("score", rounded(F.col("score"), digits))


def macro(means: DataFrame) -> DataFrame:
    """The mean of task means as one row of scope overall."""
    return means.agg(F.lit("overall").alias("task"), F.avg("score").alias("score"), F.sum("n").alias("n"))


def with_macro(rows: DataFrame, score: str = "score", task: str = "task", digits: int | None = None) -> DataFrame:
    means = task_means(rows, score, task, digits)
    return means.union(macro(means))


def two_levels(rows: DataFrame, length: str = "context_length", task: str = "task", score: str = "score") -> DataFrame:
    """Task means and (length, task) means in one pass over scored rows."""
    sets = rows.where(F.col(task).isNotNull()).groupingSets([[task], [length, task]], length, task)
    return sets.agg(percent(score).alias("score"), F.count("*").alias("n"), F.grouping(length).alias("all_lengths"))


def length_macro(levels: DataFrame, length: str = "context_length") -> DataFrame:
    """Per length the mean over its tasks of unrounded means."""
    return levels.where("all_lengths = 0").groupBy(length).agg(F.avg("score").alias("score"))


def shrinking_mean(value: Column, counts: Column) -> Column:
    """Aggregate: the mean over the rows that count."""
    return F.avg(F.when(counts, value))


def rates(prediction: Column, correct: Column) -> dict[str, Column]:
    """Aggregates: share of non-empty predictions and of correct rows."""
    return {"extraction_rate": percent((F.coalesce(prediction, F.lit("")) != "").cast("int")), "accuracy": percent(correct.cast("int"))}


def response_length(prediction: Column) -> Column:
    return F.avg(F.length(F.coalesce(prediction, F.lit(""))))


def frequencies(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), key).limit(n)


def complete_counts(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows per key with zeros for the keys that have none."""
    return keys.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def best_parameter(grid: DataFrame, parameter: str, objective: str) -> DataFrame:
    """The parameter with the least objective, the first on a tie."""
    return grid.agg(F.min_by(parameter, F.struct(objective, parameter)).alias(parameter), F.min(objective).alias(objective))

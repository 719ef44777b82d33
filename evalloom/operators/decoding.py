"""Token choice from logits: one row per (sequence, step, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

C = F.col
STEP = ("sequence", "step")


def greedy(logits: DataFrame) -> DataFrame:
    """The token with the largest logit of each step, the smaller id on a tie."""
    return logits.groupBy(*STEP).agg(F.max_by("token", F.struct(F.round("logit", 9).alias("l"), (-C("token")).alias("t"))).alias("token"))


def nucleus(logits: DataFrame, temperature: float, top_p: float) -> DataFrame:
    """Probabilities at a temperature, cut to the smallest set that reaches top_p, renormalised."""
    w = W.partitionBy(*STEP)
    out = logits.withColumn("_l", C("logit") / temperature).withColumn("_e", F.exp(C("_l") - F.max("_l").over(w)))
    out = out.withColumn("p", C("_e") / F.sum("_e").over(w))
    order = w.orderBy(F.round("p", 12).desc(), "token").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("_b", F.sum("p").over(order) - C("p")).where(F.round("_b", 12) <= top_p)
    return out.withColumn("p", C("p") / F.sum("p").over(w)).drop("_l", "_e", "_b")


def sampled(probabilities: DataFrame, seed: int) -> DataFrame:
    """One token per step, drawn by a digest of seed, sequence and step: the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), C("sequence").cast("string"), C("step").cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    w = W.partitionBy(*STEP).orderBy("token")
    run = probabilities.withColumns({"_c": F.sum("p").over(w.rowsBetween(W.unboundedPreceding, 0)), "_u": u})
    # The last token takes what rounding leaves.
    last = F.row_number().over(W.partitionBy(*STEP).orderBy(C("token").desc())) == 1
    return run.withColumn("_x", last).where((C("_c") > C("_u")) | C("_x")).groupBy(*STEP).agg(F.min("token").alias("token"))


def until_stop(tokens: Column, stop: Column) -> Column:
    """Tokens before the first stop token."""
    at = F.array_position(tokens, stop)
    return F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)

"""Composition of a positional method, an attention method and a compressor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attention import rotated
from ..operators.relations import with_length
from ..operators.retention import retain
from ..registry import attention_methods, compressors, positional_methods

#: Attention methods whose cache no compressor may change: they index keys by their old positions.
CLOSED = ("dca", "reattention_exact")
PHASES = ("prefill", "decode", "both")


def active(phase: str, decoding: bool) -> bool:
    """Whether a method of a phase acts on this pass."""
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {', '.join(PHASES)}")
    return phase == "both" or (phase == "decode") == decoding


def checked(attention: str | None, compressor: str | None) -> None:
    if attention in CLOSED and compressor:
        raise ValueError(f"{attention} takes no compressor; {compressor} would change its cache")


def pipeline(attention: str | None = None, compressor: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None, phase: str = "both") -> Callable:
    """A function (queries, kv, decoding=False, **parameters) -> output or surviving relation.

    The attention method acts first where it drops keys itself, then the compressor; without an
    attention method the compressor alone acts.
    """
    checked(attention, name or (compressor and getattr(compressor, "__name__", "compressor")))

    def run(queries: DataFrame, kv: DataFrame, decoding: bool = False, **parameters) -> DataFrame:
        out = attention_methods.get(attention)(queries, kv, **parameters) if attention else kv
        if compressor and active(phase, decoding):
            out = compressor(with_length(out.drop("k_len")))
        return out

    return run


def positions(method: str | None, base: float, dim: int, factor: float = 1.0, **more) -> tuple[list[float], float, float]:
    """(inverse frequencies, divisor of positions, attention scale)."""
    return positional_methods.get(method or "linear_pi")(base, dim, factor, **more)


def positioned(relation: DataFrame, column: str, position: str, method: str | None, base: float, dim: int, factor: float = 1.0, **more) -> DataFrame:
    """A relation with a vector column rotated to its positions as a positional method has it: positions are
    divided, frequencies changed and vectors scaled by what ``positions`` gives. Queries and keys are both to be
    sent through it; each is multiplied by the attention scale, as scaled cosines and sines do."""
    frequencies, divisor, scale = positions(method, base, dim, factor, **more)
    turned = rotated(F.col(column), F.col(position).cast("double") / divisor, frequencies)
    return relation.withColumn(column, F.transform(turned, lambda x: x * F.lit(scale)) if scale != 1 else turned)


def decoding(scorer: Callable[[DataFrame], DataFrame], target: int = 2048) -> Callable[[DataFrame], DataFrame]:
    """A compressor for decoding: whatever the cache has grown to, the ``target`` best positions of a head
    stay. A stream calls it after each interval (``streaming.retention.bounded_cache``)."""

    def run(kv: DataFrame) -> DataFrame:
        kept = retain(scorer(kv), 0.0, F.least(F.lit(target), F.col("k_len")))
        return with_length(kept.drop("score", "k_len"))

    return run


def phased(prefill: Callable[[DataFrame], DataFrame] | None = None, decode: Callable[[DataFrame], DataFrame] | None = None) -> Callable:
    """One compressor for the prompt and another for the passes that follow; without one nothing goes."""

    def run(kv: DataFrame, decoding: bool = False) -> DataFrame:
        act = decode if decoding else prefill
        return kv if act is None else with_length(act(kv).drop("k_len"))

    return run


compressors.register("decoding")(decoding)
compressors.register("prefill_decoding")(phased)

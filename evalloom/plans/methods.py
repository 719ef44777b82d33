"""Named compressors, attention and positional methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import attention as A
from ..operators import chunked_attention as K
from ..operators import linear as L
from ..operators import retention as R
from ..registry import attention_methods, compressors, positional_methods

for _name, _scorer, _aliases in (
    ("knorm", R.knorm, ("knorm_sketch",)),
    ("keydiff", R.keydiff, ()),
    ("random", R.random_scores, ("random_sketch",)),
    ("streaming_llm", R.streaming, ()),
    ("reattention", R.recalled, ("reattention_sketch",)),
    ("h2o", R.h2o, ("heavy_hitter_oracle",)),
    ("observed_attention", R.observed, ()),
    ("lagkv", R.lagkv, ()),
    ("cur", R.cur, ()),
    ("expected_attention", R.expected_attention, ()),
    ("snapkv", R.snapkv, ()),
    ("tova", R.tova, ()),
    ("think", R.pruned_channels, ()),
    ("qfilter", R.qfilter, ()),
    ("chunk", R.in_chunks, ()),
    ("chunkkv", R.whole_chunks, ()),
    ("block", R.in_blocks, ()),
    ("composed", R.composed, ()),
    ("key_rerotation", R.rerotated, ()),
    ("per_layer_compression", R.per_layer, ()),
    ("criticalkv", R.critical, ()),
    ("adakv", R.adaptive_mask, ()),
    ("dms", R.threshold_mask, ()),
    ("duo_attention", R.streaming_heads_mask, ()),
    ("kvzip", R.lowest_mask, ()),
    ("kvzap", L.surrogate, ()),
    ("kvzap_linear", R.linear_surrogate, ()),
    ("simlayerkv", R.lazy_layers, ()),
    ("expected_attention_stats", R.stored_expectation, ()),
    ("finch", R.finch_kept, ()),
    ("critical_adakv", R.critical_adaptive_mask, ()),
    ("leverage", L.leverage, ()),
    ("fastkvzip", L.gate_kept, ()),
    ("non_causal_attention", L.non_causal, ()),
    ("compactor", L.compactor, ()),
    ("ridge", L.ridge, ()),
    ("random_sketch_press", L.ridge, ()),
    ("balancekv", L.balanced_halving, ()),
    ("pyramidkv", R.pyramidkv, ()),
):
    compressors.register(_name, _aliases)(_scorer)

attention_methods.register("causal")(A.attention)
attention_methods.register("dca")(K.dual_chunk)
attention_methods.register("reattention_exact")(K.exact_recall)


@attention_methods.register("reattention")
def recalled(queries: DataFrame, kv: DataFrame, **how) -> DataFrame:
    """The relation that recall leaves."""
    return K.recall(kv, queries, **how)



@positional_methods.register("linear_pi", ("linear", "pi"))
def linear(base: float, dim: int, factor: float) -> tuple[list[float], float, float]:
    return A.inverse_frequencies(base, dim), factor, 1.0


@positional_methods.register("ntk", ("ntk_aware", "ntk-aware"))
def ntk(base: float, dim: int, factor: float) -> tuple[list[float], float, float]:
    return A.inverse_frequencies(A.ntk_base(base, factor, dim), dim), 1.0, 1.0


@positional_methods.register("yarn")
def yarn(base: float, dim: int, factor: float, original: int = 4096) -> tuple[list[float], float, float]:
    frequencies, scale = A.yarn(base, dim, factor, original)
    return frequencies, 1.0, scale

"""Token retention: scorers add ``score`` to a key-value relation, ``retain`` keeps the best.

Wrappers change how a scorer's ranking is used. Masking operators return the rows that attention is
to ignore. Ties go to the smaller position; scores are compared after rounding to nine digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..checkpoints import cut
from . import attention as A
from . import tiles
from . import vectors as V
from .relations import HEAD, with_length

Scorer = Callable[[DataFrame], DataFrame]
C = F.col
TOP = 1e30
#: Rows that one task ranks.
BAND = 1_000_000


def budget(ratio: float) -> Column:
    """Positions that stay: the whole part of k_len * (1 - ratio) in floating point."""
    return F.floor(C("k_len") * F.lit(1.0 - ratio))


def rank(*by: str | Column, score: str = "score") -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(F.round(score, 9).desc(), "pos"))


def retain(scored: DataFrame, ratio: float, most: Column | None = None) -> DataFrame:
    if ratio == 0 and most is None:
        return scored
    return scored.withColumn("_rank", rank(*HEAD)).where(C("_rank") <= (budget(ratio) if most is None else most)).drop("_rank")


# Pointwise scorers: each position is rated by itself

POINTWISE: set[Scorer] = set()


def pointwise(scorer: Callable) -> Callable:
    POINTWISE.add(scorer)
    return scorer


@pointwise
def knorm(kv: DataFrame) -> DataFrame:
    return kv.withColumn("score", -V.l2(C("key")))


def keydiff(kv: DataFrame, size: int) -> DataFrame:
    """Keys unlike the mean direction of their head score high."""
    anchor = kv.select(*HEAD, V.normalized(C("key")).alias("u")).groupBy(*HEAD).agg(V.mean_vector(C("u"), size).alias("anchor"))
    return kv.join(anchor, [*HEAD]).withColumn("score", -V.cosine(C("key"), C("anchor"))).drop("anchor")


@pointwise
def random_scores(kv: DataFrame, seed: int) -> DataFrame:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), C("layer").cast("string"), C("head").cast("string"), C("pos").cast("string")))
    return kv.withColumn("score", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0)


def streaming(kv: DataFrame, ratio: float, sinks: int = 4) -> DataFrame:
    """Sinks and the most recent positions; what follows the sinks goes."""
    pruned = C("k_len") - budget(ratio)
    return kv.withColumn("score", F.when((C("pos") >= sinks) & (C("pos") < sinks + pruned), 0.0).otherwise(1.0))


@pointwise
def qfilter(kv: DataFrame, filters: DataFrame) -> DataFrame:
    """filters: (layer, head, filter), learned elsewhere."""
    return kv.join(filters, [*HEAD]).withColumn("score", -V.dot(C("filter"), C("key"))).drop("filter")


@pointwise
def linear_surrogate(kv: DataFrame, weights: Sequence[float], bias: float = 0.0) -> DataFrame:
    return kv.withColumn("score", V.dot(C("key"), F.array(*map(F.lit, weights))) + bias)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cur(kv: DataFrame, window: int | None = 16, sinks: int = 4, kind: str = "kv_product", projection: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Squared norms normalised inside blocks of positions, and again over the head. Shares of a sum of 0
    are 0, so vectors of zeros go first. Without ``window`` norms are not normalised by blocks; with
    ``projection`` (rows of a small matrix, see ``vectors.gaussian``) they are those of the projected vectors."""
    squared = lambda c: F.aggregate(F.array(*(F.pow(V.dot(C(c), F.array(*map(F.lit, row))), F.lit(2.0)) for row in projection)), F.lit(0.0), lambda s, x: s + x) if projection else V.dot(C(c), C(c))
    out = kv.withColumns({"_k": squared("key"), "_v": squared("value")})
    if window:
        block = W.partitionBy(*HEAD, F.floor(C("pos") / window))
        out = out.withColumns({c: _share(C(c), F.sum(c).over(block)) for c in ("_k", "_v")})
    s = {"key": C("_k"), "value": C("_v"), "kv_avg": (C("_k") + C("_v")) / 2, "kv_product": C("_k") * C("_v")}[kind]
    out = out.withColumn("_s", s)
    return out.withColumn("score", F.when(C("pos") < sinks, 1.0).otherwise(_share(C("_s"), F.sum("_s").over(W.partitionBy(*HEAD))))).drop("_k", "_v", "_s")


def lagkv(kv: DataFrame, size: int, sinks: int = 4, lag: int = 16, cross: bool = False) -> DataFrame:
    """Spread of each token relative to the range of the next block; sinks and the tail stay. A channel
    that is constant in the next block adds no spread."""
    block = F.floor((C("pos") - sinks) / lag)
    blocks = F.floor((C("k_len") - sinks) / lag)
    inner = kv.where((C("pos") >= sinks) & (C("pos") < sinks + blocks * lag) & (C("k_len") >= sinks + 2 * lag)).withColumn("_b", block)
    dims, every = range(size), inner
    for c in ("key", "value"):
        ref = every.groupBy(*HEAD, (C("_b") - 1).alias("_b")).agg(F.array(*(F.min(F.get(c, F.lit(i))) for i in dims)).alias("_lo"), F.array(*(F.max(F.get(c, F.lit(i))) for i in dims)).alias("_hi"))
        inner = inner.join(ref, [*HEAD, "_b"])
        x = F.zip_with(F.zip_with(c, "_lo", lambda a, b: a - b), F.zip_with("_hi", "_lo", lambda a, b: a - b), _share)
        inner = inner.withColumn("_x", x).withColumn("_m", V.total(C("_x")) / size)
        inner = inner.withColumn("_sd", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + (v - C("_m")) * (v - C("_m"))) / (size - 1)))
        inner = A.softmax(inner, (*HEAD, "_b"), "_sd").withColumnRenamed("w", f"_{c}").drop("_lo", "_hi", "_x", "_m", "_sd")
    inner = inner.withColumn("_s", (C("_key") + C("_value")) / 2)
    if not cross:
        inner = inner.withColumn("_s", (F.row_number().over(W.partitionBy(*HEAD, "_b").orderBy(F.round("_s", 9), "pos")) - 1) / F.lit(float(lag)))
    scores = inner.select(*HEAD, "pos", "_s")
    short = F.when(C("pos") < sinks, 1.0).otherwise((C("pos") - sinks) / (C("k_len") - sinks))
    return kv.join(scores, [*HEAD, "pos"], "left").withColumn("score", F.when(C("k_len") < sinks + 2 * lag, short).otherwise(F.coalesce("_s", F.lit(1.0)))).drop("_s")


# Scorers that look at queries


def window_attention(kv: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """Causal softmax weights of the queries over all keys they see."""
    return A.softmax(A.logits(queries, kv, scale))


def pooled(c: Column, kernel: int, order: W) -> Column:
    """Centred moving sum over the kernel, edges padded with zeros, divided by the kernel."""
    return F.sum(c).over(order.rowsBetween(-(kernel // 2), kernel // 2)) / kernel


def snapkv(kv: DataFrame, queries: DataFrame, window: int, scale: float, kernel: int = 5) -> DataFrame:
    """Mean attention of the last queries over the positions before them, pooled; the window stays.

    Where positions have gaps, as in ``in_blocks``, the last queries may be many, so they meet the keys by tiles."""
    early = C("pos") < C("k_len") - window
    mass = received_mass(kv, queries, scale).withColumn("_a", C("_a") / window)
    # Ranked without the vectors.
    rows = kv.select(*HEAD, "pos", "k_len").join(mass, [*HEAD, "pos"], "left")
    rows = rows.withColumn("_p", F.when(early, pooled(C("_a"), kernel, W.partitionBy(*HEAD, early).orderBy("pos"))))
    rows = rows.select(*HEAD, "pos", F.coalesce("_p", F.max("_p").over(W.partitionBy("layer"))).alias("score"))
    return kv.join(rows, [*HEAD, "pos"], "left")


def last_query(queries: DataFrame) -> DataFrame:
    """The query at the largest position of each head."""
    return queries.withColumn("_last", F.max("qpos").over(W.partitionBy(*HEAD))).where("qpos = _last").drop("_last")


def tova(kv: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """The last query's attention averaged over heads; the last position stays."""
    last = window_attention(kv, last_query(queries), scale)
    mean = last.groupBy("layer", "pos").agg(F.sum("w").alias("_a"))
    heads = kv.groupBy("layer").agg(F.count_distinct("head").alias("_h"))
    out = kv.join(mean, ["layer", "pos"], "left").join(heads, "layer").withColumn("_a", F.coalesce("_a", F.lit(0.0)) / C("_h"))
    top = F.max("_a").over(W.partitionBy("layer"))
    return out.withColumn("score", F.when(C("pos") == C("k_len") - 1, top).otherwise(C("_a"))).drop("_a", "_h")


def received_mass(kv: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """(layer, head, pos, _a): the sum of the attention that a position receives from the queries that see it, by tiles, no row per
    pair. Vectors of a relation have one length; rows without one are left out."""
    kv, queries = kv.where("key is not null"), queries.where("query is not null")
    size = kv.select(F.size("key")).first()
    return tiles.received(queries, kv, size[0] if size else 1, scale).withColumnRenamed("mass", "_a")


def attention_mass(kv: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """Sum of the attention that each position receives, as _a."""
    return kv.join(received_mass(kv, queries, scale), [*HEAD, "pos"], "left").withColumn("_a", F.coalesce("_a", F.lit(0.0)))


def h2o(kv: DataFrame, queries: DataFrame, scale: float, window: int) -> DataFrame:
    top = F.max("_a").over(W.partitionBy("layer"))
    return attention_mass(kv, queries, scale).withColumn("score", F.when(C("pos") >= C("k_len") - window, top).otherwise(C("_a"))).drop("_a")


def observed(kv: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """Attention received per query that could see the position."""
    return attention_mass(kv, queries, scale).withColumn("score", C("_a") / (C("k_len") - C("pos"))).drop("_a")


def recalled(kv: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """The largest product with any query."""
    best = A.logits(queries, kv, scale, None).groupBy(*HEAD, "pos").agg(F.max("logit").alias("score"))
    return kv.join(best, [*HEAD, "pos"], "left")


def toward_future(key: Column, frequencies: list[float], future: int) -> Column:
    """The key as queries at the ``future`` positions behind the last see it on average: a product of it
    with an unrotated query is the mean of the products with the rotated queries.

    The mean of cosines and sines over consecutive positions is that at the middle one, times a factor.
    """
    middle = C("k_len") + F.lit((future - 1) / 2)
    shrink = [math.sin(future * f / 2) / (future * math.sin(f / 2)) if math.sin(f / 2) else 1.0 for f in frequencies]
    turned = A.rotated(key, middle, frequencies, undo=True)
    return F.zip_with(turned, F.array(*map(F.lit, [*shrink, *shrink])), lambda a, b: a * b)


def expected_attention(kv: DataFrame, queries: DataFrame, size: int, sinks: int = 4, epsilon: float = 0.0, frequencies: list[float] | None = None, future: int = 512) -> DataFrame:
    """Softmax over keys of the expected logit under the queries' mean and covariance, times the
    value's norm; sinks stay. With ``frequencies`` the queries given are unrotated, and their mean and
    covariance are those of the next ``future`` positions on average."""
    if frequencies:
        turned = kv.withColumns({"_key": C("key"), "key": toward_future(C("key"), frequencies, future)})
        return expected_attention(turned, queries, size, sinks, epsilon).drop("key").withColumnRenamed("_key", "key").select(*kv.columns, "score")
    q = queries.select(*HEAD, "query")
    mean = q.groupBy(*HEAD).agg(V.mean_vector(C("query"), size).alias("mu"))
    centred = q.join(mean, [*HEAD]).select(*HEAD, F.zip_with("query", "mu", lambda a, b: a - b).alias("c"))
    # k' S k is the mean squared product of k with the centred queries: no matrix is formed.
    spread = kv.select(*HEAD, "pos", "key").join(centred, [*HEAD]).withColumn("d", V.dot(C("key"), C("c"))).groupBy(*HEAD, "pos").agg(F.avg(C("d") * C("d")).alias("_q"))
    out = kv.join(mean, [*HEAD]).join(spread, [*HEAD, "pos"])
    out = out.withColumn("_l", V.dot(C("mu"), C("key")) / F.lit(float(size) ** 0.5) + C("_q") / F.lit(2.0 * size)).drop("mu", "_q")
    out = A.softmax(out, HEAD, "_l").withColumn("_s", (C("w") + epsilon) * V.l2(C("value")))
    return out.withColumn("score", F.when(C("pos") < sinks, F.max("_s").over(W.partitionBy("layer"))).otherwise(C("_s"))).drop("_l", "w", "_s")


# Wrappers


def in_chunks(scored: DataFrame, ratio: float, length: int) -> DataFrame:
    """The best of each chunk of positions, one at least."""
    chunk = F.floor(C("pos") / length)
    size = F.least(F.lit(length), C("k_len") - chunk * length)
    return scored.withColumn("_r", rank(*HEAD, chunk)).where(C("_r") <= F.greatest(F.lit(1), F.floor(size * F.lit(1.0 - ratio)))).drop("_r")


def whole_chunks(scored: DataFrame, ratio: float, length: int) -> DataFrame:
    """Whole chunks by mean score summed over heads, filled up with the best other positions.

    The result has the same positions in every head that has them; the longest head sets the budget.
    """
    sums = scored.groupBy("layer", "pos").agg(F.sum("score").alias("s"), F.max("k_len").alias("k_len"))
    sums = sums.withColumn("chunk", F.floor(C("pos") / length))
    chunks = sums.groupBy("layer", "chunk").agg(F.avg("s").alias("mean"), F.max("k_len").alias("k_len"))
    place = F.row_number().over(W.partitionBy("layer").orderBy(F.round("mean", 9).desc(), "chunk"))
    n = F.greatest(F.lit(1), F.floor(F.ceil(C("k_len") / length) * F.lit(1.0 - ratio)))
    chunks = chunks.withColumns({"place": place, "n": n}).select("layer", "chunk", (C("place") <= C("n")).alias("whole"), "n")
    marked = sums.join(chunks, ["layer", "chunk"])
    filled = marked.withColumn("at", F.row_number().over(W.partitionBy("layer").orderBy(C("whole").desc(), F.when(~C("whole"), F.round("s", 9)).desc(), "pos")))
    kept = filled.where(C("at") <= F.least(C("n") * length, C("k_len"))).select("layer", "pos")
    return scored.join(kept, ["layer", "pos"], "left_semi")


def in_blocks(kv: DataFrame, scorer: Scorer, ratio: float, block: int) -> DataFrame:
    """Keeps a budget of positions while blocks of ``block`` positions arrive, each scored together with
    what the budget has kept.

    For a scorer that rates each position by itself (``POINTWISE``) the outcome is that of one selection
    over all, which is what is run. Any other one sees the survivors and the new block as a relation of
    their own, block after block; a plan is written for each block, so their number is to be small.
    """
    if scorer in POINTWISE:
        return retain(scorer(kv), ratio)
    # Each block reads the relation several times.
    kv = cut(kv)
    total = kv.agg(F.max("k_len")).first()[0] or 0
    kept = None
    for first in range(0, total, block):
        new = kv.where((C("pos") >= first) & (C("pos") < first + block)).withColumn("_most", budget(ratio))
        seen = new if kept is None else kept.unionByName(new)
        names = [c for c in seen.columns if c != "k_len"]
        scored = scorer(with_length(seen.select(*names)))
        kept = cut(retain(scored, ratio, C("_most")).drop("score"))
    return kv.limit(0) if kept is None else kv.join(kept.select(*HEAD, "pos"), [*HEAD, "pos"], "left_semi")


def composed(*members: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Members one after the other; each sees the lengths that the one before left."""

    def run(kv: DataFrame) -> DataFrame:
        for m in members:
            kv = with_length(m(kv.drop("score")))
        return kv

    return run


def composed_ratio(ratios: Sequence[float]) -> float:
    left = 1.0
    for r in ratios:
        left *= 1 - r
    return 1 - left


def rerotated(kept: DataFrame, frequencies: list[float]) -> DataFrame:
    """Kept keys moved to consecutive positions: rotated by new position minus old."""
    out = kept.withColumn("new_pos", F.row_number().over(W.partitionBy(*HEAD).orderBy("pos")) - 1)
    return out.withColumn("key", A.rotated(C("key"), (C("new_pos") - C("pos")).cast("double"), frequencies))


def per_layer(scored: DataFrame, ratios: Mapping[int, float]) -> DataFrame:
    own = F.try_element_at(F.create_map(*(F.lit(x) for i, r in ratios.items() for x in (i, 1.0 - r))), C("layer"))
    return retain(scored, 0.0, F.floor(C("k_len") * own))


def critical(scored: DataFrame, ratio: float, first: float = 0.5, epsilon: float = 1e-4) -> DataFrame:
    """Half of the budget by score; the rest by score times the size of the value."""
    chosen = rank(*HEAD) <= F.floor(F.lit(1.0 - ratio) * C("k_len") * first)
    out = scored.withColumn("_c", chosen)
    return out.withColumn("score", F.when(C("_c"), TOP).otherwise((C("score") + epsilon) * V.l1(C("value")))).drop("_c")


def adaptive_mask(scored: DataFrame, ratio: float, safe: float = 0.2) -> DataFrame:
    """Rows to mask: the lowest of the layer over all heads, a share of each head's best exempt."""
    kept = budget(ratio)
    out = scored.withColumn("score", F.when(rank(*HEAD) <= F.floor(kept * safe), TOP).otherwise(C("score")))
    low = F.row_number().over(W.partitionBy("layer").orderBy(F.round("score", 9), C("head").desc(), C("pos").desc()))
    pruned = F.sum(F.when(C("pos") == 0, C("k_len") - kept)).over(W.partitionBy("layer"))
    return out.withColumns({"_low": low, "_n": pruned}).where("_low <= _n").drop("_low", "_n")


def threshold_mask(scored: DataFrame, threshold: float, window: int) -> DataFrame:
    """Rows to mask: below the threshold and out of the recent window."""
    return scored.where((C("pos") < C("k_len") - window) & (C("score") < threshold))


def streaming_heads_mask(kv: DataFrame, heads: DataFrame, share: float, sinks: int, recent: int) -> DataFrame:
    """Rows to mask: the middle of the lowest-scored heads (layer, head, head_score)."""
    place = F.row_number().over(W.orderBy(F.round("head_score", 9), "layer", "head"))
    chosen = heads.withColumns({"_r": place, "_n": F.count("*").over(W.partitionBy())}).where(C("_r") <= F.floor(C("_n") * share)).select(*HEAD)
    return kv.join(chosen, [*HEAD], "left_semi").where((C("pos") >= sinks) & (C("pos") < C("k_len") - recent))


def lowest(df: DataFrame, ratio: float, score: str = "score") -> DataFrame:
    """The lowest floor(n * ratio) of all n rows by score, then layer, head and pos.

    No task ranks all rows: approximate quantiles bound a narrow band about the cut, which is narrowed until
    it has at most ``BAND`` rows or one score; rows below it are taken as they are, and only the band is
    ranked. The bounds are verified by exact counts.
    """
    df = df.withColumn("_s", F.round(score, 9))
    share = [max(ratio - 1e-3, 0.0), min(ratio + 1e-3, 1.0)]
    bounds = df.agg(F.count("*").alias("n"), F.percentile_approx("_s", share, 10_000).alias("q")).first()
    want = int(bounds.n * ratio)
    if not want:
        return df.limit(0).drop("_s")
    low, high, below = *bounds.q, 0
    while True:
        below, within = df.agg(F.count_if(C("_s") < low), F.count_if(C("_s") <= high)).first()
        if below >= want or within < want:
            low, high = (float("-inf"), high) if below >= want else (low, float("inf"))
        elif low == high or within - below <= BAND:
            break
        else:  # closer bounds, from what lies between these
            inner = df.where((C("_s") >= low) & (C("_s") <= high))
            at = (want - below) / (within - below)
            near = inner.agg(F.percentile_approx("_s", [max(at - 1e-3, 0.0), min(at + 1e-3, 1.0)], 10_000)).first()[0]
            if near == [low, high]:
                # Quantiles cannot part these two scores: the lower one is taken whole, or is the one that is cut.
                equal, after = inner.agg(F.count_if(C("_s") == low), F.min(F.when(C("_s") > low, C("_s")))).first()
                near = [low, low] if below + equal >= want else [after, high]
            low, high = near
    inner = df.where((C("_s") >= low) & (C("_s") <= high))
    if low == high:
        # Equal scores: whole heads go first, and one head is cut by positions. Heads are as many as the model has.
        left, whole, cut = want - below, [], None
        for r in inner.groupBy(*HEAD).agg(F.count("*").alias("n")).orderBy(*HEAD).collect():
            if r.n > left:
                cut = r
                break
            whole.append((r.layer, r.head))
            left -= r.n
        mine = lambda x: (C("layer") == x[0]) & (C("head") == x[1])
        some = F.lit(False)
        for x in whole:
            some = some | mine(x)
        band = inner.where(some)
        if cut and left:
            place = F.row_number().over(W.partitionBy(*HEAD).orderBy("pos"))
            band = band.unionByName(inner.where(mine(cut)).withColumn("_p", place).where(C("_p") <= left).drop("_p"))
    else:
        place = F.row_number().over(W.orderBy("_s", "layer", "head", "pos"))
        band = inner.withColumn("_p", place).where(C("_p") <= want - below).drop("_p")
    return df.where(C("_s") < low).unionByName(band).drop("_s")


def lowest_mask(scored: DataFrame, ratio: float, sinks: int = 1) -> DataFrame:
    """Rows to mask: the lowest over all layers; sinks are exempt."""
    guarded = scored.withColumn("_g", F.when(C("pos") < sinks, TOP).otherwise(C("score")))
    return lowest(guarded, ratio, "_g").drop("_g")


def unmasked(kv: DataFrame, masked: DataFrame) -> DataFrame:
    return kv.join(masked, [*HEAD, "pos"], "left_anti")


def lazy_layers(kv: DataFrame, queries: DataFrame, scale: float, threshold: float, initial: int, recent: int) -> DataFrame:
    """Layers whose last query looks at the first and the recent positions keep only those."""
    w = window_attention(kv, last_query(queries), scale)
    ends = (C("pos") < initial) | ((C("pos") >= C("k_len") - 1 - recent) & (C("pos") < C("k_len") - 1))
    heads = kv.groupBy("layer").agg(F.count_distinct("head").alias("_h"))
    lazy = w.where(ends).groupBy("layer").agg(F.sum("w").alias("_m")).join(heads, "layer").select("layer", (C("_m") / C("_h") > threshold).alias("_lazy"))
    return kv.join(lazy, "layer").where(~C("_lazy") | (C("pos") < initial) | (C("pos") >= C("k_len") - recent + 1)).drop("_lazy")


def pruned_channels(kv: DataFrame, queries: DataFrame, ratio: float, size: int) -> DataFrame:
    """Keys with their weakest channels set to zero; shapes stay."""
    power = lambda df, c: df.select(*HEAD, F.posexplode(c).alias("channel", "x")).groupBy(*HEAD, "channel").agg(F.avg(C("x") * C("x")).alias("p"))
    both = power(kv, "key").join(power(queries, "query").withColumnRenamed("p", "q"), [*HEAD, "channel"]).withColumn("s", C("p") * C("q"))
    place = F.row_number().over(W.partitionBy(*HEAD).orderBy(F.round("s", 9), "channel"))
    dead = both.withColumn("_r", place).where(C("_r") <= int(size * ratio)).groupBy(*HEAD).agg(F.collect_set("channel").alias("_dead"))
    return kv.join(dead, [*HEAD]).withColumn("key", F.transform("key", lambda x, i: F.when(F.array_contains("_dead", i), 0.0).otherwise(x))).drop("_dead")


def pyramid_budgets(layers: int, ratio: float, window: int, beta: float = 20.0) -> Column:
    """Budgets that fall linearly from the first layer to the last about the mean of a row's length, by its layer; the
    mean where such a line would leave the bounds."""
    mean = C("k_len") * F.lit(1 - ratio)
    rest = C("k_len") - window
    wide = 2 * mean - mean / beta >= rest
    high = F.when(wide, rest).otherwise(2 * mean - mean / beta)
    low = F.when(wide, 2 * mean - rest).otherwise(mean / beta)
    holds = (C("k_len") >= high) & (high >= low) & (low >= window) & F.lit(layers > 1)
    return F.bround(F.when(holds, high - C("layer") * (high - low) / max(layers - 1, 1)).otherwise(mean))


def pyramidkv(kv: DataFrame, queries: DataFrame, ratio: float, window: int, scale: float, layers: int, kernel: int = 5, beta: float = 20.0) -> DataFrame:
    """snapkv under budgets that fall from the first to the last of ``layers``."""
    if ratio == 0:
        return kv
    return retain(snapkv(kv, queries, window, scale, kernel), ratio, pyramid_budgets(layers, ratio, window, beta))


def accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per layer the share of positions left and the least and largest length of its heads."""
    n = before.groupBy("layer").agg(F.count("*").alias("total"))
    heads = after.groupBy(*HEAD).agg(F.count("*").alias("n"))
    left = heads.groupBy("layer").agg(F.sum("n").alias("kept"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return n.join(left, "layer", "left").select("layer", "total", "kept", "shortest", "longest", (C("kept") / C("total")).alias("share"))


def stored_expectation(kv: DataFrame, stats: DataFrame, size: int, sinks: int = 4, epsilon: float = 0.0) -> DataFrame:
    """expected_attention with stored statistics: stats (layer, head, mu, sigma), sigma row by row."""
    out = kv.join(stats, [*HEAD])
    form = F.aggregate(F.zip_with("sigma", "key", lambda row, k: V.dot(row, C("key")) * k), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("_l", V.dot(C("mu"), C("key")) / F.lit(float(size) ** 0.5) + form / F.lit(2.0 * size)).drop("mu", "sigma")
    out = A.softmax(out, HEAD, "_l").withColumn("_s", (C("w") + epsilon) * V.l2(C("value")))
    return out.withColumn("score", F.when(C("pos") < sinks, F.max("_s").over(W.partitionBy("layer"))).otherwise(C("_s"))).drop("_l", "w", "_s")


def finch(kv: DataFrame, queries: DataFrame, window: int, scale: float, normalize: bool = True) -> DataFrame:
    """Mean attention of the last positions over those before, each query's weights times its position
    (about the number of keys it sees) if ``normalize``; the window stays."""
    early = C("pos") < C("k_len") - window
    weight = C("w") * C("qpos") if normalize else C("w")
    mass = window_attention(kv, queries, scale).where(early).groupBy(*HEAD, "pos").agg((F.sum(weight) / window).alias("_s"))
    out = kv.join(mass, [*HEAD, "pos"], "left")
    return out.withColumn("score", F.when(early, C("_s")).otherwise(F.max("_s").over(W.partitionBy("layer")))).drop("_s")


def finch_kept(kv: DataFrame, queries: DataFrame, ratio: float, window: int, scale: float, chunk: int | None = None, frequencies: list[float] | None = None, normalize: bool = True) -> DataFrame:
    """What finch leaves: the best of all, or with ``chunk`` of each chunk of positions; with ``frequencies``
    the kept keys are rotated to consecutive positions."""
    if ratio == 0:
        return kv
    if chunk is not None and chunk <= window / (1 - ratio):
        raise ValueError(f"chunks must be longer than {window / (1 - ratio):g}, so that the window stays")
    scored = finch(kv, queries, window, scale, normalize)
    kept = retain(scored, ratio) if chunk is None else in_chunks(scored, ratio, chunk)
    return rerotated(kept, frequencies) if frequencies else kept


def critical_adaptive_mask(scored: DataFrame, ratio: float, safe: float = 0.2, first: float = 0.5, epsilon: float = 1e-4) -> DataFrame:
    """Rows to mask: head budgets as adaptive_mask leaves them, filled in two stages as critical does."""
    kept = budget(ratio)
    out = scored.withColumn("score", F.when(rank(*HEAD) <= F.floor(kept * safe), TOP).otherwise(C("score")))
    order = F.row_number().over(W.partitionBy("layer").orderBy(F.round("score", 9).desc(), "head", "pos"))
    total = F.sum(F.when(C("pos") == 0, kept)).over(W.partitionBy("layer"))
    out = out.withColumns({"_o": order, "_t": total})
    out = out.withColumn("_b", F.sum((C("_o") <= C("_t")).cast("long")).over(W.partitionBy(*HEAD)))
    out = out.withColumn("score", F.when(rank(*HEAD) <= F.floor(C("_b") * first), TOP).otherwise((C("score") + epsilon) * V.l1(C("value"))))
    return out.withColumn("_r", rank(*HEAD)).where("_r > _b").drop("_o", "_t", "_b", "_r")


def head_areas(means: DataFrame, frequencies: list[float], length: int) -> DataFrame:
    """Score of each head: its mean query asks for its mean key at each of ``length`` positions; the
    area under the accumulated attention is high where it goes to early positions.

    means: (layer, head, query, key), mean vectors over a text.
    """
    at = means.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    q = A.rotated(C("query"), F.lit(float(length - 1)), frequencies)
    at = at.withColumn("logit", V.dot(q, A.rotated(C("key"), C("pos").cast("double"), frequencies)) / F.lit(float(2 * len(frequencies)) ** 0.5))
    w = A.softmax(at.select(*HEAD, "pos", "logit"), HEAD)
    run = F.sum("w").over(W.partitionBy(*HEAD).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return w.withColumn("_c", run).groupBy(*HEAD).agg(F.avg("_c").alias("head_score"))


def reread(kv: DataFrame, queries: DataFrame, scale: float, chunk: int, sinks: int = 1, prefix: int = 8) -> DataFrame:
    """The largest attention a key receives when its chunk is read again: the queries of a chunk, and of the
    last ``prefix`` positions before it, which lead over to it, see the sinks and the keys of the chunk."""
    own, after = F.floor(C("qpos") / chunk), F.floor((C("qpos") + prefix) / chunk)
    # A query leads over to every chunk that begins within the prefix behind it.
    q = queries.withColumn("_c", F.explode(F.sequence(own, after)))
    k = kv.withColumn("_c", F.floor(C("pos") / chunk))
    heads = q.select(*HEAD, "_c").distinct().withColumnRenamed("_c", "_q")
    seen = k.join(heads, [*HEAD]).where((C("_q") == C("_c")) | (C("pos") < sinks)).withColumn("_c", C("_q")).drop("_q")
    rows = q.join(seen, [*HEAD, "_c"]).withColumn("logit", V.dot(C("query"), C("key")) * scale)
    best = A.softmax(rows, (*A.ROW, "_c")).where(F.floor(C("pos") / chunk) == C("_c")).groupBy(*HEAD, "pos").agg(F.max("w").alias("score"))
    return kv.join(best, [*HEAD, "pos"], "left").withColumn("score", F.when(C("pos") < sinks, TOP).otherwise(F.coalesce("score", F.lit(0.0))))


def layer_counts_mask(scored: DataFrame, ratio: float) -> DataFrame:
    """Rows to mask: each layer gives up as many as it has among the lowest of all layers, and those
    are its own lowest."""
    own = lowest(scored, ratio).groupBy("layer").agg(F.count("*").alias("_own"))
    place = F.row_number().over(W.partitionBy("layer").orderBy(F.round("score", 9), "head", "pos"))
    return scored.join(own, "layer").withColumn("_p", place).where("_p <= _own").drop("_own", "_p")

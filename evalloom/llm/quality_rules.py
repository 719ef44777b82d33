"""Document quality rules and host-level verdicts, in DataFrame functions only.

Document rules work on the words ``[^\\x20\\x09-\\x0D]+`` of the whole text. A document fails the
base rules with fewer than ``MIN_WORDS`` words, or if more than ``MAX_REPEAT`` % of its words lie in
``WINDOW``-word windows that occur twice or more in it.

Host rules: a document also counts as a failure of its host if symbols exceed ``MAX_SYMBOLS`` % of
its words, or repeated lines ``MAX_LINES`` % of its words. Failures are summed per host (the
``source`` column), the failure rates of all hosts give a beta prior by the method of moments, and
each host's rate is shrunk by it. A host is rejected if the lower bound of its posterior rate, the
mean less ``Z`` standard deviations, is above ``MAX_RATE``; its documents are then not kept.

Windows are compared by 64-bit hashes of their words within one document. Per host, partial sums go
into the shuffle, never rows; hosts join back to a thin table of counts, which adaptive execution
splits where one host holds much of it, and broadcasts only where it has measured the hosts to be
few.

Nulls: a null text has no words and fails. Documents with a null source form one host. Empty tables
give no rows. Repeated rows are judged each. Columns beside doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT, MAX_SYMBOLS, MAX_LINES = 10, 5, 20, 30, 30
MAX_RATE, Z = 0.5, 2.0
#: Bounds on the weight of the prior, in documents.
WEIGHTS = (1.0, 1000.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeated(grams: Column, window: int) -> Column:
    """Words in the windows whose hash occurs at least twice in ``grams``."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, i: F.coalesce(x.g == F.get(pairs, i - 1).g, F.lit(False)) | F.coalesce(x.g == F.get(pairs, i + 1).g, F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x.i)), covered)

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(pairs, twice)).otherwise(F.lit(0))


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("doc_id", "source", F.array_remove(F.split(text, WORD_GAP), "").alias("words"), lines.alias("lines"), (F.length(text) - F.length(bare)).alias("n_symbols"))
    words = F.col("words")
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    out = out.select("doc_id", "source", "n_symbols", F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), grams.alias("grams"))
    out = out.withColumn("n_repeat_words", _repeated(F.col("grams"), WINDOW)).drop("grams")
    return out.select("doc_id", "source", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words"
FAILED = f"{BASE_FAILED} or 100 * n_symbols > {MAX_SYMBOLS} * n_words or 100 * n_dup_lines > {MAX_LINES} * n_words"


def host_verdicts(features: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failures, rate, low, rejected) for each host; rate is the shrunk failure rate."""
    sums = features.groupBy(F.col(host).alias("host")).agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.expr(FAILED), 1.0).otherwise(0.0)).alias("failures"))
    moments = sums.selectExpr("sum(n) AS n", "sum(failures) AS f", "sum(failures * failures / n) AS ff", "count(*) AS hosts").first()
    a, b = beta_prior(moments.n or 0.0, moments.f or 0.0, moments.ff or 0.0, moments.hosts)
    post = sums.selectExpr("*", f"{a!r}D + failures AS pa", f"{b!r}D + n - failures AS pb")
    post = post.selectExpr("host", "n", "failures", "pa / (pa + pb) AS rate", "sqrt(pa * pb / (pa + pb + 1)) / (pa + pb) AS sd")
    return post.selectExpr("host", "n", "failures", "rate", f"rate - {Z}D * sd AS low", f"rate - {Z}D * sd > {MAX_RATE}D AS rejected")


def beta_prior(n: float, f: float, ff: float, hosts: int) -> tuple[float, float]:
    """Parameters of the beta prior from the hosts' sums: documents, failures, and failures squared
    over documents. A single host or no spread beyond chance gives the largest weight."""
    if not n:
        return 1.0, 1.0
    mean = min(max(f / n, 1e-6), 1 - 1e-6)
    spread = ff / n - (f / n) ** 2 - mean * (1 - mean) * hosts / n
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else WEIGHTS[1]
    weight = min(max(weight, WEIGHTS[0]), WEIGHTS[1])
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame) -> DataFrame:
    """doc_id (of any type), the five counts, base_failed, kept, and the host's shrunk failure rate."""
    features = table(text_features(docs), "features")
    hosts = host_verdicts(features).select(F.col("host").alias("source"), "rate", "rejected")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    one = features.withColumn("base_failed", F.expr(BASE_FAILED)).alias("d").join(hosts.alias("h"), F.expr("d.source <=> h.source"), "left")
    return one.select("doc_id", *counts, "base_failed", F.expr("not base_failed and not rejected").alias("kept"), F.round("rate", 9).alias("host_rate"))


ORACLE = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, source, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t
), g AS (
  SELECT r, unnest(range(0, len(words) - {WINDOW - 1})) AS p, unnest(list_transform(range(0, len(words) - {WINDOW - 1}), lambda i: array_to_string(words[i + 1 : i + {WINDOW}], ' '))) AS gram FROM w WHERE len(words) >= {WINDOW}
), k AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g
), s AS (
  SELECT r, least({WINDOW}, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, {WINDOW})) AS step FROM k WHERE n > 1
), c AS (SELECT r, sum(step) AS repeated FROM s GROUP BY r), f AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN {FAILED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS failures FROM f GROUP BY source
), m AS (
  SELECT sum(n) AS n, sum(failures) / sum(n) AS raw, least(greatest(sum(failures) / sum(n), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS mean,
    sum(failures * failures / n) / sum(n) AS ff, count(*) AS hosts FROM h
), v AS (SELECT mean, ff - raw * raw - mean * (1 - mean) * hosts / n AS spread FROM m), p AS (
  SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE {WEIGHTS[1]}::DOUBLE END, {WEIGHTS[0]}::DOUBLE), {WEIGHTS[1]}::DOUBLE) AS weight FROM v
), q AS (SELECT source, mean * weight + failures AS pa, (1 - mean) * weight + n - failures AS pb FROM h, p), j AS (
  SELECT source, pa / (pa + pb) AS rate, pa / (pa + pb) - {Z}::DOUBLE * sqrt(pa * pb / (pa + pb + 1)) / (pa + pb) > {MAX_RATE} AS rejected FROM q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  NOT ({BASE_FAILED}) AND NOT rejected AS kept, round(rate, 9) AS host_rate
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""

"""Token choice over logits made from the vectors table: ids are sequences, channels are tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding as D
from .base import query, read

C = F.col
_L = "l AS (SELECT vec_id AS sequence, label AS step, unnest(range(0, 64)) AS token, unnest(list_transform(embedding, lambda x: x::DOUBLE * 20)) AS logit FROM embeddings)"
_P = f"{_L}, e AS (SELECT *, exp(logit / 0.7::DOUBLE - max(logit / 0.7::DOUBLE) OVER (PARTITION BY sequence, step)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sequence, step) AS p FROM e), b AS (SELECT *, sum(p) OVER (PARTITION BY sequence, step ORDER BY round(p, 12) DESC, token ROWS UNBOUNDED PRECEDING) - p AS before FROM p), k AS (SELECT sequence, step, token, p / sum(p) OVER (PARTITION BY sequence, step) AS p FROM b WHERE round(before, 12) <= 0.8)"


def logits(s, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 20)
    return read(s, d, "embeddings").select(C("vec_id").alias("sequence"), C("label").alias("step"), F.posexplode(v).alias("token", "logit"))


@query("decode_greedy", f"WITH {_L} SELECT sequence, step, token FROM l QUALIFY row_number() OVER (PARTITION BY sequence, step ORDER BY round(logit, 9) DESC, token) = 1")
def _(s, d):
    return D.greedy(logits(s, d))


@query("decode_nucleus", f"WITH {_P} SELECT sequence, step, token, round(p, 6) AS p FROM k")
def _(s, d):
    return D.nucleus(logits(s, d), 0.7, 0.8).select("sequence", "step", "token", F.round("p", 6).alias("p"))


@query("decode_sampled", f"WITH {_P}, u AS (SELECT *, sum(p) OVER (PARTITION BY sequence, step ORDER BY token ROWS UNBOUNDED PRECEDING) AS c, ('0x' || substr(md5('5:' || sequence || ':' || step), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM k) SELECT sequence, step, coalesce(min(token) FILTER (WHERE c > u), max(token)) AS token FROM u GROUP BY ALL")
def _(s, d):
    return D.sampled(D.nucleus(logits(s, d), 0.7, 0.8), 5)


@query("decode_until_stop", r"SELECT doc_id, CASE WHEN list_position(w, 'the') > 0 THEN list_position(w, 'the') - 1 ELSE len(w) END::INT AS n FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def _(s, d):
    from ..functions import text

    w = text.words(C("text"))
    return read(s, d, "documents").select("doc_id", F.size(D.until_stop(w, F.lit("the"))).alias("n"))

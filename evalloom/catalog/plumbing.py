"""Plumbing and rollups over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import plumbing as P
from ..operators import rollup as R
from .base import PREDICTIONS, predictions, query, read, sql_answer_tokens, sql_f1

C = F.col


def rows(s, d):
    return read(s, d, "documents").select(C("doc_id").alias("ord"), C("text").alias("context"), C("lang").alias("task"), "source", "n_chars")


@query("plumb_defaults", "SELECT doc_id AS ord, lang AS task, '' AS answer_prefix, 64 AS max_new_tokens, md5(text || source || '') AS prompt FROM documents")
def _(s, d):
    df = P.with_defaults(P.require(rows(s, d).withColumnRenamed("source", "question")))
    return df.select("ord", "task", "answer_prefix", "max_new_tokens", F.md5(P.prompt(C("context"), C("question"), C("answer_prefix"))).alias("prompt"))


@query("plumb_query_aware", "SELECT doc_id AS ord, md5(text || source) AS context, '' AS question FROM documents")
def _(s, d):
    return P.query_aware(rows(s, d).withColumnRenamed("source", "question")).select("ord", F.md5("context").alias("context"), "question")


@query("plumb_stack", "SELECT doc_id AS ord, lang AS task, 'dev' AS split, NULL::BIGINT AS length FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, 'test', n_chars FROM documents WHERE doc_id % 2 = 1")
def _(s, d):
    base = rows(s, d)
    a = base.where("ord % 2 = 0").select("ord", "task", F.lit("dev").alias("split"))
    b = base.where("ord % 2 = 1").select("ord", "task", F.lit("test").alias("split"), C("n_chars").alias("length"))
    return P.stack(a, b)


@query("plumb_sample", "SELECT doc_id AS ord, lang AS task FROM documents QUALIFY row_number() OVER (ORDER BY md5('7:' || doc_id::VARCHAR)) <= (SELECT round_even(0.15::DOUBLE * count(*), 0) FROM documents)")
def _(s, d):
    return P.sample_fraction(rows(s, d).select("ord", "task"), 0.15, 7)


@query("plumb_cap_per_task", "SELECT ord, task FROM (SELECT doc_id AS ord, lang AS task, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents WHERE lang IS NOT NULL) WHERE rk <= CASE task WHEN 'fr' THEN 3 WHEN 'de' THEN 0 ELSE 10 END")
def _(s, d):
    return P.cap_per_task(rows(s, d).select("ord", "task"), 10, {"fr": 3, "de": 0})


@query("plumb_first_rows", "SELECT doc_id AS ord, lang AS task FROM documents ORDER BY doc_id LIMIT 25")
def _(s, d):
    return P.first_rows(rows(s, d).select("ord", "task"), 25)


@query("plumb_cut", r"""WITH w AS (SELECT doc_id AS ord, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT ord, array_to_string(w[1:50], ' ') AS head, CASE WHEN len(w) <= 50 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:25], ' ') || ' ' || array_to_string(w[-25:], ' ') END AS middle FROM w""")
def _(s, d):
    w = text.words(C("context"))
    return rows(s, d).select("ord", F.array_join(P.cut_head(w, 50), " ").alias("head"), F.array_join(P.cut_middle(w, 50), " ").alias("middle"))


@query("plumb_spans", r"SELECT page_id, md5(substr(html, 1, n // 2)) AS context, md5(regexp_replace(substr(html, n // 2 + 1, n // 4), '^\s+|\s+$', '', 'g')) AS question, md5(regexp_replace(substr(html, n // 2 + n // 4 + 1), '^\s+|\s+$', '', 'g')) AS answer_prefix FROM (SELECT page_id, html, length(html) AS n FROM pages)")
def _(s, d):
    n = F.length("html")
    a, b = F.floor(n / 2).cast("int"), F.floor(n / 2).cast("int") + F.floor(n / 4).cast("int")
    return read(s, d, "pages").select("page_id", *(F.md5(v).alias(k) for k, v in P.spans(C("html"), a, b).items()))


@query("plumb_split_prompt", """WITH p AS (SELECT doc_id AS ord, text AS c, doc_id % 3 AS k FROM documents)
SELECT ord, md5(CASE WHEN k = 2 THEN NULL WHEN k = 1 THEN c || ' What is the number? no.' ELSE c END) AS context, CASE k WHEN 2 THEN NULL ELSE ' What is the number? ' END AS question, CASE k WHEN 2 THEN NULL ELSE 'It is' END AS answer_prefix FROM p""")
def _(s, d):
    c, k = C("context"), C("ord") % 3
    said = F.when(k == 2, c).when(k == 1, F.concat(c, F.lit(" What is the number? no. What is the number? It is"))).otherwise(F.concat(c, F.lit(" What is the number? It is")))
    out = P.split_prompt(said, F.lit(" What is the number"))
    return rows(s, d).select("ord", out.alias("x")).select("ord", F.md5("x.context").alias("context"), "x.question", "x.answer_prefix")


@query("plumb_strip_system", "SELECT doc_id AS ord, md5('<|begin_of_text|>' || source || text) AS out FROM documents")
def _(s, d):
    said = F.concat(F.lit("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\nCutting\nDate<|eot_id|>"), C("source"), C("context"))
    return rows(s, d).select("ord", F.md5(P.strip_system_block(said)).alias("out"))


@query("plumb_derived_columns", """SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE lang END AS task, CASE lang WHEN 'de' THEN 30 WHEN 'fr' THEN 50 ELSE 128 END AS max_new_tokens,
  coalesce(try_cast(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE n_chars::VARCHAR END AS INT), 128000) AS length, CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS bucket,
  CASE WHEN doc_id % 5 = 0 THEN source ELSE lang END AS first FROM documents""")
def _(s, d):
    return rows(s, d).select(
        "ord",
        P.derive_task(F.when(C("ord") % 2 == 0, "given"), F.concat(C("task"), F.lit("_64k")), "64k").alias("task"),
        P.by_task(C("task"), {"de": 30, "fr": 50}, 128).alias("max_new_tokens"),
        P.int_or(F.when(C("ord") % 3 == 0, "x").otherwise(C("n_chars").cast("string")), 128000).alias("length"),
        P.length_bucket(C("n_chars")).alias("bucket"),
        P.first_non_empty(F.when(C("ord") % 5 == 0, " \n").otherwise(C("task")), C("source")).alias("first"),
    )


@query("plumb_answer_candidates", "SELECT doc_id AS ord, array_to_string(list_filter([lang, CASE WHEN source <> lang THEN source END, (doc_id % 10)::VARCHAR], lambda x: x IS NOT NULL), '|') AS answers FROM documents")
def _(s, d):
    n = (C("ord") % 10).cast("string")
    return rows(s, d).select("ord", F.array_join(P.answer_candidates(F.array(C("task"), F.lit(" ")), F.array("source", "task"), F.array(F.concat(F.lit(" "), n), n)), "|").alias("answers"))


@query("group_by_context", """WITH g AS (SELECT doc_id AS ord, sha256(text) AS context_key, lang, n_chars FROM documents WHERE text IS NOT NULL)
SELECT context_key, min(ord) AS first_ord, count(*) AS n_rows, CASE WHEN count(DISTINCT lang) = 1 AND count(lang) = count(*) THEN min(lang) END AS answer_prefix, min_by(n_chars, ord) AS max_new_tokens FROM g GROUP BY context_key""")
def _(s, d):
    return P.context_groups(rows(s, d).select("ord", "context", C("task").alias("answer_prefix"), C("n_chars").alias("max_new_tokens")))


@query("group_not_uniform", "SELECT lang AS key, count(DISTINCT source) AS n FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1")
def _(s, d):
    return P.require_uniform(rows(s, d).withColumnRenamed("task", "key"), "key", "source")


@query("group_count", "SELECT count(DISTINCT text) AS n FROM documents")
def _(s, d):
    return rows(s, d).agg(F.count_distinct(F.sha2("context", 256)).alias("n"))


# Rollups over the F1 of the prediction rows

_F = f"{PREDICTIONS}, t AS (SELECT *, {sql_answer_tokens('prediction')} AS pa, {sql_answer_tokens('gold')} AS ga FROM preds), f AS (SELECT *, {sql_f1('pa', 'ga')} AS score FROM t)"


def scored(s, d):
    t = lambda c: text.answer_tokens(C(c))
    out = predictions(s, d).withColumns({"p": t("prediction"), "g": t("gold")})
    return out.select("ord", "task", "source", "length", "prediction", metrics.f1(C("p"), C("g")).alias("score"))


@query("rollup_rounded_macro", f"WITH {_F}, k AS (SELECT task, round_even(avg(score) * 100, 2) AS score, count(*) AS n FROM f GROUP BY task) SELECT task, round(score, 6) AS score, n FROM k UNION ALL SELECT 'overall', round(avg(score), 6), sum(n)::BIGINT FROM k")
def _(s, d):
    return R.with_macro(scored(s, d), digits=2).select("task", F.round("score", 6).alias("score"), "n")


@query("rollup_micro", f"WITH {_F} SELECT round(avg(score) * 100, 6) AS score, count(*) AS n FROM f")
def _(s, d):
    return scored(s, d).agg(F.round(R.percent("score"), 6).alias("score"), F.count("*").alias("n"))


@query("rollup_two_levels", f"""WITH {_F}, b AS (SELECT *, CASE WHEN length < 4000 THEN '0-4k' WHEN length < 8000 THEN '4-8k' ELSE '8k+' END AS bucket FROM f)
SELECT bucket AS context_length, task, round(avg(score) * 100, 6) AS score, count(*) AS n, grouping(bucket)::INT AS all_lengths FROM b GROUP BY GROUPING SETS ((task), (bucket, task))""")
def _(s, d):
    out = R.two_levels(scored(s, d).withColumn("context_length", P.length_bucket(C("length"))))
    return out.select("context_length", "task", F.round("score", 6).alias("score"), "n", C("all_lengths").cast("int").alias("all_lengths"))


@query("rollup_length_macro", f"""WITH {_F}, b AS (SELECT task, CASE WHEN length < 4000 THEN '0-4k' WHEN length < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, avg(score) * 100 AS score FROM f GROUP BY ALL)
SELECT bucket AS context_length, round(avg(score), 6) AS score FROM b GROUP BY bucket""")
def _(s, d):
    return R.length_macro(R.two_levels(scored(s, d).withColumn("context_length", P.length_bucket(C("length"))))).select("context_length", F.round("score", 6).alias("score"))


@query("rollup_bucket_of_some_tasks", f"""WITH {_F} SELECT task, CASE WHEN length < 4000 THEN '0-4k' WHEN length < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, round(avg(score) * 100, 6) AS score FROM f WHERE task LIKE '%e' GROUP BY ALL""")
def _(s, d):
    return scored(s, d).where(C("task").endswith("e")).groupBy("task", P.length_bucket(C("length")).alias("bucket")).agg(F.round(R.percent("score"), 6).alias("score"))


@query("rollup_shrinking_mean", f"WITH {_F} SELECT task, round(avg(score) FILTER (WHERE prediction <> ''), 9) AS coverage FROM f GROUP BY task")
def _(s, d):
    return scored(s, d).groupBy("task").agg(F.round(R.shrinking_mean(C("score"), C("prediction") != ""), 9).alias("coverage"))


@query("rollup_rates", f"WITH {_F} SELECT round(avg((prediction <> '')::INT) * 100, 6) AS extraction_rate, round(avg((score > 0.5)::INT) * 100, 6) AS accuracy, round(avg(length(prediction)), 6) AS response_length, count(*) AS n FROM f")
def _(s, d):
    aggs = [F.round(v, 6).alias(k) for k, v in R.rates(C("prediction"), C("score") > 0.5).items()]
    return scored(s, d).agg(*aggs, F.round(R.response_length(C("prediction")), 6).alias("response_length"), F.count("*").alias("n"))


@query("rollup_frequencies", "SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, source LIMIT 7")
def _(s, d):
    return R.frequencies(read(s, d, "documents"), "source", 7)


@query("rollup_complete_counts", "SELECT l.label, count(p.label) AS n FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN (SELECT label FROM embeddings WHERE vec_id % 50 = 0) p ON l.label = p.label GROUP BY l.label")
def _(s, d):
    e = read(s, d, "embeddings")
    return R.complete_counts(e.where("vec_id % 50 = 0"), e.select("label").distinct(), "label")


@query("rollup_best_parameter", "WITH g AS (SELECT a::DOUBLE / 10 AS alpha, (SELECT round(avg(abs(score - a::DOUBLE / 10)), 9) FROM (SELECT (n_chars % 100)::DOUBLE / 100 AS score FROM documents)) AS risk FROM range(0, 11) t(a)) SELECT min_by(alpha, risk * 1000 + alpha * 1e-9) AS alpha, min(risk) AS risk FROM g")
def _(s, d):
    docs = read(s, d, "documents").select(((C("n_chars") % 100).cast("double") / 100).alias("score"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("a"))
    grid = docs.groupBy((C("a").cast("double") / 10).alias("alpha")).agg(F.round(F.avg(F.abs(C("score") - C("a").cast("double") / 10)), 9).alias("risk"))
    return R.best_parameter(grid, "alpha", "risk")

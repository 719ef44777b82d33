"""Whole reports of benchmarks, and answering by context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import plumbing as P
from ..operators import retrieval as G
from ..operators import rollup as R
from ..plans import contexts, evaluation  # noqa: F401 - registers the benchmarks
from ..registry import answerers, benchmarks
from .base import quoted, query, read, sql_f1, sql_normal, sql_tokens

C = F.col


def _rows(s, d) -> DataFrame:
    """Rows of a benchmark: a conversation's user turn is the question, the assistant's turn after it the prediction;
    gold answers are the first words of that turn and the number of the conversation."""
    turns = read(s, d, "conversations")
    said = turns.where("role = 'assistant'").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("prediction"))
    both = turns.where("role = 'user'").select("conv_id", "turn", C("text").alias("question")).join(said, ["conv_id", "turn"])
    words = F.filter(F.split("prediction", r"\s+"), lambda x: x != "")
    gold = F.array(F.array_join(F.slice(words, 1, 5), " "), C("conv_id").cast("string"))
    return both.select("conv_id", "turn", "question", "prediction", gold.alias("answer"))


_ROWS = r"""r AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS prediction, [array_to_string(list_filter(string_split_regex(a.text, '\s+'), lambda x: x <> '')[1:5], ' '), u.conv_id::VARCHAR] AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def _report(name: str, rows: DataFrame) -> DataFrame:
    bench = benchmarks.get(name)
    return bench.rollup(bench.score(rows)).select("scope", F.coalesce("task", F.lit("-")).alias("task"), "metric", F.round("value", 6).alias("value"))


def _exact_round(x: str) -> str:
    """SQL of the nearest hundredth, half to even, for values whose product with 100 is exact or off the middle."""
    side = f"({x} * 100 - floor({x} * 100) - 0.5)"
    return f"(floor({x} * 100) + CASE WHEN {side} > 0 OR ({side} = 0 AND floor({x} * 100) % 2 = 1) THEN 1 ELSE 0 END) / 100"


_TOTAL = "SELECT 'total_samples' AS scope, '-' AS task, 'count' AS metric, count(*)::DOUBLE AS value FROM s"


def _contained(p: str, answers: str) -> str:
    return f"CASE WHEN {sql_normal(p)} <> '' AND len(list_filter({answers}, lambda a: {sql_normal('a')} <> '' AND (contains({sql_normal(p)}, {sql_normal('a')}) OR contains({sql_normal('a')}, {sql_normal(p)})))) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END"


_TASK = "'t' || (conv_id % 3)::VARCHAR"


@query("benchmark_ruler", f"WITH {_ROWS}, s AS (SELECT *, {_TASK} AS task, {_contained('prediction', 'answer')} AS score FROM r) {_TOTAL} UNION ALL SELECT 'task_scores', task, 'score', {_exact_round('avg(score) * 100')} FROM s GROUP BY task UNION ALL SELECT 'overall', '-', 'score', round(avg(v), 6) FROM (SELECT {_exact_round('avg(score) * 100')} AS v FROM s GROUP BY task)")
def _(s, d):
    return _report("ruler", _rows(s, d).withColumn("task", F.concat(F.lit("t"), (C("conv_id") % 3).cast("string"))))


_F1S = f"greatest({', '.join(sql_f1('tp', f'tg{k}') for k in (1, 2))})"


@query("benchmark_loogle", f"""WITH {_ROWS}, t AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'shortdep_cloze' ELSE 'longdep_qa' END AS task, {sql_tokens('prediction')} AS tp, {sql_tokens('answer[1]')} AS tg1, {sql_tokens('answer[2]')} AS tg2 FROM r),
s AS (SELECT *, CASE WHEN task = 'shortdep_cloze' THEN (len(list_filter(answer, lambda a: {sql_normal('a')} = {sql_normal('prediction')})) > 0)::INT::DOUBLE ELSE {_F1S} END AS score FROM t)
{_TOTAL} UNION ALL SELECT 'task_scores', task, 'score', round(avg(score) * 100, 6) FROM s GROUP BY task UNION ALL SELECT 'overall', '-', 'score', round(avg(v), 6) FROM (SELECT avg(score) * 100 AS v FROM s GROUP BY task)""")
def _(s, d):
    return _report("loogle", _rows(s, d).withColumn("task", F.when(C("conv_id") % 2 == 0, "shortdep_cloze").otherwise("longdep_qa")))


@query("benchmark_zero_scrolls", f"WITH {_ROWS}, s AS (SELECT *, {_TASK} AS task FROM r), m AS (SELECT task, avg(length(prediction)) AS a, count(*)::DOUBLE AS n FROM s GROUP BY task) {_TOTAL} UNION ALL SELECT 'overall', '-', 'score', 0 UNION ALL SELECT 'overall', '-', 'avg_response_length', round(avg(a), 6) FROM m UNION ALL SELECT 'task_scores', task, 'avg_response_length', round(a, 6) FROM m UNION ALL SELECT 'task_scores', task, 'num_samples', n FROM m")
def _(s, d):
    return _report("zero_scrolls", _rows(s, d).withColumn("task", F.concat(F.lit("t"), (C("conv_id") % 3).cast("string"))))


@query("benchmark_aime", f"WITH {_ROWS}, s AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE (conv_id % 7)::VARCHAR END AS found, (conv_id % 5)::VARCHAR AS gold FROM r) {_TOTAL} UNION ALL SELECT 'overall', '-', m, round(v, 6) FROM (SELECT unnest(['score', 'exact_match', 'extraction_rate']) AS m, unnest([avg((found = gold)::INT) * 100, avg((found = gold)::INT) * 100, avg((found <> '')::INT) * 100]) AS v FROM s)")
def _(s, d):
    said = F.when(C("conv_id") % 3 == 0, "none").otherwise(F.concat(F.lit("so \\boxed{"), (C("conv_id") % 7).cast("string"), F.lit("}")))
    return _report("aime", _rows(s, d).withColumns({"prediction": said, "answer": F.array((C("conv_id") % 5).cast("string"))}))


_LOFT_TASK = "CASE conv_id % 3 WHEN 0 THEN 'quest_32k' WHEN 1 THEN 'qampari_32k' ELSE 'nq_32k' END"


@query("benchmark_loft", f"""WITH {_ROWS}, t AS (SELECT {_LOFT_TASK} AS task, conv_id % 3 < 2 AS several, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE ['alpha beta', 'n' || (turn % 3)::VARCHAR] END AS items, ['n' || (conv_id % 3)::VARCHAR, 'alpha beta'] AS gold FROM r),
s AS (SELECT *, CASE WHEN items IS NULL THEN 0 WHEN several THEN (items[2] = gold[1])::INT ELSE 1 END::DOUBLE AS subspan, CASE WHEN items IS NULL THEN 0 WHEN several THEN (items[2] = gold[1])::INT ELSE 1 END::DOUBLE AS em,
  CASE WHEN several THEN NULL WHEN items IS NULL THEN 0 ELSE 1 END::DOUBLE AS f1, CASE WHEN several AND items IS NOT NULL THEN CASE WHEN items[2] = gold[1] THEN 1 ELSE 0.5 END END::DOUBLE AS coverage FROM t),
m AS (SELECT task, avg(subspan) * 100 AS subspan_em, avg(em) * 100 AS em, avg(f1) * 100 AS f1, CASE WHEN task <> 'nq_32k' THEN coalesce(avg(coverage) * 100, 0) END AS coverage FROM s GROUP BY task),
u AS (SELECT task, metric, value FROM m UNPIVOT (value FOR metric IN (subspan_em, em, f1, coverage)))
{_TOTAL} UNION ALL SELECT 'overall', '-', 'score', round(avg(subspan_em), 6) FROM m UNION ALL SELECT 'overall_metrics', '-', metric, round(avg(value), 6) FROM u GROUP BY metric UNION ALL SELECT 'task_scores', task, metric, round(value, 6) FROM u""")
def _(s, d):
    k = C("conv_id")
    said = F.when(k % 4 == 0, "no list").otherwise(F.concat(F.lit("Final Answer: ['alpha beta', 'n"), (C("turn") % 3).cast("string"), F.lit("']")))
    gold = F.array(F.concat(F.lit("n"), (k % 3).cast("string")), F.lit("alpha beta"))
    task = F.when(k % 3 == 0, "quest_32k").when(k % 3 == 1, "qampari_32k").otherwise("nq_32k")
    return _report("loft", _rows(s, d).drop("answer").withColumns({"prediction": said, "answers": gold, "task": task}))


@query("context_answers", r"SELECT doc_id AS ord, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::VARCHAR || ':' || lang AS prediction FROM documents")
def _(s, d):
    rows = read(s, d, "documents").select(C("doc_id").alias("ord"), C("text").alias("context"), C("lang").alias("question"))
    return answerers.get("counted")(rows).select("ord", "prediction")


@query("context_retrieval")
def _(s, d):
    rows = read(s, d, "documents").select(C("doc_id").alias("ord"), C("text").alias("context"), F.regexp_extract("text", r"(\S+)\s*$", 1).alias("question"))
    return answerers.get("rag")(rows).select("ord", "prediction")


@query("retrieval_refine_prompt", "SELECT doc_id, md5('The original question is: ' || lang || chr(10) || 'Existing answer: ' || source || chr(10) || 'Additional context is below.' || chr(10) || '---------------------' || chr(10) || text || chr(10) || '---------------------' || chr(10) || 'Refine the existing answer using the additional context if it is helpful. Otherwise keep the existing answer. If the answer is not in the context, output only the word: unanswerable' || chr(10) || 'Refined answer:') AS prompt FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(G.refine_prompt(C("lang"), C("source"), C("text"))).alias("prompt"))


@query("plumb_chat_body", f"SELECT doc_id AS ord, md5(CASE doc_id % 3 WHEN 2 THEN regexp_replace(text, '\\s+$', '') ELSE text END) AS body, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS context, md5({quoted('<s>')} || text) AS before, '</s>' AS suffix FROM documents")
def _(s, d):
    docs = read(s, d, "documents")
    k, t = C("doc_id") % 3, C("text")
    framed = F.concat(F.lit("<|im_start|>system\nx<|im_end|>\n<|im_start|>user\n"), t, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    said = F.when(k == 0, framed).when(k == 1, F.concat(t, F.lit("<|im_end|> \n"))).otherwise(t)
    split = P.sentinel_split(F.concat(F.lit("<s>"), t, F.lit("@@#@@</s>")), F.lit("@@#@@"))
    given = F.when(C("doc_id") % 2 == 0, F.when(C("doc_id") % 4 == 0, ""))
    return docs.select(C("doc_id").alias("ord"), F.md5(P.chat_body(said)).alias("body"), P.context_or_question(F.when(C("doc_id") % 2 == 1, C("source")).otherwise(given), C("lang")).alias("context"), F.md5(split.getField("context")).alias("before"), split.getField("suffix").alias("suffix"))


@query("rollup_exact_rounding", "SELECT doc_id, (h // 128 + CASE WHEN h % 128 > 64 OR (h % 128 = 64 AND h // 128 % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100 AS value FROM (SELECT doc_id, n_chars % 10000 * 100 AS h FROM documents)")
def _(s, d):
    return read(s, d, "documents").select("doc_id", R.rounded((C("n_chars") % 10000).cast("double") / 128).alias("value"))

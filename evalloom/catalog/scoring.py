"""Normalisation, extraction and metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, metrics, segment, text
from .base import PREDICTIONS, predictions, query, quoted, read, sql_answer_tokens, sql_f1, sql_normal, sql_overlap, sql_tokens

C = F.col
HALF = "round({}, 9)"


def _r(c):
    return F.round(c, 9)


_NORMAL = r"""SELECT doc_id, md5({}) AS out FROM documents"""


@query("text_normalize", _NORMAL.format(sql_normal("text")))
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(text.normalize_text(C("text"))).alias("out"))


@query("text_normalize_answer", _NORMAL.format(f"array_to_string({sql_answer_tokens('text')}, ' ')"))
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(text.normalize_answer(C("text"))).alias("out"))


@query("text_normalize_decomposed")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(text.normalize_decomposed(C("text"))).alias("out"))


@query("text_normalize_chinese", _NORMAL.format(rf"regexp_replace(translate(lower(text), {quoted(text.PUNCTUATION + text.CHINESE_PUNCTUATION)}, ''), '\s+', '', 'g')"))
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(text.normalize_chinese(C("text"))).alias("out"))


@query("text_clean_prediction", r"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\x00-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g'))) AS out FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(text.clean_prediction(C("text"))).alias("out"))


@query("text_first_line", r"SELECT doc_id, string_split(regexp_replace(text, '^\n+', ''), chr(10))[1] AS out FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.first_line(C("text")).alias("out"))


@query("text_first_code_line", r"SELECT page_id, coalesce(list_filter(string_split(regexp_replace(replace(html, '><', '>' || chr(10) || '<'), '^\n+', ''), chr(10)), lambda x: NOT (contains(x, '`') OR contains(x, '#') OR contains(x, '//')))[1], '') AS out FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", text.first_code_line(F.replace(C("html"), F.lit("><"), F.lit(">\n<"))).alias("out"))


@query("text_bold_strip", "SELECT doc_id, length(CASE WHEN regexp_replace(lang || '_e', '_e$', '') IN ('en') THEN text ELSE replace(text, '**', '') END) AS n, regexp_replace(source || '_e', '_e$', '') AS base, split_part(source || '_x_y', '_', 1) AS category FROM documents")
def _(s, d):
    task = F.concat(C("lang"), F.lit("_e"))
    out = F.when(text.base_task(task).isin("en"), C("text")).otherwise(F.replace(C("text"), F.lit("**"), F.lit("")))
    return read(s, d, "documents").select("doc_id", F.length(out).cast("long").alias("n"), text.base_task(F.concat(C("source"), F.lit("_e"))).alias("base"), text.task_category(F.concat(C("source"), F.lit("_x_y"))).alias("category"))


@query("text_slug", "SELECT page_id, replace(replace(coalesce(url, ''), '/', '--'), ',', '-') || '__' || page_id::VARCHAR AS slug FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", text.slug(F.coalesce(C("url"), F.lit("")), C("page_id").cast("string")).alias("slug"))


# Extraction

_CHOICE = """ch AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'B or A? The correct answer is (' || l || ').' WHEN 1 THEN '**The correct answer is ' || l || '**' ELSE 'maybe A, then ' || l END AS said
  FROM (SELECT doc_id, substr('ABCD', (doc_id % 4)::INT + 1, 1) AS l FROM documents)
)"""


def choices(s, d) -> DataFrame:
    letter = F.substring(F.lit("ABCD"), (C("doc_id") % 4 + 1).cast("int"), F.lit(1))
    said = F.when(C("doc_id") % 3 == 0, F.concat(F.lit("B or A? The correct answer is ("), letter, F.lit(")."))).when(C("doc_id") % 3 == 1, F.concat(F.lit("**The correct answer is "), letter, F.lit("**"))).otherwise(F.concat(F.lit("maybe A, then "), letter))
    return read(s, d, "documents").select("doc_id", said.alias("said"))


@query("extract_choice", rf"""WITH {_CHOICE} SELECT doc_id, regexp_extract(upper(said), '\b([A-D])\b', 1) AS first,
  coalesce(nullif(regexp_extract(replace(said, '*', ''), 'The correct answer is \(([A-D])\)', 1), ''), nullif(regexp_extract(replace(said, '*', ''), 'The correct answer is ([A-D])', 1), ''), regexp_extract_all(upper(said), '\b([A-D])\b', 1)[-1], '') AS steered FROM ch""")
def _(s, d):
    return choices(s, d).select("doc_id", extract.option_letter(C("said")).alias("first"), extract.steered_choice(C("said")).alias("steered"))


@query("extract_numbers", r"""WITH x AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '\b[0-9]+\b'), lambda n: regexp_replace(n, '^0+([0-9])', '\1')), lambda n: length(n) <= 3) AS small FROM pages)
SELECT page_id, coalesce(regexp_extract_all(html, '-?[0-9]+(?:\.[0-9]+)?')[-1], '') AS last, regexp_extract(html, '[0-9]+') AS first, coalesce(small[-1], '') AS small FROM x""")
def _(s, d):
    return read(s, d, "pages").select("page_id", extract.last_number(C("html")).alias("last"), extract.first_digits(C("html")).alias("first"), extract.int_up_to_999(C("html")).alias("small"))


@query("extract_boxed", r"""SELECT doc_id, coalesce(CASE WHEN doc_id < 1000 THEN doc_id::VARCHAR END, (doc_id % 7)::VARCHAR) AS n FROM documents""")
def _(s, d):
    said = F.concat(F.lit("3 then \\boxed{12} and \\boxed{x = "), C("doc_id").cast("string"), F.lit("} or "), (C("doc_id") % 7).cast("string"))
    return read(s, d, "documents").select("doc_id", extract.int_up_to_999(said).alias("n"))


@query("extract_answer_lists", "SELECT doc_id, lang || '|' || source AS parsed, lang || '|' || doc_id AS listed FROM documents")
def _(s, d):
    said = F.concat(F.lit("['"), C("lang"), F.lit("' '"), C("source"), F.lit("']"))
    line = F.concat(F.lit("so\n**Final**: ['"), C("lang"), F.lit("', "), C("doc_id").cast("string"), F.lit("]\n[x]"))
    return read(s, d, "documents").select("doc_id", F.array_join(extract.parse_answers(said), "|").alias("parsed"), F.array_join(extract.extract_list(line), "|").alias("listed"))


# Metrics

_T = f"{PREDICTIONS}, t AS (SELECT *, {sql_tokens('prediction')} AS p, {sql_tokens('gold')} AS g, {sql_answer_tokens('prediction')} AS pa, {sql_answer_tokens('gold')} AS ga FROM preds)"


@query("metric_overlap", f"WITH {_T} SELECT ord, ({sql_overlap('p', 'g')})::INT AS same FROM t")
def _(s, d):
    t = lambda c: text.text_tokens(C(c))
    return predictions(s, d).select("ord", t("prediction").alias("p"), t("gold").alias("g")).select("ord", metrics.overlap(C("p"), C("g")).alias("same"))


@query("metric_token_f1", f"WITH {_T} SELECT ord, round({sql_f1('p', 'g')}, 9) AS f1 FROM t")
def _(s, d):
    t = lambda c: text.text_tokens(C(c))
    return predictions(s, d).select("ord", t("prediction").alias("p"), t("gold").alias("g")).select("ord", _r(metrics.f1(C("p"), C("g"))).alias("f1"))


@query("metric_exact_and_containment", f"""WITH {PREDICTIONS}, n AS (SELECT ord, {sql_normal('prediction')} AS p, {sql_normal('gold')} AS g FROM preds)
SELECT ord, (p = g OR p = 'x')::INT::DOUBLE AS exact, (p <> '' AND ((g <> '' AND (contains(p, g) OR contains(g, p))) OR contains(p, 'x') OR contains('x', p)))::INT::DOUBLE AS within FROM n""")
def _(s, d):
    answers = F.array(C("gold"), F.lit("X."))
    return predictions(s, d).select("ord", metrics.exact_match_any(C("prediction"), answers).alias("exact"), metrics.substring_match_any(C("prediction"), answers).alias("within"))


@query("metric_count", """SELECT page_id, round(CASE WHEN len(n) > 0 THEN len(list_filter(n, lambda x: x = (length(html) % 10)::VARCHAR))::DOUBLE / len(n) ELSE 0 END, 9) AS score FROM (SELECT *, regexp_extract_all(html, '[0-9]+') AS n FROM pages)""")
def _(s, d):
    return read(s, d, "pages").select("page_id", _r(metrics.count_score(C("html"), (F.length("html") % 10).cast("string"))).alias("score"))


@query("metric_retrieval", """SELECT page_id, round(CASE WHEN len(n) > 0 THEN len(list_filter(n, lambda x: x = (page_id % 10)::VARCHAR))::DOUBLE / len(n) ELSE 0 END, 9) AS score, round(CASE WHEN len(n) > 0 THEN len(list_filter(n, lambda x: x = (page_id % 5)::VARCHAR))::DOUBLE / len(n) ELSE 0 END, 9) AS score_zh FROM (SELECT *, regexp_extract_all(html, '[0-9]+') AS n FROM pages)""")
def _(s, d):
    gold = F.concat(F.lit("Paragraph "), (C("page_id") % 10).cast("string"))
    zh = F.concat(F.lit("段落"), (C("page_id") % 5).cast("string"))
    return read(s, d, "pages").select("page_id", _r(metrics.retrieval_score(C("html"), gold)).alias("score"), _r(metrics.retrieval_score(C("html"), zh, "段落([0-9]+)")).alias("score_zh"))


@query("metric_classification", """WITH c AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN lang || ' en' WHEN doc_id % 3 = 1 THEN lang ELSE 'none' END AS said, ['de', 'en', 'es', 'fr', 'e'] AS classes FROM documents),
m AS (SELECT doc_id, lang, list_filter(classes, lambda x: contains(said, x) AND NOT (contains(lang, x) AND x <> lang)) AS named FROM c)
SELECT doc_id, round(CASE WHEN list_contains(named, lang) THEN 1.0::DOUBLE / len(named) ELSE 0 END, 9) AS score FROM m""")
def _(s, d):
    said = F.when(C("doc_id") % 3 == 0, F.concat(C("lang"), F.lit(" en"))).when(C("doc_id") % 3 == 1, C("lang")).otherwise("none")
    classes = F.array(*map(F.lit, ("de", "en", "es", "fr", "e")))
    return read(s, d, "documents").select("doc_id", _r(metrics.classification_score(said, C("lang"), classes)).alias("score"))


@query("metric_sequence")
def _(s, d):
    p = predictions(s, d)
    return p.select("ord", _r(metrics.rouge_l(C("prediction"), C("gold"))).alias("rouge_l"), metrics.code_similarity(C("prediction"), C("gold")).alias("code"), _r(metrics.qa_f1_chinese(C("prediction"), C("gold"))).alias("zh"))


_CLEAN = r"lower(regexp_replace(regexp_replace(prediction, '[\x00-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g'))"


@query("metric_ruler", f"""WITH {PREDICTIONS}, r AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN 'qa_1' ELSE 'niah_single_1' END AS task, {_CLEAN} AS p, [lower(gold), lower(string_split(gold, ' ')[1]), 'zzz'] AS refs FROM preds)
SELECT ord, round(CASE WHEN task = 'qa_1' THEN (len(list_filter(refs, lambda x: contains(p, x))) > 0)::INT::DOUBLE ELSE len(list_filter(refs, lambda x: contains(p, x)))::DOUBLE / 3 END, 9) AS score FROM r""")
def _(s, d):
    task = F.when(C("ord") % 2 == 0, "qa_1").otherwise("niah_single_1")
    refs = F.array(C("gold"), F.split(C("gold"), " ")[0], F.lit("zzz"))
    return predictions(s, d).select("ord", _r(metrics.ruler_score(task, C("prediction"), refs)).alias("score"))


_BLANK = lambda c, chars: f"translate({c}, {quoted(chars)}, {quoted(' ' * len(chars))})"


@query("metric_infinite", rf"""WITH p AS (
  SELECT doc_id, text, lang, (doc_id % 8)::INT AS k, regexp_extract(text, '[0-9]+') AS first, list_filter(string_split_regex(translate(text, chr(10) || ':"''.,?!{{}}', '          '), '\s+'), lambda x: x <> '') AS w FROM documents
) SELECT doc_id, CASE k
  WHEN 0 THEN list_contains(w, 'the')::INT::DOUBLE WHEN 1 THEN (first = '555')::INT::DOUBLE WHEN 2 THEN (first = '1')::INT::DOUBLE
  WHEN 3 THEN contains(upper(text), 'THE')::INT::DOUBLE WHEN 4 THEN coalesce(first <> '' AND try_cast(regexp_extract(text, '[0-9]+\.[0-9]+|[0-9]+') AS DOUBLE) >= 7 AND try_cast(regexp_extract(text, '[0-9]+\.[0-9]+|[0-9]+') AS DOUBLE) < 8, false)::INT::DOUBLE
  ELSE (length({sql_normal('text')}) > 0 AND (contains({sql_normal('text')}, 'the') OR contains('the', {sql_normal('text')})))::INT::DOUBLE END AS score FROM p""")
def _(s, d):
    names = F.array(*map(F.lit, ("kv_retrieval", "passkey", "number_string", "longdialogue_qa_eng", "math_find", "other", "other", "other")))
    labels = F.array(*map(F.lit, ("the", "555", "1", "the", "7", "The.", "The.", "The.")))
    k = (C("doc_id") % 8).cast("int")
    return read(s, d, "documents").select("doc_id", metrics.infinite_score(F.get(names, k), C("text"), F.array(F.get(labels, k))).alias("score"))


@query("metric_choice_tasks", rf"""WITH {_CHOICE}, r AS (SELECT doc_id, said, substr('ABCD', (doc_id % 4)::INT + 1, 1) AS l, regexp_extract_all(said, '\b([A-J])\b', 1)[-1] AS last FROM ch)
SELECT doc_id, (last = l OR starts_with(said, l))::INT::DOUBLE AS choice, (last = 'A' OR starts_with(regexp_replace(replace(said, '*', ' '), ' +', ' ', 'g'), 'A'))::INT::DOUBLE AS debug FROM r""")
def _(s, d):
    label = F.substring(F.lit("ABCD"), (C("doc_id") % 4 + 1).cast("int"), F.lit(1))
    return choices(s, d).select("doc_id", metrics.long_choice(C("said"), F.array(label)).alias("choice"), metrics.code_debug(C("said"), F.lit("no_such_name"), F.lit("A")).alias("debug"))


@query("metric_code_run", r"""SELECT doc_id, coalesce(try_cast(w[-1] AS BIGINT) = doc_id % 5, false)::INT::DOUBLE AS score FROM (SELECT doc_id, list_filter(string_split_regex(translate('value: ' || (doc_id % 3)::VARCHAR || '.', chr(10) || '.`''":', '      '), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def _(s, d):
    said = F.concat(F.lit("value: "), (C("doc_id") % 3).cast("string"), F.lit("."))
    return read(s, d, "documents").select("doc_id", metrics.code_run(said, (C("doc_id") % 5).cast("string")).alias("score"))


_NUM = r"coalesce(regexp_extract_all({}, '-?[0-9]+(?:\.[0-9]+)?')[-1], '')"


@query("metric_gsm", rf"""WITH {PREDICTIONS}, g AS (SELECT ord, prediction || ' ' || (ord % 4)::VARCHAR AS p, '= ' || (ord % 3)::VARCHAR AS a, gold FROM preds)
SELECT ord, ({_NUM.format('p')} = {_NUM.format('a')} OR {_NUM.format('p')} = {_NUM.format('gold')} OR contains({sql_normal('p')}, {sql_normal('a')}) OR contains({sql_normal('a')}, {sql_normal('p')}) OR ({sql_normal('gold')} <> '' AND (contains({sql_normal('p')}, {sql_normal('gold')}) OR contains({sql_normal('gold')}, {sql_normal('p')}))))::INT::DOUBLE AS score FROM g""")
def _(s, d):
    p = F.concat(C("prediction"), F.lit(" "), (C("ord") % 4).cast("string"))
    a = F.concat(F.lit("= "), (C("ord") % 3).cast("string"))
    return predictions(s, d).select("ord", metrics.gsm_correct(p, F.array(a, C("gold"))).alias("score"))


@query("metric_lists", f"""WITH {_T} SELECT ord, round(CASE WHEN len(g) > 0 THEN len(list_intersect(list_distinct(p), list_distinct(g)))::DOUBLE / len(g) ELSE 0 END, 9) AS coverage,
  (len(list_filter(p, lambda x: NOT list_contains(g, x))) = 0 AND len(list_filter(g, lambda x: NOT list_contains(p, x))) = 0)::INT::DOUBLE AS same FROM t""")
def _(s, d):
    t = lambda c: text.text_tokens(C(c))
    return predictions(s, d).select("ord", t("prediction").alias("p"), t("gold").alias("g")).select("ord", _r(metrics.coverage(C("g"), C("p"))).alias("coverage"), metrics.set_match(C("g"), C("p")).alias("same"))


@query("metric_matching")
def _(s, d):
    t = lambda c: F.slice(text.text_tokens(C(c)), 1, 5)
    return predictions(s, d).select("ord", metrics.multi_subspan(t("gold"), t("prediction")).alias("matched"))


@query("score_qa_f1", f"""WITH {_T}, f AS (SELECT task, {sql_f1('pa', 'ga')} AS f1 FROM t), k AS (SELECT task, avg(f1) * 100 AS score, count(*) AS n FROM f GROUP BY task)
SELECT task, round(score, 6) AS score, n FROM k UNION ALL SELECT 'overall', round(avg(score), 6), sum(n)::BIGINT FROM k""")
def _(s, d):
    t = lambda c: text.answer_tokens(C(c))
    rows = predictions(s, d).select("task", t("prediction").alias("p"), t("gold").alias("g")).select("task", metrics.f1(C("p"), C("g")).alias("f1"))
    tasks = rows.groupBy("task").agg((F.avg("f1") * 100).alias("score"), F.count("*").alias("n"))
    return tasks.select("task", F.round("score", 6).alias("score"), "n").union(tasks.agg(F.lit("overall"), F.round(F.avg("score"), 6), F.sum("n")))


@query("score_by_task", f"""WITH {_T}, r AS (SELECT ord, pa, ga, p, g, ['hotpotqa', 'trec', 'passage_count', 'unknown'][(ord % 4)::INT + 1] AS name, prediction, gold FROM t),
f AS (SELECT name, CASE name WHEN 'hotpotqa' THEN {sql_f1('pa', 'ga')} WHEN 'trec' THEN (contains(prediction, gold) AND NOT contains(gold, 'zzz'))::INT::DOUBLE WHEN 'passage_count' THEN CASE WHEN len(regexp_extract_all(prediction, '[0-9]+')) > 0 THEN len(list_filter(regexp_extract_all(prediction, '[0-9]+'), lambda x: x = gold))::DOUBLE / len(regexp_extract_all(prediction, '[0-9]+')) ELSE 0 END ELSE 0 END AS score FROM r)
SELECT name, round(avg(score) * 100, 6) AS score, count(*) AS n FROM f GROUP BY name""")
def _(s, d):
    names = F.array(*map(F.lit, ("hotpotqa", "trec", "passage_count", "unknown")))
    rows = predictions(s, d).withColumn("name", F.get(names, (C("ord") % 4).cast("int")))
    score = metrics.long_score(C("name"), C("prediction"), F.array("gold"), F.array(C("gold"), F.lit("zzz")))
    return rows.select("name", score.alias("score")).groupBy("name").agg(F.round(F.avg("score") * 100, 6).alias("score"), F.count("*").alias("n"))


@query("metric_segmented")
def _(s, d):
    """F1 of texts without spaces, cut into words by a dictionary of what stands in all documents."""
    words = predictions(s, d).select(F.explode(text.text_tokens(C("gold"))).alias("word"))
    cut = segment.segmenter(s, segment.learned(words))
    joined = predictions(s, d).select("ord", text.normalize_chinese(C("prediction")).alias("p"), F.array(text.normalize_chinese(C("gold"))).alias("a"))
    rows = segment.with_words(joined, "p", "a", cut)
    return rows.select("ord", F.size("prediction_words").alias("words"), F.round(metrics.qa_f1_words(C("prediction_words"), C("answer_words")), 6).alias("f1"))

"""Evaluation runs as one lazy plan: load, sample, cap, answer, score, roll up."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, cell_config
from ..functions import extract, metrics
from ..operators import plumbing as P
from ..operators import rollup as R
from ..registry import Benchmark, answerers, benchmarks, subset_list
from ..sources import manifest, sinks, tables

C = F.col


def answers(df: DataFrame, preferred: str = "answers") -> Column:
    """The answers column as an array: the preferred name first, the other where it is absent."""
    other = "answer" if preferred == "answers" else "answers"
    name = preferred if preferred in df.columns else other
    if name not in df.columns:
        return F.array().cast("array<string>")
    kind = df.schema[name].dataType.typeName()
    return C(name) if kind == "array" else extract.parse_answers(C(name).cast("string"))


def text_of(c: str, strict_nulls: bool) -> Column:
    """A prediction as text: null is empty, or the word ``None`` as a plain conversion gives it."""
    return F.coalesce(C(c), F.lit("None" if strict_nulls else ""))


def _long(metric: str, means: DataFrame, scope: str) -> DataFrame:
    return means.select(F.lit(scope).alias("scope"), C("task").cast("string").alias("task"), F.lit(metric).alias("metric"), C("score").cast("double").alias("value"))


def _count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit("total_samples").alias("scope"), F.lit(None).cast("string").alias("task"), F.lit("count").alias("metric"), F.count("*").cast("double").alias("value"))


def rollup(rows: DataFrame, digits: int | None, by_task: bool = True) -> DataFrame:
    """(scope, task, metric, value): the overall score, task scores and the number of rows."""
    total = _count(rows)
    if not by_task:
        return total.union(rows.agg(F.lit("overall"), F.lit(None).cast("string"), F.lit("score"), R.percent("score")))
    means = R.task_means(rows, digits=digits)
    overall = means.agg(F.lit("overall"), F.lit(None).cast("string"), F.lit("score"), F.avg("score"))
    return total.union(overall).union(_long("score", means, "task_scores"))


def _ruler(strict: bool = True) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("score", metrics.ruler_score(C("task"), text_of("prediction", strict), answers(df, "answer")))


def _ruler_rollup(df: DataFrame) -> DataFrame:
    """Task scores, and per length the mean of unrounded task means."""
    if "context_length" not in df.columns:
        return rollup(df, 2)
    levels = R.two_levels(df)
    lengths = R.length_macro(levels).select(F.lit("length_scores"), C("context_length").cast("string"), F.lit("score"), C("score"))
    return rollup(df, 2).union(lengths)


def _long_bench(df: DataFrame) -> DataFrame:
    classes = C("all_classes") if "all_classes" in df.columns else F.array().cast("array<string>")
    return df.withColumn("score", metrics.long_score(C("task"), C("prediction"), answers(df), classes))


def _long_rollup(df: DataFrame) -> DataFrame:
    out = rollup(df, 2)
    if "length" not in df.columns:
        return out
    buckets = df.where(C("task").endswith("_e")).groupBy("task", P.length_bucket(C("length")).alias("bucket")).agg(R.percent("score").alias("v"))
    return out.union(buckets.select(F.lit("task_scores_by_length"), "task", "bucket", "v"))


def _choice(df: DataFrame) -> DataFrame:
    gold = F.coalesce(F.get(answers(df, "answer"), F.lit(0)), F.lit(""))
    return df.withColumn("score", metrics.flag(extract.steered_choice(text_of("prediction", True)) == F.upper(gold)))


def _loogle(df: DataFrame) -> DataFrame:
    """Token F1, but exact match for cloze questions."""
    pred, gold = text_of("prediction", True), answers(df, "answer")
    return df.withColumn("score", F.when(C("task") == "shortdep_cloze", metrics.exact_match_any(pred, gold)).otherwise(metrics.token_f1_any(pred, gold)))


def _containment(df: DataFrame) -> DataFrame:
    return df.withColumn("score", metrics.substring_match_any(text_of("prediction", True), answers(df, "answer")))


def _exact(df: DataFrame) -> DataFrame:
    return df.withColumn("score", metrics.exact_match_any(text_of("prediction", True), answers(df, "answer")))


def _infinite(df: DataFrame) -> DataFrame:
    return df.withColumn("score", metrics.infinite_score(C("task"), text_of("prediction", True), answers(df, "answer")))


def _gsm(df: DataFrame) -> DataFrame:
    return df.withColumn("score", metrics.gsm_correct(text_of("prediction", True), answers(df, "answer")))


def _integers(df: DataFrame) -> DataFrame:
    gold = F.transform(answers(df, "answer"), extract.int_up_to_999)
    df = df.withColumn("extracted", extract.int_up_to_999(text_of("prediction", True)))
    return df.withColumn("score", metrics.flag((C("extracted") != "") & F.array_contains(gold, C("extracted"))))


def _several() -> Column:
    """Whether a task asks for a set of answers."""
    return C("task").startswith("qampari") | C("task").startswith("quest")


def _lists(df: DataFrame) -> DataFrame:
    """List answers, as score (subspan), em, f1 and coverage. Set tasks want a match of their own for every gold;
    they have no f1, and no coverage without a list. Others take the first item and have no coverage.
    Without golds or a list all that applies is 0."""
    # The list is parsed in Arrow batches; higher-order functions take it from a column of its own.
    df = df.withColumn("_items", extract.extract_list(text_of("prediction", False)))
    normal = lambda c: F.transform(c, lambda x: metrics.text.normalize_answer(x))
    df = df.withColumns({"_items": normal("_items"), "_gold": normal(F.filter(answers(df), lambda x: x.isNotNull()))})
    items, gold, first = C("_items"), C("_gold"), F.coalesce(F.get("_items", F.lit(0)), F.lit(""))
    both, zero = (F.size(items) > 0) & (F.size(gold) > 0), F.lit(0.0)
    tokens = metrics.text.tokens
    out = {
        "score": F.when(_several(), metrics.multi_subspan(gold, items)).otherwise(metrics.flag(F.exists(gold, lambda g: F.contains(first, g)))),
        "em": F.when(_several(), metrics.set_match(gold, items)).otherwise(metrics.flag(F.array_contains(gold, first))),
        "f1": F.when(~_several(), metrics.let(tokens(first), lambda p: metrics.best(gold, lambda g: metrics.f1(p, tokens(g))))),
        "coverage": F.when(_several() & ((F.size(items) > 0) | (F.size(gold) == 0)), metrics.coverage(gold, items)),
    }
    wanted = {"f1": ~_several(), "coverage": C("coverage").isNotNull()}
    df = df.withColumns(out)
    df = df.withColumns({k: F.when(both, C(k)).when(wanted.get(k, F.lit(True)), zero) for k in out})
    return df.drop("_items", "_gold")


def _lists_rollup(df: DataFrame) -> DataFrame:
    """Task means of every measure in percent, and the means of these over the tasks."""
    names = {"subspan_em": "score", "em": "em", "f1": "f1", "coverage": "coverage"}
    means = df.where(C("task").isNotNull()).groupBy("task").agg(*(R.percent(c).alias(k) for k, c in names.items()))
    # A set task of which no row has a list has a coverage of 0.
    means = means.withColumn("coverage", F.when(_several(), F.coalesce("coverage", F.lit(0.0))))
    long = means.unpivot(["task"], list(names), "metric", "value").where("value is not null")
    tasks = long.select(F.lit("task_scores").alias("scope"), C("task").cast("string").alias("task"), "metric", "value")
    overall = long.groupBy("metric").agg(F.avg("value").alias("value"))
    whole = overall.select(F.lit("overall_metrics").alias("scope"), F.lit(None).cast("string").alias("task"), "metric", "value")
    head = means.agg(F.lit("overall"), F.lit(None).cast("string"), F.lit("score"), F.avg("subspan_em"))
    return _count(df).union(head).union(whole).union(tasks)


def _unscored(df: DataFrame) -> DataFrame:
    """No gold answers: the score is a placeholder of 0; the rollup reports the length of responses."""
    return df.withColumn("score", F.lit(0.0))


def _unscored_rollup(df: DataFrame) -> DataFrame:
    """Per task the mean length of responses in characters and the number of rows, and the mean over tasks."""
    means = df.where(C("task").isNotNull()).groupBy("task").agg(R.response_length(C("prediction")).alias("avg_response_length"), F.count("*").cast("double").alias("num_samples"))
    tasks = means.unpivot(["task"], ["avg_response_length", "num_samples"], "metric", "value").select(F.lit("task_scores"), C("task").cast("string"), "metric", "value")
    overall = [means.agg(F.lit("overall"), F.lit(None).cast("string"), F.lit(m), v) for m, v in (("score", F.lit(0.0)), ("avg_response_length", F.avg("avg_response_length")))]
    return _count(df).union(overall[0]).union(overall[1]).union(tasks)


def _integers_rollup(df: DataFrame) -> DataFrame:
    """The share of right rows, and of rows from which an integer was read."""
    whole = R.rates(C("extracted"), C("score") > 0)
    out = _count(df)
    for metric, value in (("score", whole["accuracy"]), ("exact_match", whole["accuracy"]), ("extraction_rate", whole["extraction_rate"])):
        out = out.union(df.agg(F.lit("overall"), F.lit(None).cast("string"), F.lit(metric), value))
    return out


def _table(spark: SparkSession, path: str, names: list[str] | None) -> DataFrame:
    return tables.subsets(spark, path, names)


def _macro(digits: int | None):
    return lambda df: rollup(df, digits)


def _micro(df: DataFrame) -> DataFrame:
    return rollup(df, None, by_task=False)


def _add(name: str, description: str, score: Callable, roll: Callable, defaults: dict, aliases: tuple[str, ...] = ()) -> None:
    benchmarks.register(name, aliases)(Benchmark(name, description, (), _table, score, roll, defaults))


_TOKENS = {"max_new_tokens": 128}
_add("ruler", "retrieval and tracing over long contexts, by containment either way", _containment, _macro(2), _TOKENS)
for _name in ("ruler16k", "ruler32k", "ruler64k", "ruler128k"):
    _add(_name, "retrieval and tracing over long contexts", _ruler(), _ruler_rollup, _TOKENS)
_add("longbench", "21 tasks with their own metrics", _long_bench, _long_rollup, _TOKENS)
_add("longbenchv2", "four-way choice", _choice, _macro(None), _TOKENS)
_add("infinite_bench", "nine task metrics", _infinite, _macro(2), _TOKENS)
_add("loft", "list answers", _lists, _lists_rollup, _TOKENS, ("loft_rag",))
_add("loogle", "question answering", _loogle, _macro(None), _TOKENS)
_add("zero_scrolls", "no gold answers", _unscored, _unscored_rollup, _TOKENS)
_add("prism1m", "a million tokens", _containment, _macro(2), {"max_new_tokens": 512})
_add("mock_benchmark", "two rows for smoke runs", _exact, _micro, {})
for _name in ("gsm_infinite_hard_128k", "gsm_infinite_medium_128k", "gsm_infinite_symbolic_128k"):
    _add(_name, "arithmetic over long contexts", _gsm, _micro, {"max_new_tokens": 512})
for _name in ("aime", "aime2024", "aime2025"):
    _add(_name, "integers from 0 to 999", _integers, _integers_rollup, {"max_new_tokens": 32000})


@answerers.register("echo")
def echo(df: DataFrame) -> DataFrame:
    """The first words of the context: a stand-in for a model, for smoke runs."""
    return df.withColumn("prediction", F.array_join(F.slice(metrics.text.words(C("context")), 1, 12), " "))


def prepare(df: DataFrame, config: RunConfig, defaults: dict) -> DataFrame:
    """Sampled, then capped per task, with defaults and, if wanted, questions inside contexts."""
    out = P.with_defaults(P.require(df), defaults | P.DEFAULTS)
    if config.fraction < 1:
        out = P.sample_fraction(out, config.fraction, config.seed)
    if config.max_requests is not None or config.max_requests_per_subset:
        out = P.cap_per_task(out, config.max_requests, config.max_requests_per_subset) if "task" in out.columns else P.first_rows(out, config.max_requests)
    return P.query_aware(out) if config.query_aware else out


def evaluate(spark: SparkSession, config: RunConfig, path: str, answerer: str | Callable = "echo") -> tuple[DataFrame, DataFrame]:
    """(predictions with scores, metrics), both lazy."""
    bench = benchmarks.get(config.benchmark)
    rows = prepare(bench.load(spark, path, subset_list(config.subsets) or None), config, bench.defaults)
    answered = (answerers.get(answerer) if isinstance(answerer, str) else answerer)(rows)
    scored = bench.score(answered)
    return scored, bench.rollup(scored)


def run(spark: SparkSession, config: RunConfig, path: str, answerer: str | Callable = "echo") -> dict:
    """Evaluates and writes predictions.csv, metrics.json and config.yaml into a new run folder."""
    began = time.monotonic()
    scored, measured = evaluate(spark, config, path, answerer)
    folder = config.run_dir()
    sinks.predictions_csv(scored, f"file://{folder.resolve()}/predictions.csv")
    sinks.metrics_json(measured, folder / "metrics.json")
    config.save(folder / "config.yaml")
    document, seconds = sinks.metrics_document(measured), time.monotonic() - began
    rows = document.get("total_samples", {}).get("count") or 0
    return {"folder": str(folder), "seconds": seconds, "seconds_per_row": seconds / rows if rows else None, "metrics": document}


def sweep(spark: SparkSession, base: RunConfig, cells: list[dict], path: str, out: str, answerer: str | Callable = "echo", subsets: list[str] | None = None, resume: bool = True) -> DataFrame:
    """Runs the cells of a grid one after the other, each over the whole table, and gives (cell_id, score, seconds,
    resumed). Each cell is recorded in the manifest below ``out`` when it ends, and the whole document is rebuilt. With
    ``resume`` a recorded cell whose metrics file can be read is not run again. A grid is small; what is large are the
    rows that each cell scores."""
    at = f"file://{Path(out).resolve()}/manifest"
    before = manifest.recorded(spark, at)
    known = {r.cell_id: r for r in manifest.finished(before, f"file://{Path(out).resolve()}").collect()} if resume and not before.isEmpty() else {}
    done = []
    for cell in cells:
        name = cell["cell_id"]
        if name in known:
            done.append((name, known[name].score, None, True))
            continue
        result = run(spark, cell_config(base, cell, subsets or [], out), path, answerer)
        score = result["metrics"].get("overall", {}).get("score")
        row = (name, cell.get("label") or name.split("__r")[0], cell.get("ratio"), f"{Path(result['folder']).resolve()}/metrics.json", score, result["seconds"])
        manifest.record(spark.createDataFrame([row], "cell_id string, label string, ratio double, metrics string, score double, seconds double"), at)
        manifest.rebuild(spark, at)
        done.append((name, score, result["seconds"], False))
    return spark.createDataFrame(done, "cell_id string, score double, seconds double, resumed boolean")

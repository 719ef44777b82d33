"""The queries of this subpackage, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, divergence, passages, pieces, pii, quality_rules, repeats, runs, toxicity, url_filters, warc
from .common import documents
from .jaccard_join import similar_documents

#: A conversation of two turns made of control strings, which formatting must survive.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_turns(turns.unionByName(probe)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.detect(docs, pii.train(docs))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summarize(documents(spark, sf_dir))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summarize(runs.find_runs(runs.with_planted_runs(documents(spark, sf_dir))))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return passages.score(docs, passages.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ALL = (
    op1_toxicity,
    op2_chat_formatting,
    op3_suffix_dedup,
    op4_warc,
    op5_pii,
    op6_quality_rules,
    op7_sentencepiece,
    op8_benchmark_decontamination,
    op9_url_filters,
    op10_ngram_jaccard_join,
    op11_source_divergence,
    op12_periodic_runs,
    op13_quality_classifier,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op9_url_filters": url_filters.oracle(), "op11_source_divergence": divergence.ORACLE, "op12_periodic_runs": runs.ORACLE}

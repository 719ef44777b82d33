"""Registration, and the relations that the queries share in both languages."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relations
from ..operators.tiles import BATCH_BYTES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Evaluation rows: the prediction is the first two thirds of a document's words, the gold answer the last two.


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts differ in length, so batches for Python are bounded by bytes.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("task"), "source", F.col("n_chars").alias("length"), text.words(F.col("text")).alias("w"))
    n = F.size("w")
    first, later = F.slice("w", F.lit(1), F.floor((2 * n + 2) / 3).cast("int")), F.slice("w", F.floor(n / 3).cast("int") + 1, n - F.floor(n / 3).cast("int"))
    return docs.select("ord", "task", "source", "length", F.array_join(first, " ").alias("prediction"), F.array_join(later, " ").alias("gold"))


PREDICTIONS = r"""w0 AS (
  SELECT doc_id AS ord, lang AS task, source, n_chars AS length, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents
), preds AS (
  SELECT ord, task, source, length, array_to_string(w[1:(2 * len(w) + 2) // 3], ' ') AS prediction, array_to_string(w[len(w) // 3 + 1:], ' ') AS gold FROM w0
)"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PUNCT = quoted(text.PUNCTUATION)


def sql_normal(c: str) -> str:
    return rf"trim(regexp_replace(translate(lower({c}), {_PUNCT}, ''), '\s+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    """Tokens of the normalised text."""
    return f"list_filter(string_split({sql_normal(c)}, ' '), lambda x: x <> '')"


def sql_answer_tokens(c: str) -> str:
    """Tokens without articles."""
    return f"list_filter(string_split({sql_normal(c)}, ' '), lambda x: x NOT IN ('', 'a', 'an', 'the'))"


def sql_overlap(p: str, g: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0)"


def sql_f1(p: str, g: str) -> str:
    """F1 of the token list columns p and g."""
    o = f"({sql_overlap(p, g)})::DOUBLE"
    return f"CASE WHEN {o} > 0 THEN 2 * ({o} / len({p})) * ({o} / len({g})) / ({o} / len({p}) + {o} / len({g})) ELSE 0::DOUBLE END"


# Key-value relations: heads are labels, positions count the vectors of a label.


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.keys_from_vectors(read(spark, sf_dir, "embeddings"))


KEYS = """kv AS (
  SELECT 0 AS layer, label AS head, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id,
    list_transform(embedding, lambda x: x::DOUBLE * (1.0::DOUBLE + (vec_id * 37 % 101)::DOUBLE / 100)) AS key,
    list_transform(embedding, lambda x: x::DOUBLE) AS value, count(*) OVER (PARTITION BY label) AS k_len
  FROM embeddings
)"""


def kept(sql_scores: str, ratio: float) -> str:
    """SQL of the retention rule over a relation with score."""
    return f"SELECT layer, head, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY layer, head ORDER BY round(score, 9) DESC, pos) AS rk FROM {sql_scores}) WHERE rk <= floor(k_len * (1.0::DOUBLE - {ratio!r}::DOUBLE))"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def norm(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


SCALE = 1 / math.sqrt(64)

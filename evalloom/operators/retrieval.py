"""Retrieval: chunks, nearest neighbours inside a document, and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import vector_index
from .vectors import normalized

C = F.col
CHUNK, OVERLAP, TOP = 512, 128, 12
#: The prompts: fixed values.
ANSWER_PROMPT = (
    "Context information is below.\n---------------------\n{context}\n---------------------\n"
    "Using only the context above, answer the question concisely. "
    "If the answer is not in the context, output only the word: unanswerable\n\n"
    "Question: {question}\nAnswer:"
)

REFINE_PROMPT = (
    "The original question is: {question}\nExisting answer: {answer}\nAdditional context is below.\n---------------------\n"
    "{context}\n---------------------\nRefine the existing answer using the additional context if it is helpful. "
    "Otherwise keep the existing answer. If the answer is not in the context, output only the word: unanswerable\nRefined answer:"
)


def filled(template: str, **parts: Column) -> Column:
    """A template with columns in its places."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(parts[x], F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(pieces)))


def refine_prompt(question: Column, answer: Column, context: Column) -> Column:
    return filled(REFINE_PROMPT, question=question, answer=answer, context=context)


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, text): windows of words at a fixed stride; the last reaches the end."""
    stride = size - overlap
    words = docs.select(key, T.words(C(text)).alias("w"))
    last = F.greatest(F.ceil((F.size("w") - size) / stride).cast("int"), F.lit(0))
    out = words.where(F.size("w") > 0).select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_id"))
    return out.select(key, "chunk_id", F.array_join(F.slice("w", C("chunk_id") * stride + 1, size), " ").alias("text"))


def hashed_embedding(words: Column, size: int) -> Column:
    """Normalised counts of words by hash: a stand-in for a model's embedding."""
    places = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return normalized(counts)


def nearest(questions: DataFrame, passages: DataFrame, by: list[str], question: str, k: int = TOP) -> DataFrame:
    """The k passages most like each question among those with the same ``by``; columns
    ``q_vector`` and ``p_vector`` hold the vectors, ids are whole numbers. rank 1 is the best, ties go to the smaller id.
    What else the two sides have is joined to the k hits, not to the pairs."""
    hits = vector_index.nearest(questions, passages, by, k, (question, "chunk_id"), ("q_vector", "p_vector"))
    hits = hits.withColumnsRenamed({"question": question, "id": "chunk_id"})
    for side, key in ((questions.drop("q_vector"), question), (passages.drop("p_vector"), "chunk_id")):
        if set(side.columns) - {*by, key}:
            hits = hits.join(side, [*by, key])
    return hits


def packed(hits: DataFrame, by: list[str]) -> DataFrame:
    """One context per question, the best passage last."""
    ordered = F.array_sort(F.collect_list(F.struct((-C("rank")).alias("r"), C("text").alias("t"))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x.t), "\n\n").alias("context"))


def prompt(context: Column, question: Column) -> Column:
    before, rest = ANSWER_PROMPT.split("{context}")
    middle, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(middle), question, F.lit(after))

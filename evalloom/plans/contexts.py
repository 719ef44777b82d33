"""Answering by context: what a context costs is paid once for all of its rows.

An answerer of contexts is set up with a context, predicts an answer for each row of it and is torn
down. Rows go to the task of their context by a digest and stream through it in Arrow batches, so a group
may be of any size; the answer is written into the row itself, so nothing is joined back. A context of
more than ``MOST_ROWS`` rows is dealt into parts of about that size, each of which sets it up: no
task receives a large group whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import retrieval as G
from ..registry import answerers, retrievers

MOST_ROWS = 10_000
C = F.col


class ContextAnswerer(Protocol):
    def setup(self, context: str) -> None: ...

    def predict(self, row: Mapping[str, Any]) -> str: ...

    def teardown(self) -> None: ...


def answer_by_context(rows: DataFrame, make: Callable[[], ContextAnswerer], most: int = MOST_ROWS) -> DataFrame:
    """rows (context, ord, ...) with ``prediction`` by an answerer that ``make`` gives to each task.

    Rows of a null context have a null prediction, as no group has them. An answerer is torn down even
    where a prediction fails. An existing prediction is replaced.
    """
    rows = rows.drop("prediction")
    keyed = rows.withColumn("_group", F.sha2("context", 256))
    large = keyed.where("_group is not null").groupBy("_group").agg(F.count("*").alias("_n")).where(C("_n") > most)
    keyed = keyed.join(large.withColumn("_parts", F.ceil(C("_n") / most)).drop("_n"), "_group", "left")
    keyed = keyed.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("ord"), "_parts"), F.lit(0))).drop("_parts")
    # Rows without a context need no group: they are spread by their place.
    keyed = keyed.withColumn("_part", F.when(C("_group").isNull(), F.pmod(F.xxhash64("ord", F.lit(1)), F.lit(1 << 20))).otherwise(C("_part")))
    dealt = keyed.repartition("_group", "_part").sortWithinPartitions("_group", "_part", "ord")
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("prediction", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answerer, now = make(), None
        try:
            for b in batches:
                groups, parts = b.column("_group").to_pylist(), b.column("_part").to_pylist()
                out = []
                for k, row in enumerate(b.select(names).to_pylist()):
                    if groups[k] is None:
                        out.append(None)
                        continue
                    if (groups[k], parts[k]) != now:
                        if now:
                            now = None
                            answerer.teardown()
                        answerer.setup(row["context"])
                        now = (groups[k], parts[k])
                    out.append(answerer.predict(row))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "prediction"])
        finally:
            if now:
                answerer.teardown()

    return dealt.select(*names, "_group", "_part").mapInArrow(run, schema)


def per_context(make: Callable[[], ContextAnswerer]) -> Callable[[DataFrame], DataFrame]:
    """An answerer of DataFrames out of one of contexts."""
    return lambda rows: answer_by_context(rows, make)


class Counted:
    """The number of words of the context and the question: a stand-in for a model, for smoke runs."""

    def setup(self, context: str) -> None:
        self.words = len(context.split())

    def predict(self, row: Mapping[str, Any]) -> str:
        return f"{self.words}:{row['question']}"

    def teardown(self) -> None:
        del self.words


@retrievers.register("one_pass")
class OnePass:
    """Chunks of a context are embedded when it is set up; a question takes the ``top`` nearest, the best
    last, fills the prompt with as many as ``room`` code points hold, and refines the answer
    with the rest. ``embed`` turns texts into unit vectors, ``generate`` a prompt into an answer; the
    stand-ins count words by hash and repeat the first passage.
    """

    #: Put before what is embedded: fixed values.
    QUESTION, PASSAGE = "Represent this question for searching relevant passages: ", "Represent this passage for retrieval: "

    def __init__(self, embed: Callable[[list[str]], np.ndarray] | None = None, generate: Callable[[str], str] | None = None, size: int = G.CHUNK, overlap: int = G.OVERLAP, top: int = G.TOP, room: int = 12_000) -> None:
        self.embed, self.generate = embed or hashed, generate or first_passage
        self.size, self.overlap, self.top, self.room = size, overlap, top, room

    def setup(self, context: str) -> None:
        self.passages = sentence_chunks(context, self.size, self.overlap)
        self.vectors = self.embed([self.PASSAGE + p for p in self.passages]) if self.passages else np.zeros((0, 1))

    def predict(self, row: Mapping[str, Any]) -> str:
        question = row["question"] or ""
        near = self.vectors @ self.embed([self.QUESTION + question])[0] if self.passages else np.zeros(0)
        chosen = [self.passages[i] for i in np.argsort(-np.round(near, 9), kind="stable")[: self.top]]
        packed, answer = self._packed(chosen[::-1]), ""
        for k, context in enumerate(packed or [""]):
            prompt = G.REFINE_PROMPT.format(question=question, answer=answer, context=context) if k else G.ANSWER_PROMPT.format(question=question, context=context)
            answer = self.generate(prompt)
        return answer

    def _packed(self, passages: list[str]) -> list[str]:
        out: list[str] = []
        for p in passages:
            if out and len(out[-1]) + len(p) + 2 <= self.room:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    def teardown(self) -> None:
        del self.passages, self.vectors


def hashed(texts: list[str], size: int = 256) -> np.ndarray:
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        for word, n in Counter(text.lower().split()).items():
            row[crc32(word.encode()) % size] += n
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def first_passage(prompt: str) -> str:
    return prompt.split("---------------------\n")[1].split("\n")[0]


def sentence_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` words that end with a sentence where one ends, and begin with the last
    whole sentences of the chunk before, up to ``overlap`` words. A longer sentence is cut."""
    pieces: list[list[str]] = []
    for sentence in re.split(r"(?<=[.!?。！？])\s+|\n+", text):
        words = sentence.split()
        pieces += [words[i : i + size] for i in range(0, len(words), size)]
    out, now, fresh = [], [], False
    for words in pieces:
        if now and sum(map(len, now)) + len(words) > size:
            if fresh:
                out.append(now)
            kept: list[list[str]] = []
            while now and sum(map(len, kept)) + len(now[-1]) <= min(overlap, size - len(words)):
                kept.insert(0, now[-1])
                now = now[:-1]
            now, fresh = kept, False
        now, fresh = [*now, words], True
    if fresh:
        out.append(now)
    return [" ".join(w for piece in chunk for w in piece) for chunk in out]


answerers.register("counted")(per_context(Counted))
answerers.register("rag", ("one_pass",))(per_context(OnePass))

"""Words of text without spaces: the most probable path through all words of a dictionary.

A dictionary holds words and how often they were seen (``learned`` counts them in a table). A text is cut into runs of
ASCII letters and digits, which are words, and other stretches. For each place of such a stretch, look-ups by length give every word of
the dictionary that begins there; with a single character in any case, these are the edges of a graph, and dynamic
programming from the end finds the path of the greatest product of frequencies. A character that is no word counts as
seen once. Of equal paths the one with the longer first word is taken.

A dictionary has at most ``MOST_WORDS`` words, the most frequent ones, ties by the word; it is collected and broadcast under
that bound. A null text gives null, an empty one no words; white space parts words and is none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_WORDS = 200_000
_RUN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+")


def learned(words: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The most frequent words of the only column of a table, and how often each was seen."""
    c = words.columns[0]
    counts = words.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias("word")).agg(F.count("*").alias("n"))
    return {r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()}


class Segmenter:
    """The logarithms of a dictionary's frequencies, and the lengths of the words that begin with each pair of characters."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.single = -math.log(max(1, sum(counts.values())))
        self.weights = {word: math.log(n) + self.single for word, n in counts.items() if word}
        lengths: dict[str, set[int]] = {}
        for word in self.weights:
            lengths.setdefault(word[:2], set()).add(len(word))
        self.lengths = {start: sorted(some) for start, some in lengths.items()}

    def edges(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(end, logarithm of the frequency) of the words that begin at a place."""
        starts = (text[at], text[at : at + 2]) if at + 1 < len(text) else (text[at],)
        for start in starts:
            for n in self.lengths.get(start, ()):
                word = text[at : at + n]
                if len(word) == n and word in self.weights:
                    yield at + n, self.weights[word]

    def path(self, text: str) -> list[str]:
        """The words of a stretch."""
        total, step = [0.0] * (len(text) + 1), [0] * len(text)
        for at in range(len(text) - 1, -1, -1):
            best, end = self.single + total[at + 1], at + 1
            for stop, weight in self.edges(text, at):
                if weight + total[stop] >= best or (stop == at + 1 and end == at + 1):
                    best, end = weight + total[stop], stop
            total[at], step[at] = best, end
        out, at = [], 0
        while at < len(text):
            out.append(text[at : step[at]])
            at = step[at]
        return out

    def words(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        return [w for run in _RUN.findall(text) for w in ([run] if run[0].isascii() and run[0].isalnum() else self.path(run))]


_last: list = [None, None]


def _made(counts: dict[str, int]) -> Segmenter:
    if _last[0] is not counts:
        _last[:] = counts, Segmenter(counts)
    return _last[1]


def segmenter(spark: SparkSession, counts: dict[str, int]) -> Callable[[Column], Column]:
    """A function of text columns to arrays of words; its ``many`` does the same to each text of an array column. A worker
    builds one segmenter for both and all its tasks."""
    sent = spark.sparkContext.broadcast(counts)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _made(sent.value)
        for s in texts:
            yield s.map(one.words)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def many(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _made(sent.value)
        for s in texts:
            yield s.map(lambda some: None if some is None else [one.words(t) for t in some])

    words.many = many
    return words


def with_words(rows: DataFrame, prediction: str, answers: str, cut: Callable[[Column], Column]) -> DataFrame:
    """rows with ``prediction_words`` and ``answer_words``, columns of their own since higher-order functions take no
    Python function."""
    return rows.withColumns({"prediction_words": cut(F.col(prediction)), "answer_words": cut.many(F.col(answers))})

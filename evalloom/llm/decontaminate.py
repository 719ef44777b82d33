"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over word positions; its hash combines the words at the marked positions and
ignores the others, so a passage with some words replaced still shares hashes with its original
wherever the replaced words fall on ignored positions. The hashes of every document position under
every mask are joined with those of the benchmark. Around each hit the document is aligned with the
item on the hit's diagonal and the overlap is verified on word hashes: ungapped local alignment with
+1 for an equal word and -``MISMATCH`` for a replaced one. A pair is reported if its best segment
scores at least ``LEAST_SCORE``, or if the equal words of all its diagonals cover at least
``LEAST_COVER`` of the item and ``LEAST_WORDS`` words. An item shorter than the longest mask has masks of
its own: with n words, every (n - LEAST_WORDS + 1)-th position, from each of the first ones. As many
masks as words may be replaced, and one more, so one of them meets equal words only. An item of fewer
than ``LEAST_WORDS`` words is a common phrase; it is found where it is the whole text.

Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased in A-Z; 64-bit word hashes stand for words.

The benchmark is the small side. Its words are counted first: up to ``BROADCAST_WORDS`` its hash
table goes to the executors whole, whose size that bounds; beyond, seed hashes of documents are
joined with it by shuffle, and each document that has a hit is verified against the items it hit.

Nulls: null texts and items have no words and match nothing. Empty tables give no rows. Repeated
rows: a repeated document is reported for each of its rows, a repeated item once. Other columns are
ignored. Whole texts are searched, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_lists, byte_views, map_arrow, signed
from .hashing import U64, combine, splitmix, word_hashes

#: Masks over word positions: fixed values, 1 for a position that counts.
MASKS = ("11101011", "1101100011", "110010010111", "1010011001011")
#: The same for items of LEAST_WORDS words and more, but fewer than the longest mask has.
SHORT = ("1111", "11101")
MISMATCH, LEAST_SCORE, LEAST_COVER, LEAST_WORDS = 2, 11, 0.5, 8
BROADCAST_WORDS = 4_000_000
SPAN = max(len(m) for m in MASKS)


def seeds(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all masks at all positions."""
    hashes, at = [], []
    for m in masks:
        offsets = tuple(i for i, c in enumerate(m) if c == "1")
        h = combine(words, offsets) ^ U64(splitmix(500 + int(m, 2)))
        hashes.append(h)
        at.append(np.arange(len(h)))
    return np.concatenate(hashes), np.concatenate(at)


def _short(n: int) -> bool:
    return LEAST_WORDS <= n < SPAN


def _whole(words: np.ndarray) -> int:
    """A hash of all words of a text of fewer than LEAST_WORDS."""
    return int(combine(words, tuple(range(len(words))))[0]) ^ splitmix(len(words))


class Items:
    """The words of benchmark items one after another, with their seeds in order of hash."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray]) -> None:
        self.ids, self.size = ids, np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate(words) if words else np.zeros(0, U64)
        hashes, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        self.whole: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= SPAN:
                h, p = seeds(w)
                hashes.append(h)
                at.append(p + self.start[i])
            elif _short(len(w)):
                h, p = seeds(w, SHORT)
                hashes.append(h)
                at.append(p + self.start[i])
            elif len(w):
                self.whole.setdefault(_whole(w), []).append(i)
        self.masks = MASKS + (SHORT if any(_short(len(w)) for w in words) else ())
        h, p = np.concatenate(hashes), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], p[order]
        # A first look by 16 bits leaves few hashes to search for.
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> U64(48)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the document, position among the items' words) of equal seeds."""
        h, p = seeds(words, self.masks)
        keep = self.seen[(h >> U64(48)).astype(np.int64)]
        h, p = h[keep], p[keep]
        first, last = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = last - first
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(p, n), self.at[np.repeat(first, n) + inner]

    def overlaps(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, first word of the best segment in words, its score, equal words, words of the item)."""
        if 0 < len(words) < LEAST_WORDS:
            for i in self.whole.get(_whole(words), ()):
                yield i, 0, len(words), len(words), len(words)
        at, among = self.hits(words)
        if not len(at):
            return
        item = np.searchsorted(self.start + self.size, among, "right")
        pairs = np.unique(np.stack([item, at - among + self.start[item]]), axis=1)
        for i in np.unique(pairs[0]).tolist():
            mine = self.words[self.start[i] : self.start[i] + self.size[i]]
            covered, best = np.zeros(len(mine), bool), (0, 0)
            for diagonal in pairs[1][pairs[0] == i].tolist():
                low, high = max(0, -diagonal), min(len(mine), len(words) - diagonal)
                same = mine[low:high] == words[low + diagonal : high + diagonal]
                total = np.cumsum(np.where(same, 1, -MISMATCH))
                floor = np.minimum.accumulate(np.r_[0, total[:-1]])
                end = int(np.argmax(total - floor))
                begin = int(np.argmin(np.r_[0, total[:-1]][: end + 1]))
                score = int(total[end] - floor[end])
                if score >= min(len(mine), 4):
                    covered[low + begin : low + end + 1] |= same[begin : end + 1]
                best = max(best, (score, -(low + begin + diagonal)))
            equal = int(covered.sum())
            if best[0] >= min(LEAST_SCORE, len(mine)) or (equal >= LEAST_COVER * len(mine) and equal >= LEAST_WORDS):
                yield i, -best[1], best[0], equal, len(mine)


_SCHEMA = "item_id long, at_word long, score long, equal_words long, item_words long"
_NAMES = ["item_id", "at_word", "score", "equal_words", "item_words"]


def _report(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (position in ids, item, ...)."""
    at, *columns = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([ids.take(at), *columns], names=["doc_id", *_NAMES])


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), as_lists([signed(word_hashes(raw)) for raw in byte_views(b.column(1))], pa.int64())], names=["item_id", "words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_WORDS) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id (of any type), item_id, at_word
    (first word of the best segment in the document, of equal ones the first), score, equal_words, item_words.

    Words of up to ``bound`` are collected as Arrow lists of 8 bytes a word: 32 MB at ``BROADCAST_WORDS``, and
    some 250 MB with the seeds of all positions.
    """
    text = docs.select("doc_id", "text").where("text is not null")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}"
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    words = items.transform(map_arrow, _item_words, "item_id long, words array<long>").where("size(words) > 0")
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    if total > bound:
        return _by_shuffle(text, words, schema)
    rows = words.orderBy("item_id").toArrow()
    lists = rows.column("words").combine_chunks()
    table = Items(np.array(rows.column("item_id").fill_null(-1), np.int64), [np.asarray(x.values).view(U64) for x in lists])
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            out = []
            for k, raw in enumerate(byte_views(b.column(1))):
                out += [(k, int(table.ids[i]), *rest) for i, *rest in table.overlaps(word_hashes(raw))]
            if out:
                yield _report(b.column(0), out)

    return text.transform(map_arrow, run, schema)


def _doc_seeds(masks: tuple[str, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for k, raw in enumerate(byte_views(b.column(1))):
                w = word_hashes(raw)
                h = [seeds(w, masks)[0]]
                if 0 < len(w) < LEAST_WORDS:
                    h.append(np.array([_whole(w)], U64))
                h = np.unique(np.concatenate(h))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.full(len(h), keys[k]))], names=["h", "key"])

    return run


def _item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            one = Items(np.array([item or 0]), [np.array(words, np.int64).view(U64)])
            h = np.unique(np.concatenate([one.hashes, np.array(list(one.whole), U64)]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array([item] * len(h), pa.int64())], names=["h", "item_id"])


def _by_shuffle(text: DataFrame, words: DataFrame, schema: str) -> DataFrame:
    """The same rows for a benchmark of any size: hits by a join on seed hashes, each verified with
    the texts that the two sides bring. A document sends four seeds a word, and two more only where there are
    short items; adaptive execution splits the seeds of common words."""
    short = not words.where(F.size("words").between(LEAST_WORDS, SPAN - 1)).isEmpty()
    text = text.withColumn("key", F.xxhash64("doc_id", "text"))
    hits = text.select("key", "text").transform(map_arrow, _doc_seeds(MASKS + (SHORT if short else ())), "h long, key long").join(words.transform(map_arrow, _item_seeds, "h long, item_id long"), "h").selectExpr("key", "item_id AS hit").distinct()
    pairs = hits.join(words, F.expr("hit <=> item_id")).select("key", "item_id", "words").join(text, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, words = (b.column(k).to_pylist() for k in (1, 2))
            out = []
            for k, raw in enumerate(byte_views(b.column(3))):
                one = Items(np.array([0]), [np.array(words[k], np.int64).view(U64)])
                out += [(k, -1 if items[k] is None else items[k], *rest) for _, *rest in one.overlaps(word_hashes(raw))]
            if out:
                yield _report(b.column(0), out)

    return pairs.select("doc_id", "item_id", "words", "text").transform(map_arrow, run, schema)

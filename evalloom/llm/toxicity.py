"""Toxicity scores from a lexicon, its misspellings and the context of each hit.

The lexicon is learned: words and word stems whose document frequency is much higher among toxic
than among other labelled documents. It is held in a trie. A token that is no lexicon term is read by
a Levenshtein automaton (a bit-parallel NFA of the token), which is intersected with the trie: one
walk finds all terms within the permitted distance; tokens that other documents use are left alone. Around each hit a window of ``WINDOW`` tokens is
scored: quotation marks about it and reporting verbs speak for quotation, addressing words for abuse.
A logistic regression over the terms found, misspelled hits and the window scores gives the score.

Learning uses at most ``SAMPLE`` labelled documents of each class, taken in order of a hash of the
id, out of the rows that are not held out (``crc32(doc_id as text) mod 5`` is not 0). Terms are
counted on the executors; the driver sees at most ten times ``TERMS`` of them and one row of term numbers per
sampled document. The model is bounded by ``TERMS``. Language, source and id are never inputs.

Nulls: a null or empty text has no terms and scores like any text without. A label row with a null
is ignored; of several labels of one document the highest counts. With no toxic or no other label all
scores are 0. Repeated rows are scored each, empty tables give no rows, other columns are ignored. A
null doc_id is not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, free, map_arrow, signed, table
from .hashing import shingles

SAMPLE, TERMS, WINDOW = 3000, 300, 5
#: Characters before and behind a hit in which quotation marks are looked for.
NEAR_QUOTES = 80
#: Documents with a term, at least, their share of the toxic ones, the least log ratio of its
#: frequencies, and the ratio from which misspellings of a word count.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO, SURE_RATIO = 5, 0.01, 1.5, 3.0
#: Other documents that use a token, from which it is no misspelling.
PLAIN_DOCS = 2
STEMS = range(4, 9)
#: Tokens whose matches a worker remembers.
MEMORY = 300_000

_TOKEN = re.compile(r"[\w@$!]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_QUOTES = "\"“”«»„‘’"
REPORTING = frozenset("said says called quoted quote wrote reported alleged dit cite écrit sagte schrieb zitat dijo escribió cita".split())
ADDRESS = frozenset("you your youre du dich dir ihr tu toi vous te usted tú eres".split())
#: Features after the terms: misspelled hits at distance 1 and 2, quoted hits, reporting and
#: addressing words in the windows, unquoted hits; and what their weights are drawn to.
EXTRA = ("near", "far", "quoted", "reporting", "address", "direct")
PRIOR = np.array([1.0, 0.5, -1.0, -0.5, 0.5, 0.0])


def tokens(text: str) -> list[str]:
    return [t for x in _TOKEN.findall(text.lower()) if (t := x.strip("@$!_"))]


class Automaton:
    """Levenshtein automaton of a word: a state is one bit mask of positions for each number of
    errors."""

    def __init__(self, word: str, errors: int) -> None:
        self.errors, self.final = errors, 1 << len(word)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | (2 << i)
        self.full = (2 << len(word)) - 1
        self.start = tuple((2 << e) - 1 for e in range(errors + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        mask, out = self.masks.get(c, 0), []
        for e, now in enumerate(state):
            new = (now << 1) & mask
            if e:
                new |= state[e - 1] | (state[e - 1] << 1) | (out[e - 1] << 1)
            out.append(new & self.full)
        return tuple(out)

    def distance(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, now in enumerate(state) if now & self.final), None)


class Lexicon:
    """Terms in a trie; stems match every token that begins with them."""

    def __init__(self, words: list[tuple[str, int]], stems: list[tuple[str, int]], sure: list[str] | None = None) -> None:
        """Misspellings are sought of the ``sure`` words, of all words by default; one of them that a stem tells
        about counts for the stem."""
        self.words, self.stems = dict(words), dict(stems)
        self.lengths = sorted({len(s) for s in self.stems})
        self.root: dict = {}
        #: Parts of the words, by permitted errors and length: cut in one part more than errors, a word
        #: within these leaves one of its parts whole.
        self.parts: dict[int, dict[int, set[str]]] = {1: {}, 2: {}}
        for word in self.words if sure is None else sure:
            number = next((x for x in (self.words.get(word), *(self.stems.get(word[:n]) for n in reversed(self.lengths))) if x is not None), None)
            if len(word) >= 5 and number is not None:
                node = self.root
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = number
                for errors in (1, 2) if len(word) >= 7 else (1,):  # a word of under 7 letters is not within 2 of one of 9
                    cuts = [k * len(word) // (errors + 1) for k in range(errors + 2)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        self.parts[errors].setdefault(b - a, set()).add(word[a:b])
        #: Tokens that other documents use, and that are no misspellings therefore.
        self.plain: frozenset[str] = frozenset()
        self.memory: dict[str, tuple] = {}

    def near(self, token: str) -> list[tuple[int, int]]:
        """(term, distance) of the words within one error of token, two from nine letters on."""
        errors = 2 if len(token) >= 9 else 1
        if not any(token[i : i + n] in some for n, some in self.parts[errors].items() for i in range(len(token) - n + 1)):
            return []
        automaton, found = Automaton(token, errors), []
        todo = [(self.root, automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c == "":
                    if (d := automaton.distance(state)) is not None:
                        found.append((below, d))
                elif any(new := automaton.step(state, c)):
                    todo.append((below, new))
        return found

    def match(self, token: str) -> tuple[tuple[int, ...], int | None]:
        """(terms that the token is or begins with, least distance of a misspelled one)."""
        found = self.memory.get(token)
        if found is None:
            exact = [self.words[token]] if token in self.words else []
            exact += [self.stems[token[:n]] for n in self.lengths if len(token) > n and token[:n] in self.stems]
            d = None
            if not exact and len(token) >= 4 and self.root and token not in self.plain:
                plain = token.translate(_LEET)
                if plain != token and plain in self.words:
                    d = 1
                else:
                    d = min((d for _, d in self.near(plain)), default=None)
            found = (tuple(exact), d)
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[token] = found
        return found


def features(text: str, lexicon: Lexicon) -> tuple[dict[int, int], list[float]]:
    """Counts of the terms in text, and the values of EXTRA."""
    words = tokens(text)
    terms: Counter[int] = Counter()
    hits, near, far = [], 0, 0
    match = lexicon.match
    for i, w in enumerate(words):
        exact, d = match(w)
        if exact:
            terms.update(exact)
            hits.append(i)
        elif d is not None:
            near += d <= 1
            far += d > 1
            hits.append(i)
    if not hits:
        return terms, [0.0] * len(EXTRA)
    quoted = reporting = address = 0
    marks = any(q in text for q in _QUOTES)
    low = text.lower() if marks else ""
    places = [m.start() for m in _TOKEN.finditer(low) if m[0].strip("@$!_")]
    for i in hits:
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        reporting += any(w in REPORTING for w in window)
        address += any(w in ADDRESS for w in window)
        if marks:
            k, end = places[i], places[i] + len(words[i])
            before, after = low[max(0, k - NEAR_QUOTES) : k], low[end : end + NEAR_QUOTES]
            quoted += any(q in after for q in _QUOTES) and sum(map(before.count, _QUOTES)) % 2 == 1
    n = len(hits)
    return terms, [math.log1p(near), math.log1p(far), quoted / n, reporting / n, address / n, math.log1p(n - quoted)]


class Model:
    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray, intercept: float) -> None:
        self.lexicon, self.weights, self.intercept = lexicon, weights, intercept

    def score(self, text: str) -> float:
        if self.lexicon is None:
            return 0.0
        terms, extra = features(text, self.lexicon)
        z = self.intercept + float(np.dot(self.weights[-len(EXTRA) :], extra)) + sum(self.weights[t] * min(n, 3) for t, n in terms.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method for the penalised likelihood; the penalty draws the weights to ``prior``."""
    x = np.c_[x, np.ones(len(x))]
    mean, penalty = np.r_[prior, 0.0], np.r_[np.full(len(prior), strength), 1e-4]
    w = mean.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * (w - mean)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic documents, other documents), summed over a task before the shuffle."""
    for b in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(tokens(text or ""))
            stems = {w[:n] for w in words for n in STEMS if len(w) > n}
            counts[label].update((w, False) for w in words)
            counts[label].update((s, True) for s in stems)
        keys = sorted(counts[0].keys() | counts[1].keys())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([s for _, s in keys]), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["term", "stem", "toxic", "other"])


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names texts by the least hash of their word shingles, which near copies mostly share."""
    for b in batches:
        least = [int(s[0]) if len(s := shingles(t.tobytes(), 3)) else 0 for t in byte_views(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(np.array(least, np.uint64))), b.column(1)], names=["toxic", "name", "text"])


def apart(terms: list) -> list:
    """terms without those that a shorter stem in the list tells about as well."""
    stems = {r.term: r.ratio for r in terms if r.stem}
    return [r for r in terms if not any(stems.get(r.term[:n], -9.0) >= r.ratio - 0.5 for n in STEMS if n < len(r.term))]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    known = table(known, "labels")
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [r for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    free(known)
    if len(totals) < 2:
        return Model(None, np.zeros(0), 0.0)
    spark = docs.sparkSession
    few = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")
    # At most 2 * sample rows of two numbers: small by construction. The documents are read once for them.
    text = table(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text"), "sample")
    # Copies and near copies say nothing twice: what only they have in common is no term.
    distinct = text.select("toxic", "text").transform(map_arrow, _named, "toxic int, name long, text string").dropDuplicates(["toxic", "name"])
    n = {0: 0, 1: 0} | {r.toxic: r.n for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = distinct.select("toxic", "text").transform(map_arrow, _counted, "term string, stem boolean, toxic long, other long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = table(counts, "counts")
    ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("other") + 0.5) / (n[0] + 1))
    best = counts.where(F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * n[1])).withColumn("ratio", ratio).where(f"ratio >= {LEAST_RATIO}").orderBy((F.col("toxic") * F.col("ratio")).desc(), "term", "stem").limit(10 * TERMS).collect()
    sure = [r.term for r in best if not r.stem and r.ratio >= SURE_RATIO]
    best = apart(best)[:TERMS]
    lexicon = Lexicon([(r.term, k) for k, r in enumerate(best) if not r.stem], [(r.term, k) for k, r in enumerate(best) if r.stem], sure)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [w for w in b.column(0).to_pylist() if lexicon.match(w)[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    # Of at most 2 * sample documents, so it is small: tokens near a term that other documents use as well.
    used = counts.where(f"not stem and other >= {PLAIN_DOCS}").select("term").transform(map_arrow, near, "term string").collect()
    free(counts)
    lexicon.plain = frozenset(r.term for r in used)
    lexicon.memory.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms, extra = features(text or "", lexicon)
                out.append((label, list(terms), [min(v, 3) for v in terms.values()], extra))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)], names=["toxic", "terms", "counts", "extra"])

    rows = text.select("toxic", "text").transform(map_arrow, run, "toxic int, terms array<int>, counts array<int>, extra array<double>").collect()
    free(text)
    x, y = np.zeros((len(rows), len(best) + len(EXTRA))), np.array([r.toxic for r in rows], float)
    for k, r in enumerate(rows):
        x[k, r.terms] = r.counts
        x[k, len(best) :] = r.extra
    if len(set(y.tolist())) < 2:
        return Model(None, np.zeros(0), 0.0)
    weights, intercept = fit_logistic(x, y, np.r_[np.zeros(len(best)), PRIOR])
    shares = math.log(totals[1] / totals[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(lexicon, weights, intercept + shares)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                scores = [model.score(t or "") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").transform(map_arrow, run, "doc_id long, held_out boolean, score double, predicted int")

"""Quality scores by attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``WORDS`` words (a word counts anew each ``CUT`` bytes, so that a passage is
bounded). Each passage is encoded: shares of kinds of characters, how words repeat, begin and end, and hashed pairs
of bytes go through a learned layer to a vector h. A gated attention gives each vector the weight
softmax(w . (tanh(V h) * sigmoid(U h))), and the score is the logistic of c . z + b for the weighted vector z of the
document. Layer, gates and score are learned together from the labels of documents alone (Adam on
the log loss); no passage has a label.

Learning uses at most ``SAMPLE`` labelled documents of each class, in order of a hash of the id, out of the rows
that are not held out (``crc32(doc_id as text) mod 4`` is not 2), and of these the ones of at most ``MOST`` passages;
the driver holds their features, at most 2 SAMPLE x MOST vectors. Scoring reads every passage of every document,
``CHUNK`` of them at a time: a passage hands on two numbers, its gate and its part of the score. Language, source
and id are never inputs.

Nulls: a null or empty text is one passage without words and gets a score like any other. A null label is ignored;
of several labels of one document the lowest counts, of several texts the smallest. With labels of one class, or
none, every score is the share (ones + 1) / (labels + 2). Repeated rows are scored each, empty tables give no rows,
other columns are ignored. A null doc_id is not held out. Of passages of equal weight the first is the focus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import byte_views, map_arrow
from .hashing import BYTE_VALUES, IS_SPACE, U64, mix, prefix_hashes, span_hashes

WORDS, CUT, CHUNK = 64, 1024, 4096
SAMPLE, MOST = 2000, 64
#: Least score of a document that is predicted to be good.
GOOD = 0.7
HIDDEN, GATES, PAIRS = 32, 16, 64
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.01, 1e-4

#: Kinds of bytes: space, line end, lower, upper, digit, and groups of signs; the rest, lead and continuation bytes.
_SIGNS = (".,", "!", "?", ";:", "|", "#*$%&", "<>=+~^_\\/@`", "'\"", "()[]{}", "-")
_KIND = np.full(256, 5 + len(_SIGNS), dtype=np.int64)
_KIND[IS_SPACE] = 0
_KIND[10] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
for _k, _group in enumerate(_SIGNS):
    _KIND[[ord(c) for c in _group]] = 5 + _k
_KIND[0xC0:] = 6 + len(_SIGNS)
_KIND[0x80:0xC0] = 7 + len(_SIGNS)
KINDS = 8 + len(_SIGNS)
_LETTER = np.isin(_KIND, [2, 3, KINDS - 2, KINDS - 1])
_SIGN = (_KIND >= 5) & (_KIND < 5 + len(_SIGNS))
FEATURES = KINDS + 9 + PAIRS


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in bytes; a word is cut each CUT bytes of the text."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[raw]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    starts[::CUT] |= inside[1:-1:CUT]
    ends[CUT - 1 :: CUT] |= inside[CUT:-1:CUT]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def encode(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of features for each passage of WORDS pieces; one row of zeros where there is no piece."""
    count = max(1, -(-len(starts) // WORDS))
    out = np.zeros((count, FEATURES), dtype=np.float32)
    if not len(starts):
        return out
    low = starts[0]
    raw, starts, ends = raw[low : ends[-1]], starts - low, ends - low
    of = np.arange(len(starts)) // WORDS
    first = starts[::WORDS]
    size = np.diff(np.append(first, len(raw)))
    kind = _KIND[raw]
    passage = np.repeat(np.arange(count), size)
    out[:, :KINDS] = np.bincount(passage * KINDS + kind, minlength=count * KINDS).reshape(count, KINDS) / size[:, None]
    n = np.bincount(of, minlength=count)
    long = ends - starts
    upto = lambda mask: np.append(0, np.cumsum(mask))
    letters, upper = upto(_LETTER[raw]), upto(kind == 3)
    letters, upper = letters[ends] - letters[starts], upper[ends] - upper[starts]
    word = mix(span_hashes(prefix_hashes(raw, BYTE_VALUES), starts, ends) + long.astype(U64))
    again = np.append(False, (word[1:] == word[:-1]) & (of[1:] == of[:-1]))
    order = np.lexsort((word, of))
    fresh = np.append(True, (np.diff(word[order]) != 0) | (np.diff(of[order]) != 0))
    mean = lambda values: np.bincount(of, weights=values, minlength=count) / n
    words = (again, letters == 0, _SIGN[raw[ends - 1]], _SIGN[raw[starts]], kind[starts] == 3, (upper > 1) & (upper == letters))
    for k, values in enumerate(words):
        out[:, KINDS + k] = mean(values)
    out[:, KINDS + 6] = np.bincount(of[order], weights=fresh, minlength=count) / n
    out[:, KINDS + 7] = np.log1p(mean(long)) / 5
    out[:, KINDS + 8] = np.log1p(n) / np.log1p(WORDS)
    pair = (raw[:-1].astype(np.int64) * 31 + raw[1:] * 17) % PAIRS
    counts = np.bincount(passage[:-1] * PAIRS + pair, minlength=count * PAIRS).reshape(count, PAIRS)
    out[:, KINDS + 9 :] = np.sqrt(counts / size[:, None])
    return out


def passages(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The features of all passages of a text, at most CHUNK rows at a time."""
    block = CHUNK * WORDS
    starts, ends = pieces(raw)
    for k in range(0, max(1, len(starts)), block):
        yield encode(raw, starts[k : k + block], ends[k : k + block])


class Model:
    """The encoder, the gates and the score over them; or one score for all where there is nothing to learn from."""

    def __init__(self, bags: list[np.ndarray], labels: np.ndarray):
        ones = int(labels.sum())
        self.constant = (ones + 1) / (len(labels) + 2) if ones in (0, len(labels)) else None
        if self.constant is None:
            self._fit(bags, labels.astype(np.float32))

    def _start(self, rng: np.random.Generator) -> None:
        scale = lambda a, b: rng.normal(size=(a, b)) / np.sqrt(a)
        p = {"W": scale(FEATURES, HIDDEN), "w0": np.zeros(HIDDEN), "V": scale(HIDDEN, GATES), "U": scale(HIDDEN, GATES), "w": np.zeros(GATES), "c": scale(HIDDEN, 1)[:, 0], "b": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in p.items()}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each passage, by its scaled features, the gate and its part of the score, and what they are made of."""
        p = self.p
        h = np.maximum(x @ p["W"] + p["w0"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return (t * g) @ p["w"], h @ p["c"], h, t, g

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed log loss of documents, whose passages are the rows of x one document after another."""
        p, doc = self.p, np.repeat(np.arange(len(sizes)), sizes)
        e, s, h, t, g = self.parts(x)
        score, a, mean = pooled(e, s, sizes, p["b"][0])
        error = (score - y)[doc]
        ds, de = error * a, error * a * (s - mean[doc])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (np.outer(ds, p["c"]) + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
        return {"W": x.T @ dh, "w0": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": h.T @ ds, "b": np.array([(score - y).sum()])}

    def _fit(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        rng = np.random.default_rng(13)
        rows = np.concatenate(bags)
        self.mean, self.sd = rows.mean(0), rows.std(0) + np.float32(1e-3)
        bags = [self.scaled(x) for x in bags]
        self._start(rng)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), BATCH):
                some = order[at : at + BATCH]
                grad = self.gradient(np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), y[some])
                step += 1
                for k, x in self.p.items():
                    d = grad[k] / len(some) + DECAY * x
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def pooled(e: np.ndarray, s: np.ndarray, sizes: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of documents, weights of their passages, and the weighted parts, from gates and parts of passages."""
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    a = np.exp(e - np.maximum.reduceat(e, first)[doc])
    a /= np.add.reduceat(a, first)[doc]
    mean = np.add.reduceat(a * s, first)
    return 1 / (1 + np.exp(-np.clip(mean + b, -500, 500))), a, mean


HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 4 = 2, false)"


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label and text of the documents to learn from, at most SAMPLE of each class."""
    known = labels.where(f"doc_id IS NOT NULL AND quality IN (0, 1) AND NOT {HELD_OUT}").groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = F.xxhash64("doc_id"), "doc_id"
    one = [known.where(F.col("label") == k).orderBy(*order).limit(SAMPLE) for k in (0, 1)]
    # At most 2 SAMPLE rows of two numbers, whatever the labels are.
    chosen = F.broadcast(one[0].unionByName(one[1]))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(k, raw) for k, raw in enumerate(byte_views(batch.column(1))) if len(pieces(raw)[0]) <= MOST * WORDS]
            bags = [np.concatenate(list(passages(raw))).astype("<f4").tobytes() for _, raw in kept]
            at = pa.array([k for k, _ in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(bags, pa.binary()), batch.column(2).take(at)], ["label", "bag", "doc"])

    rows = map_arrow(sample(docs, labels).selectExpr("CAST(label AS INT) AS label", "text", "xxhash64(doc_id) AS doc"), features, "label int, bag binary, doc long").collect()
    rows.sort(key=lambda r: (r.doc, bytes(r.bag)))
    bags = [np.frombuffer(bytes(r.bag), dtype="<f4").reshape(-1, FEATURES) for r in rows]
    return Model(bags, np.array([r.label for r in rows], dtype=int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, and the passage of the greatest weight (focus, from 0, and its weight)."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("n_passages", LongType()), StructField("focus", LongType()), StructField("weight", DoubleType())])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gates, shares, sizes = [], [], []
            for raw in byte_views(batch.column(2)):
                size = 0
                for x in passages(raw):
                    e, s = model.parts(model.scaled(x))[:2] if model.constant is None else (np.zeros(len(x)),) * 2
                    gates.append(e)
                    shares.append(s)
                    size += len(x)
                sizes.append(size)
            if not sizes:
                continue
            sizes = np.array(sizes)
            e, s = np.concatenate(gates).astype(float), np.concatenate(shares).astype(float)
            scores, a, _ = pooled(e, s, sizes, model.p["b"][0] if model.constant is None else 0.0)
            if model.constant is not None:
                scores = np.full(len(sizes), model.constant)
            first = np.cumsum(sizes) - sizes
            best = np.maximum.reduceat(a, first)
            where = np.flatnonzero(a == np.repeat(best, sizes))
            focus = where[np.searchsorted(where, first)] - first
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= GOOD).astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(focus, pa.int64()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text"), judge, schema)

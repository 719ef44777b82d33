"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches, per kind, of four patterns (email, ip, card,
phone); a match that fails its check is dropped. They are found in linear time: each pattern is
only tried where a match can begin.

The field looks at *islands*, short stretches around digits, ``@`` and spelled-out addresses.
An island is cut into tokens; every run of up to ``LONGEST`` tokens is a candidate segment for every
kind, scored by features of the whole span (shape, digit and group counts, separators, checksum,
words before it). Dynamic programming over segments of bounded length, with the remaining tokens
outside, chooses boundaries and kinds together. Base spans stay as they are; the field decides
about the text between them. It is trained here by conditional likelihood: the labels are the base
spans of a bounded sample (``SAMPLE_DOCS`` documents expected, ``SAMPLE_PER_TEXT`` islands of each with at most ``SAMPLE_CHARS``
code points, ``SAMPLE_ISLANDS`` in all), as
they stand and rewritten the way people disguise them (``disguises``), and the rest of the islands as
negatives. It can so add disguised mentions that the patterns miss.

Offsets are code points. Nulls: a null text has no spans. Empty tables give no rows, repeated rows
are searched each, other columns are ignored. Without base spans in the sample nothing is learned
and nothing added.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, map_arrow, table

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LONGEST, ROUNDS = 24, 40
#: Bounds of the sample to learn from, and of nothing else: documents, islands of one document, islands in all, and
#: code points of an island. Every text is searched whole.
SAMPLE_DOCS, SAMPLE_PER_TEXT, SAMPLE_ISLANDS, SAMPLE_CHARS = 4000, 8, 400, 400
#: Characters on either side of an island that it may take in.
MARGIN = 24
#: Tokens whose segments are scored at once.
BLOCK = 1024

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_CUE = re.compile(r"[0-9@]")
_NUMBERS = re.compile(r"\+?[0-9][0-9 ().+-]*")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{1,63}(?: ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[A-Za-z0-9-]{1,63})+")
_SPELLED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(]? ?(?:\.|dot|DOT) ?[\])]? ?[0-9]{1,3}){3}(?![0-9])")

Span = tuple[int, int, int]  # start, end, position in KINDS


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    cue = re.search(r"[0-9]", text)
    if cue:
        from_ = max(0, cue.start() - 1)
        for m in _IP.finditer(text, from_):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text, from_):
            if 12 <= m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text, from_):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
        out.sort(key=lambda s: (s[0], s[2]))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


# Islands and features


_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of text that the field looks at, in order and apart."""
    found = []
    if _CUE.search(text):
        for m in _NUMBERS.finditer(text):
            if sum(c in "0123456789" for c in m[0]) >= 4:
                found.append(m.span())
        found += [m.span() for m in _SPELLED_IP.finditer(text)]
        for s in (m.start() for m in re.finditer("@", text)):
            found.append((max(0, s - 40), min(len(text), s + 60)))
    if re.search(r"\bdot\b", text, re.I):
        found += [m.span() for m in _SPELLED.finditer(text) if re.search(r"dot\b", m[0], re.I)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        s, e = max(0, s - MARGIN), min(len(text), e + MARGIN)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: Words before a span that tell its kind.
CUES = {"email": 0, "mail": 0, "e-mail": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "credit": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3}
FEATURES = 49


def span_features(tokens: list[str], i: int, j: int) -> list[int]:
    """Numbers of the features of the segment tokens[i:j], the same for each kind."""
    part = tokens[i:j]
    text = "".join(part)
    digits = "".join(t for t in part if t.isdigit())
    letters = sum(t.isalpha() for t in part)
    groups = [t for t in part if t.isdigit()]
    nd, out = len(digits), [0]
    out.append(1 + min(nd // 2, 10))  # 1-11
    out.append(12 + min(len(groups), 6))  # 12-18
    if 12 <= nd <= 19:
        out.append(19 if luhn(digits) else 20)
    if "@" in part:
        out.append(21 if part.count("@") == 1 else 22)
    words = [t.lower() for t in part if t.isalpha()]
    if "at" in words[1:-1] and "dot" in words[2:]:
        out.append(23)
    if "." in part:
        out.append(24 + min(part.count("."), 3))  # 25-27
    if letters:
        out.append(47 if nd and set(words) == {"dot"} else 28 if nd else 29)
    if text[0] == "+":
        out.append(30)
    if text[0] == "(":
        out.append(31)
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append(32 if "." in part or "dot" in words else 33)
    if any(t.isspace() for t in part):
        out.append(34)
    if any(c in text for c in "[]"):
        out.append(35)
    if "-" in part:
        out.append(36)
    if part[0].isspace() or part[-1].isspace():
        out.append(37)
    if not (part[-1].isalnum()):
        out.append(38)
    before = next((t.lower() for t in reversed(tokens[max(0, i - 4) : i]) if t.isalpha()), "")
    if before in CUES:
        out.append(39 + CUES[before])  # 39-42
    names = [t.lower() for t in part]
    if "at" in words or "@" in part:
        local = names[: names.index("@" if "@" in part else "at")]
        inside = "".join(local).strip(" [(")
        out.append(44 if any(c.isspace() for c in inside) else 45)
        if re.search(r"\.\s|\s\.", text):
            out.append(48)
        if part[-1].isalpha() and 2 <= len(part[-1]) <= 6 and [t for t in names[:-1] if t.isalnum() or t == "."][-1:] in (["."], ["dot"]):
            out.append(46)
    if (i and tokens[i - 1].isalnum() and part[0].isalnum()) or (j < len(tokens) and tokens[j].isdigit() and part[-1].isdigit()):
        out.append(43)
    return out


def candidates(tokens: list[str], first: int, last: int) -> list[tuple[int, int, list[int]]]:
    """The candidate segments that start at tokens first to last - 1, by start, and their features."""
    segments = []
    for i in range(first, last):
        if tokens[i].isspace() or not (tokens[i].isalnum() or tokens[i] in "+("):
            continue
        strong = spelled = dotted = False
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            t = tokens[j - 1]
            strong = strong or t == "@" or t.lower() in ("at", "dot") or (t.isdigit() and (len(t) > 2 or j - i > 2))
            spelled = spelled or t.lower() == "at"
            dotted = dotted or t == "@" or t.lower() == "dot"
            # A spelled-out address has a spelled-out dot; "at" alone is a word like others.
            if strong and t.isalnum() and not (t.isalpha() and j - i < 3) and (dotted or not spelled):
                segments.append((i, j, span_features(tokens, i, j)))
    return segments


def indicators(segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """Segments x features."""
    out = np.zeros((len(segments), FEATURES))
    for row, (_, _, f) in zip(out, segments, strict=True):
        row[f] = 1
    return out


@dataclass(frozen=True)
class Island:
    """Tokens, their offsets from the island's start, and the candidate segments."""

    tokens: list[str]
    offsets: list[int]
    segments: list[tuple[int, int, list[int]]]

    @classmethod
    def of(cls, text: str) -> Island:
        found = list(_TOKEN.finditer(text))
        tokens, offsets = [m[0] for m in found], [m.start() for m in found] + [len(text)]
        return cls(tokens, offsets, candidates(tokens, 0, len(tokens)))

    def matrix(self) -> np.ndarray:
        return indicators(self.segments)


class Field:
    """Weights (kinds x features); the score of a segment is the sum of its features' weights."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.w = np.zeros((len(KINDS), FEATURES)) if weights is None else weights

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, token after the last, kind) of its segments.

        Segments are made and scored for ``BLOCK`` starts at a time, so a stretch may be of any length.
        """
        n = len(tokens)
        best, back = [0.0] + [-math.inf] * n, [(-1, 0)] * (n + 1)
        for first in range(0, n, BLOCK):
            last = min(first + BLOCK, n)
            segments = candidates(tokens, first, last)
            scores, at = (indicators(segments) @ self.w.T).tolist(), 0
            for i in range(first, last):
                if i and best[i - 1] >= best[i]:
                    best[i], back[i] = best[i - 1], (-1, 0)
                while at < len(segments) and segments[at][0] == i:
                    j = segments[at][1]
                    for k, v in enumerate(scores[at]):
                        if best[i] + v > best[j]:
                            best[j], back[j] = best[i] + v, (i, k)
                    at += 1
        if n and best[n - 1] >= best[n]:
            back[n] = (-1, 0)
        out, j = [], n
        while j:
            i, k = back[j]
            if i < 0:
                j -= 1
            else:
                out.append((i, j, k))
                j = i
        return out[::-1]

    @staticmethod
    def expected(island: Island, scores: np.ndarray) -> np.ndarray:
        """Probability of each segment under each kind, by forward and backward sums."""
        n, peak = len(island.tokens), scores.max(axis=1)
        total = (peak + np.log(np.exp(scores - peak[:, None]).sum(axis=1))).tolist()
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for (i, j, _), t in zip(island.segments, total, strict=True):
            by_end[j].append((i, t))
            by_start[i].append((j, t))

        def add(terms: list[float]) -> float:
            top = max(terms)
            return top + math.log(sum(math.exp(t - top) for t in terms))

        for j in range(1, n + 1):
            forward[j] = add([forward[j - 1], *(forward[i] + t for i, t in by_end[j])]) if by_end[j] else forward[j - 1]
        for i in range(n - 1, -1, -1):
            backward[i] = add([backward[i + 1], *(backward[j] + t for j, t in by_start[i])]) if by_start[i] else backward[i + 1]
        outer = np.array([forward[i] + backward[j] - forward[n] for i, j, _ in island.segments])
        return np.exp(scores + outer[:, None])

    def fit(self, data: list[tuple[Island, set[tuple[int, int, int]]]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 3e-4) -> Field:
        """Ascends the conditional likelihood with per-weight step sizes."""
        self.w[:, 0] = -4.0
        rows = []
        for island, gold in data:
            seen = np.array([[(i, j, k) in gold for k in range(len(KINDS))] for i, j, _ in island.segments], float)
            rows.append((island, island.matrix(), seen))
        size = np.full_like(self.w, 1e-8)
        for _ in range(rounds):
            grad = -decay * len(data) * self.w
            for island, x, seen in rows:
                grad += (seen - self.expected(island, x @ self.w.T)).T @ x
            size += grad**2
            self.w += rate * grad / np.sqrt(size)
        return self


def disguises(text: str, kind: int) -> list[str]:
    """Ways in which people write a span of this kind so that patterns miss it."""
    if kind == 0:
        names = {text, re.sub(r"[0-9]", "", text).replace(".@", "@")}
        out = []
        for local, _, domain in (n.partition("@") for n in sorted(names)):
            if local and domain:
                out += [f"{local} at {domain.replace('.', ' dot ')}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain.replace('.', '(dot)')}"]
        return out
    if kind == 1:
        return [text.replace(".", "[.]"), text.replace(".", " dot ")]
    if kind == 3:
        return [re.sub(r"^\+[0-9]{1,2}[ .-]?", "", text)]
    digits = re.sub(r"[^0-9]", "", text)
    return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]


def training_set(samples: list[tuple[str, list[Span]]]) -> list[tuple[Island, set[tuple[int, int, int]]]]:
    """Islands with the segments of their base spans, as they stand and disguised."""
    out, rng = [], random.Random(7)
    for text, spans in samples:
        versions = [(text, spans)]
        if spans:
            s, e, k = rng.choice(spans)
            apart = [x for x in spans if x != (s, e, k) and (x[1] <= s or x[0] >= e)]
            for new in disguises(text[s:e], k):
                shift = len(new) - (e - s)
                moved = [x if x[1] <= s else (x[0] + shift, x[1] + shift, x[2]) for x in apart]
                versions.append((text[:s] + new + text[e:], [*moved, (s, s + len(new), k)]))
        for t, gold in versions:
            island = Island.of(t)
            if not island.segments:
                continue
            start, end = {o: n for n, o in enumerate(island.offsets)}, {o: n for n, o in enumerate(island.offsets)}
            found = {(start[s], end[e], k) for s, e, k in gold if s in start and e in end}
            known = {(i, j) for i, j, _ in island.segments}
            out.append((island, {g for g in found if g[:2] in known}))
    return out


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds in the islands of text between the base spans."""
    out = []
    for s, e in islands(text):
        at = s
        for b, f, _ in [*(x for x in base if x[0] < e and x[1] > s), (e, e, 0)]:
            if b - at > 8:
                found = list(_TOKEN.finditer(text, at, b))
                out += [(found[i].start(), found[j - 1].end(), k) for i, j, k in field.decode([m[0] for m in found])]
            at = max(at, f)
    return out


def find(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    if field is None:
        return base, base
    more = added_spans(text, base, field)
    return base, sorted({*base, *more}, key=lambda s: (s[0], s[2], s[1])) if more else base


def train(docs: DataFrame) -> Field | None:
    """The field, fitted on the islands of a bounded sample of documents with a cue."""
    ids = F.xxhash64(F.col("doc_id"), F.lit(11))
    count = docs.select("doc_id").count()
    share = min(1.0, SAMPLE_DOCS / max(count, 1))
    sample = docs.where(F.pmod(ids, F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(ids.alias("h"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                for s, e in islands(text)[:SAMPLE_PER_TEXT]:
                    if e - s <= SAMPLE_CHARS:
                        inside = [x for x in base if s <= x[0] and x[1] <= e]
                        rows.append((h, not inside, s, text[s:e], ",".join(f"{x[0] - s}:{x[1] - s}:{x[2]}" for x in inside)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["h", "empty", "at", "text", "gold"])

    # Written once: the bounded sample is read twice, the documents are not.
    found = table(sample.transform(map_arrow, run, "h long, empty boolean, at long, text string, gold string"), "islands")
    half = SAMPLE_ISLANDS // 2
    rows = [r for empty in (False, True) for r in found.where(F.col("empty") == empty).orderBy("h", "at", "text").limit(half).collect()]
    free(found)
    samples = [(r.text, [tuple(map(int, x.split(":"))) for x in r.gold.split(",") if x]) for r in rows]
    return Field().fit(training_set(samples)) if any(g for _, g in samples) else None


def detect(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, the count of base spans per kind, base_sha256, spans (all, base and added), n_added, n_spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part, rows = b.slice(at, 2000), []
                for text in part.column(1).to_pylist():
                    base, spans = find(text or "", field)
                    rows.append((*(sum(x[2] == k for x in base) for k in range(4)), sha256(render(base).encode()).hexdigest(), render(spans), len(spans) - len(base), len(spans)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(map_arrow, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets, n_chars following.

    Overlapping spans are replaced as one, under the kind of the first. All columns are kept.
    """
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(names.index("text")).to_pylist():
                spans = find(text, field)[1] if text else []
                out, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        out += [text[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                texts.append("".join([*out, text[at:]]) if spans else text)
            column = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([column if c == "text" else b.column(i) for i, c in enumerate(names)], names=names)

    out = docs.transform(map_arrow, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out

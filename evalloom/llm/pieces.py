"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as a protobuf: pieces with scores and types, the trainer's model type and
byte fallback, and the normaliser's flags and character map. From these the same tokenizer is built
out of the library's parts: the character map, removal of extra spaces, the dummy prefix and the
metaspace marker as normalisers, and a unigram or a BPE model with byte fallback. For BPE the merges
are every split of a piece into two pieces, ranked as the merged pieces are.

Every text goes through the rebuilt normaliser. Where no piece has the marker after another character,
no segmentation crosses the end of a run of non-markers. If the normaliser does nothing but set
markers, normalised texts are therefore cut there, and each distinct segment of a batch is encoded and
decoded by the rebuilt tokenizer once; a bounded number are remembered. Otherwise texts are encoded and
decoded whole. The library encodes batches by several threads. Whatever is encoded, segment or
text, is verified against the sentencepiece library, and a row that holds something that differs takes
the ids of that library, so the ids are always the model's; ``parity`` is false for such rows.

Nulls: a null or empty text has no tokens; a null text is decoded to null. A marker in a text is decoded to
a space, as the model has one piece for both. Repeated rows are encoded each; empty tables give no rows.
Other columns are ignored but for those ``encode`` keeps. Texts are encoded whole, a bounded number of bytes at a time.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import as_lists, map_arrow

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Threads of the library in each Python worker, and bytes of text given to them at once.
THREADS, BATCH_BYTES = 2, 4 << 20
#: Segments that a worker remembers with their ids.
CACHE = 250_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + n]
        at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        out = cls()
        for number, value in fields(raw):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
                out.pieces.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]), piece[3]))
            elif number == 2:
                spec = dict(fields(value))
                out.kind, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.remove_extra, out.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, in the order in which BPE applies them."""
        usable = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        ranked = sorted(usable, key=lambda p: (-self.pieces[usable[p]][1], usable[p]))
        out = []
        for p in ranked:
            splits = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            out += sorted(splits, key=lambda s: (usable[s[0]], usable[s[1]]))
        return out

    def cuts(self) -> bool:
        """Whether a text may be cut before each marker that follows another character."""
        return not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER))

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            # Control and unused pieces keep their ids under scores that no segmentation takes.
            vocab = [(p, s if t in (NORMAL, USER, UNKNOWN) else -1e9) for p, s, t in self.pieces]
            model = models.Unigram(vocab, self.unknown, self.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        if self.cuts():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        # The space of the dummy prefix is taken off a whole text, not off each of its segments.
        # No encoding holds a control piece, nor an unknown one where bytes stand in for it.
        unknown = [] if self.byte_fallback else [decoders.Replace(self.pieces[self.unknown][0], " \u2047 ")]
        out.decoder = decoders.Sequence([*unknown, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out

    def plain(self) -> bool:
        """Whether segments can be encoded one by one."""
        return self.cuts() and self.escape and self.dummy_prefix and not self.charsmap and not self.remove_extra


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Rebuilt:
    """The tokenizer rebuilt from a model file, and the library that it is verified against."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        with open(path, "rb") as f:
            model = Model.parse(f.read())
        self.ours, self.theirs = model.tokenizer(), sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix, self.by_segment = model.dummy_prefix, model.plain()
        self.is_byte = np.array([p[2] == BYTE for p in model.pieces])
        self.normalizer = self.ours.normalizer
        if self.by_segment:  # texts are normalised before they are cut
            self.ours.normalizer = self.ours.pre_tokenizer = None
        #: Ids by segment, as bytes of 32-bit integers; segments on which the libraries differ; those that decode to something else.
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.changed: dict[str, str] = {}

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self._bare(x) for x in self.ours.decode_batch(ids, skip_special_tokens=False)]

    def _bare(self, text: str) -> str:
        return text[1:] if self.prefix and text[:1] == " " else text

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[str]]:
        """Ids of each text, whether both libraries agree on them, and what they decode to."""
        return self._cut(texts) if self.by_segment else self._whole(texts)

    def _whole(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[str]]:
        found = [e.ids for e in self.ours.encode_batch_fast(texts, add_special_tokens=False)]
        check = self.theirs.encode(texts, num_threads=1)
        same = [a == b for a, b in zip(found, check, strict=True)]
        return [np.array(x, np.int32) for x in check], same, self.decode(check)

    def _cut(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[str]]:
        if len(self.odd) + len(self.changed) > CACHE:
            for kept in (self.known, self.odd, self.changed):
                kept.clear()
        known, normal = self.known, self.normalizer.normalize_str
        normalised = [normal(t) if t else "" for t in texts]
        cut = [segments(n) if n else [] for n in normalised]
        held = {x: known.get(x) for x in dict.fromkeys(chain.from_iterable(cut))}
        new = [x for x, v in held.items() if v is None]
        plain = [x.replace(MARK, " ") for x in new] if any(MARK in x for x in new) else new
        found = [e.ids for e in self.ours.encode_batch_fast([MARK + x for x in new], add_special_tokens=False)]
        decoded = self.ours.decode_batch(found, skip_special_tokens=False)
        # By itself, an empty text has no marker; within another one it has.
        differ = {x for x, ids, other in zip(new, found, self.theirs.encode(plain, num_threads=1), strict=True) if ids != other and x}
        self.odd |= differ
        self.changed.update((x, d) for x, d, p in zip(new, decoded, plain, strict=True) if d != " " + p)
        held.update((x, array("i", ids).tobytes()) for x, ids in zip(new, found, strict=True))
        # The segments that come first are remembered: most later ones are rare.
        known.update((x, held[x]) for x in islice(new, max(0, CACHE - len(known))))
        look, out = held.__getitem__, ([], [], [])
        for t, n, c in zip(texts, normalised, cut, strict=True):
            agreed = not self.odd or self.odd.isdisjoint(c)
            ids = np.frombuffer(b"".join(map(look, c)), np.int32) if agreed else np.array(self.theirs.encode(t), np.int32)
            if not agreed:
                text = self.decode([ids.tolist()])[0]
            elif self.changed and not self.changed.keys().isdisjoint(c):
                text = self._bare("".join([self.changed.get(x, " " + x.replace(MARK, " ")) for x in c]))
            else:  # every segment was decoded to itself
                text = n[1:].replace(MARK, " ")
            for column, v in zip(out, (ids, agreed, text), strict=True):
                column.append(v)
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Rebuilt:
    return Rebuilt(path)


def segments(normal: str) -> list[str]:
    """A normalised text cut before each run of markers; a segment is written without its first one."""
    if MARK + MARK not in normal and normal[-1:] != MARK:
        return normal[1:].split(MARK)
    return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", normal)]


def encode_texts(texts: list[str], path: str) -> tuple[list[list[int]], list[bool]]:
    """Ids of each text, and whether both libraries agree on them."""
    ids, same, _ = load(path)(texts)
    return [x.tolist() for x in ids], same


def decode_texts(ids: list[list[int]], path: str) -> list[str]:
    """The text of each list of ids."""
    return load(path).decode(ids)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of docs with input_ids, parity and decoded, the text that the
    ids give back."""
    path, keep = path or default_model(), keep or ["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(len(keep)).to_pylist()
            texts = [t or "" for t in given]
            for start, end in _batches(texts):
                ids, same, back = load(path)(texts[start:end])
                part = b.slice(start, end - start)
                lists = as_lists(ids, pa.int32())
                decoded = [None if t is None else x for t, x in zip(given[start:end], back, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists, pa.array(same), pa.array(decoded, pa.string())], names=[*keep, "input_ids", "parity", "decoded"])

    new = {"input_ids": ArrayType(IntegerType()), "parity": BooleanType(), "decoded": StringType()}
    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, t) for c, t in new.items())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).transform(map_arrow, run, schema)


def summarize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, parity, round_trip) for each row of docs.

    ids_sha256 is the digest of the ids as little-endian 32-bit integers; n_byte_tokens counts pieces
    of byte fallback; round_trip says whether decoding gives the text back.
    """
    path = path or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for start, end in _batches(texts):
                ids, same, back = load(path)(texts[start:end])
                is_byte = load(path).is_byte
                cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([sha256(x.astype("<i4", copy=False)).hexdigest() for x in ids]), pa.array(same), pa.array([x == t for x, t in zip(back, texts[start:end], strict=True)])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), *cols], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "parity", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(map_arrow, run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, parity boolean, round_trip boolean")

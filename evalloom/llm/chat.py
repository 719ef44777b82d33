"""Chat formatting on token level.

Each turn is encoded by itself with a byte-level BPE vocabulary and set between reserved ids that
the vocabulary does not hold, so no text can ever produce one. The loss mask comes from prefix sums
over the markers: a token counts where more assistant segments were opened than closed before it.
Control strings inside a text are escaped, so that the rendered conversation can be read back as
text too: ``ESCAPE`` goes after the first character of a control string, once more than there were
already, and reading takes one away.

Template, by role: ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]``, ``<s>text</s>`` (assistant), and
``[ROLE]role[/ROLE]text[/TURN]`` for any other role. Only the text of an assistant is under the mask.

Rows are ordered by turn, then role, then tokens, so ties have one order. Nulls: a null text or
role is empty; null turns come first; rows with a null conv_id form one conversation. Repeated rows
are turns of their own. Empty tables give no rows. Other columns are ignored. Turns are encoded where
they are read; reading back streams each conversation in order, one turn at a time, since a digest
over a conversation needs its turns in sequence: a task holds one Arrow batch, however long it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_lists, map_arrow

VOCABULARY = "byte_bpe_50k.tiktoken"
ESCAPE = "⁠"
SYS, END_SYS, INST, END_INST, BOS, EOS, ROLE, END_ROLE, END_TURN = CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
FRAMES = {"system": (SYS, END_SYS), "user": (INST, END_INST), "assistant": (BOS, EOS)}
_ESCAPED = re.compile("|".join(f"({re.escape(c[0])})({ESCAPE}*)({re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return _ESCAPED.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == ESCAPE else m[0], text)


@dataclass(frozen=True)
class Template:
    """Encodes and reads turns. path: the vocabulary as base64 tokens and ranks."""

    path: str

    @property
    def encoding(self):
        return _encoding(self.path)

    def reserved(self, control: str) -> int:
        return self.encoding.n_vocab + CONTROLS.index(control)

    def turn(self, role: str, text: str) -> list[int]:
        """Ids of one turn: segments encoded separately, reserved ids spliced between."""
        encode = self.encoding.encode_ordinary
        if role in FRAMES:
            start, end = FRAMES[role]
            return [self.reserved(start), *encode(escape(text)), self.reserved(end)]
        return [self.reserved(ROLE), *encode(escape(role)), self.reserved(END_ROLE), *encode(escape(text)), self.reserved(END_TURN)]

    def loss_mask(self, ids: np.ndarray) -> np.ndarray:
        """True for the tokens of assistant texts, by prefix sums over their markers."""
        opened, closed = ids == self.reserved(BOS), ids == self.reserved(EOS)
        return (np.cumsum(opened) - opened - np.cumsum(closed)) > 0

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def render(self, ids: np.ndarray) -> str:
        """The formatted text, control strings included."""
        first, out, at = self.encoding.n_vocab, [], 0
        for k in np.flatnonzero(ids >= first).tolist():
            out += [self.text(ids[at:k]), CONTROLS[int(ids[k]) - first]]
            at = k + 1
        return "".join([*out, self.text(ids[at:])])

    def read(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns in ids."""
        first, role, at = self.encoding.n_vocab, None, 0
        roles = {self.reserved(start): name for name, (start, _) in FRAMES.items()}
        for k in np.flatnonzero(ids >= first).tolist():
            mark = int(ids[k])
            if mark in roles:
                role = roles[mark]
            elif mark == self.reserved(END_ROLE):
                role = unescape(self.text(ids[at:k]))
            elif mark != self.reserved(ROLE):
                yield role, unescape(self.text(ids[at:k]))
            at = k + 1


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, turn, role, input_ids, loss_mask) for each row of ``turns``."""
    template = Template(path or default_vocabulary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                ids = [np.array(template.turn(r or "", t or ""), dtype=np.int32) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                whole = np.concatenate(ids)
                masks = np.split(template.loss_mask(whole), np.cumsum([len(x) for x in ids])[:-1])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], as_lists(ids, pa.int32()), as_lists(masks, pa.bool_())], names=["conv_id", "turn", "role", "input_ids", "loss_mask"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text")
    return rows.transform(map_arrow, run, f"conv_id {kind}, turn long, role string, input_ids array<int>, loss_mask array<boolean>")


def digest_conversations(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Reads formatted turns back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_tokens) for each conversation."""
    template = Template(path or default_vocabulary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for b in batches:
            done = []
            ids_of, masks = b.column(1).to_pylist(), b.column(2).to_pylist()
            for k, conv in enumerate(b.column(0).to_pylist()):
                if state is None or conv != name:
                    if state:
                        done.append((name, state))
                    name, state = conv, [0, sha256(), 0, sha256(), 0, 0]
                ids, mask = np.array(ids_of[k], dtype=np.int64), np.array(masks[k], dtype=bool)
                for role, text in template.read(ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if mask.any():
                    loss = unescape(template.text(ids[mask]))
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(template.render(ids))
                state[5] += len(ids)
            if done:
                yield _rows(done, b.schema.field(0).type)
        if state:
            yield _rows([(name, state)], b.schema.field(0).type)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "input_ids")
    return ordered.select("conv_id", "input_ids", "loss_mask").transform(map_arrow, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def _rows(done: list, kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    cols = [[c for c, _ in done], *([s[i].hexdigest() if i in (1, 3) else s[i] for _, s in done] for i in range(6))]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

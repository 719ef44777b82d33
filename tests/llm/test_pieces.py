import random
import struct

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import pieces

from .helpers import documents, rows


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model():
    """A hand-written model: no tokenizer is trained."""
    normal = {"▁": -3.0, "▁a": -2.0, "b": -4.0, "a": -4.5, "ab": -3.5, "▁ab": -3.0, "c": -5.0, "bc": -4.2, "é": -6.0}
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in normal.items())]
    return message(*((1, message((1, p), (2, s), (3, t))) for p, s, t in vocab), (2, message((3, 1), (35, 1))), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))


@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", " ", "  ", "▁", "</s>", "é", "🙂", "the", "\n", "The."]), max_size=30).map("".join)))
@settings(max_examples=300, deadline=None)
def test_bpe_parity_and_round_trip(text):
    path = pieces.default_model()
    ids, same = pieces.encode_texts([text], path)
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    assert ids == theirs.encode([text]) and same == [True]
    assert pieces.decode_texts(ids, path) == theirs.decode(ids) == [text.replace("▁", " ")]


def test_unigram_parity(tmp_path):
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(unigram_model())
    model = pieces.Model.parse(unigram_model())
    assert (model.kind, model.byte_fallback, model.unknown) == (pieces.UNIGRAM, True, 0)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(30))) for _ in range(200)]
    ids, same = pieces.encode_texts(texts, path)
    assert ids == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert sum(same) > 150
    assert pieces.decode_texts(ids, path) == sentencepiece.SentencePieceProcessor(model_file=path).decode(ids)


def test_the_main_path_normalises_and_decodes_with_what_was_rebuilt(monkeypatch):
    path = pieces.default_model()
    pieces.load.cache_clear()
    rebuilt = pieces.load(path)
    seen = []

    class Watched:
        def normalize_str(self, text):
            seen.append(text)
            return type(self).real.normalize_str(text)

    Watched.real = rebuilt.normalizer
    monkeypatch.setattr(rebuilt, "normalizer", Watched())
    ids, same, back = rebuilt(["a  b", "", " c "])
    assert seen == ["a  b", " c "] and back == ["a  b", "", " c "] and same == [True] * 3
    assert rebuilt.decode([x.tolist() for x in ids]) == back
    pieces.load.cache_clear()


def test_whole_texts_agree(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    path = pieces.default_model()
    assert pieces.encode_texts(texts, path)[0] == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)


def test_table(spark):
    df = documents(spark, ["a b", None, "", "a b", "x" * 200_000], [1, 2, 3, None, 5]).withColumnRenamed("source", "input_ids")
    found = rows(pieces.summarize(df))
    assert (found[2].n_tokens, found[3].n_tokens) == (0, 0)
    assert found[1].ids_sha256 == found[None].ids_sha256
    assert all(r.parity and r.round_trip for i, r in found.items() if i != 2) and found[5].n_tokens > 0
    assert pieces.summarize(df.limit(0)).count() == 0

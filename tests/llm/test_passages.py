"""The passage classifier: encoding and gradients against plain versions, held-out accuracy, edges."""

import random
import re
import zlib

import numpy as np
import pytest

from evalloom.llm import passages

from .test_edges import clashing

SF = "/root/testdata/sf0.01"


def as_bytes(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def plain_pieces(raw):
    out = []
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        at = m.start()
        while at < m.end():
            end = min(m.end(), (at // passages.CUT + 1) * passages.CUT)
            out.append((at, end))
            at = end
    return out


def test_pieces_and_features_against_plain_versions():
    rng = random.Random(3)
    for trial in range(60):
        words = [rng.choice(["the", "The", "NO!!", "a|b", "é€", "日本", "12", "w" * rng.randrange(1, 9), "x" * rng.choice([5, 3000])]) for _ in range(rng.randrange(1, 300))]
        text = "".join(w + rng.choice([" ", "\n", " \t"]) for w in words)[: rng.randrange(1, 9000)]
        raw = as_bytes(text)
        starts, ends = passages.pieces(raw)
        cut = plain_pieces(raw.tobytes())
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == cut
        x = passages.encode(raw, starts, ends)
        assert x.shape == (max(1, -(-len(cut) // 64)), passages.FEATURES) and np.isfinite(x).all()
        for k in range(0, len(cut), 64):
            some = [raw[a:b].tobytes() for a, b in cut[k : k + 64]]
            stop = cut[k + 64][0] if k + 64 < len(cut) else cut[-1][1]
            part, row = raw[cut[k][0] : stop].tobytes(), x[k // 64]
            assert row[3] == pytest.approx(sum(65 <= b <= 90 for b in part) / len(part), rel=1e-5)
            assert row[9] == pytest.approx(part.count(b"|") / len(part), rel=1e-5)
            assert row[passages.KINDS] == pytest.approx(sum(a == b for a, b in zip(some, some[1:])) / len(some), rel=1e-5)  # noqa: B905, RUF007
            assert row[passages.KINDS + 6] == pytest.approx(len(set(some)) / len(some), rel=1e-5)


def test_long_texts_come_in_blocks(monkeypatch):
    raw = as_bytes(" ".join(f"w{k % 977}" for k in range(3_000)))
    whole = list(passages.passages(raw))
    monkeypatch.setattr(passages, "CHUNK", 5)
    parts = list(passages.passages(raw))
    assert len(whole) == 1 and max(map(len, parts)) == 5 and sum(map(len, parts)) == len(whole[0])
    # Only the gap behind the last word of a block is not counted.
    assert np.abs(np.concatenate(parts) - whole[0]).max() < 0.1


def small_model(rng):
    model = passages.Model.__new__(passages.Model)
    model._start(rng)
    model.p = {k: x.astype(float) + rng.normal(size=x.shape) * 0.1 for k, x in model.p.items()}
    return model


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model, sizes, y = small_model(rng), np.array([3, 1, 5]), np.array([1.0, 0.0, 0.0])
    x = rng.normal(size=(9, passages.FEATURES))

    def loss():
        """The log loss by the definition of the attention, document by document."""
        p, total, at = model.p, 0.0, 0
        for n, label in zip(sizes, y, strict=True):
            h = np.maximum(x[at : at + n] @ p["W"] + p["w0"], 0)
            e = np.array([p["w"] @ (np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) for v in h])
            a = np.exp(e) / np.exp(e).sum()
            q = 1 / (1 + np.exp(-((a @ h) @ p["c"] + p["b"][0])))
            total -= np.log(q if label else 1 - q)
            at += n
        return total

    grad = model.gradient(x, sizes, y)
    for k, values in model.p.items():
        for i in rng.integers(values.size, size=6):
            flat = values.reshape(-1)
            was, eps = flat[i], 1e-6
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=1e-5), k


def test_the_attention_finds_the_telling_passage():
    rng = np.random.default_rng(2)
    bags, y = [], []
    for k in range(400):
        bag = rng.normal(size=(rng.integers(2, 8), passages.FEATURES)).astype(np.float32)
        y.append(k % 2)
        if k % 2 == 0:
            bag[rng.integers(len(bag)), :4] += 6
        bags.append(bag)
    model = passages.Model(bags, np.array(y))
    hits = 0
    for bag, label in zip(bags, y, strict=True):
        e, s = model.parts(model.scaled(bag))[:2]
        score, a, _ = passages.pooled(e, s, np.array([len(bag)]), model.p["b"][0])
        assert (score[0] >= 0.5) == bool(label)
        hits += label == 0 and a.argmax() == bag[:, :4].sum(1).argmax()
    assert hits > 180


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = passages.score(docs, passages.train(docs, labels))
    rows = found.join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert found.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and 0 <= r.focus < r.n_passages and 0 < r.weight <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    good = [r.predicted for r in held if r.quality]
    assert sum(good) >= 0.97 * len(good)


def test_nulls_labels_repeats_and_clashing_columns(spark):
    long = " ".join(f"word{k % 977}" for k in range(120_000))
    data = [(1, None), (2, ""), (3, long), (4, "a b"), (4, "a b"), (4, "OTHER!! TEXT!!"), (None, "x" * 300_000)]
    docs = clashing(spark, data)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    some = [i for i in (2, 3) if zlib.crc32(str(i).encode()) % 4 != 2]
    for rows in ([], [(2, 1, 0), (3, 1, 0), (4, None, 0), (None, 0, 0)]):
        found = passages.score(docs, passages.train(docs, labels(rows))).collect()
        # The long text is over the bound of passages to learn from.
        known = [i for i, q, _ in rows if i == 2 and i in some]
        assert {r.score for r in found} == {(len(known) + 1) / (len(known) + 2)} and len(found) == 7
        count = -(-len(passages.pieces(as_bytes(long))[0]) // passages.WORDS)
        assert {(r.doc_id, r.n_passages) for r in found} == {(1, 1), (2, 1), (3, count), (4, 1), (None, 5)}
    many = clashing(spark, [(k, f"good words number {k} here" if k % 2 else f"BAD!! {k} BAD!! BAD!!") for k in range(80)])
    model = passages.train(many, labels([(k, k % 2, 0) for k in range(80)] + [(1, 1, 1), (None, 1, 1)]))
    found = {(r.doc_id, r.predicted) for r in passages.score(many, model).collect()}
    assert found == {(k, k % 2) for k in range(80)}
    assert passages.score(many.limit(0), model).count() == 0

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from evalloom.llm import repeats
from evalloom.llm.repeats import remove_repeats
from evalloom.llm.suffix_sort import Suffixes, suffix_array

from .helpers import documents, rows


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[p : p + window] for r in raws for p in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - window + 1):
            if count[r[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(r), sum(gone), runs, sha256(kept).hexdigest()))
    return out


def brute_words(texts, words):
    """Words in windows of so many words that another text holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = defaultdict(set)
    for i, w in enumerate(split):
        for p in range(len(w) - words + 1):
            holders[tuple(w[p : p + words])].add(i)
    out = []
    for w in split:
        hit = set()
        for p in range(len(w) - words + 1):
            if len(holders[tuple(w[p : p + words])]) > 1:
                hit.update(range(p, p + words))
        out.append(len(hit))
    return out


def texts(rng):
    shared = ["".join(rng.choice("abé ") for _ in range(rng.randrange(8, 60))) for _ in range(4)]
    out = ["".join(rng.choice([rng.choice(shared), "x" * rng.randrange(30), "".join(rng.choice("abcd") for _ in range(20))]) for _ in range(rng.randrange(6))) for _ in range(25)]
    return [*out, None, "", "z" * 12, "z" * 11, out[0], "ab" * 40]


@pytest.mark.parametrize("crowd", [2000, 1])
def test_matches_brute_force(spark, crowd):
    for seed in range(3):
        t = texts(random.Random(seed))
        found = rows(remove_repeats(documents(spark, t), window=12, anchor=6, crowd=crowd, words=5, words_anchor=2, piece=10))
        assert [tuple(found[i][1:5]) for i in range(len(t))] == brute(t, 12)
        assert [found[i].n_shared_words for i in range(len(t))] == brute_words(t, 5)


@pytest.mark.parametrize("crowd", [2000, 1])
def test_passages_twice_in_one_document_and_partly_in_another(spark, crowd):
    for seed in range(3):
        rng = random.Random(seed)
        word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4)
        t = []
        for _ in range(8):
            passage = [word() for _ in range(rng.randrange(7, 14))]
            twice = [word(), *passage, word(), word(), *passage, word()]
            cut = rng.randrange(3)
            t += [" ".join(twice), " ".join([word(), *passage[cut : cut + 5], word()]), " ".join(word() for _ in range(9))]
        found = rows(remove_repeats(documents(spark, t), window=12, anchor=6, crowd=crowd, words=5, words_anchor=2))
        assert [found[i].n_shared_words for i in range(len(t))] == brute_words(t, 5)
        assert [tuple(found[i][1:5]) for i in range(len(t))] == brute(t, 12)


def test_production_windows(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    shared = words(120)
    t = [words(40) + shared + words(30), shared[100:] + words(10), words(200), shared[:399], shared[:400], shared[:400]]
    found = rows(remove_repeats(documents(spark, t)))
    assert [tuple(found[i][1:5]) for i in range(len(t))] == brute(t, 400)
    assert [found[i].n_shared_words for i in range(len(t))] == brute_words(t, 51)


def test_long_text_over_the_border_of_a_piece(spark):
    rng = random.Random(8)
    passage = " ".join(f"{rng.randrange(10**6)}" for _ in range(80))
    filler = "".join(f"{k:08x}" for k in range((1 << 20) // 8))
    for before in ((1 << 20) - 450, (1 << 20) - 200, 1 << 20):
        t = [filler[:before] + passage + "end", "start " + passage, filler[:300]]
        found = rows(remove_repeats(documents(spark, t)))
        n = len(passage)
        assert [(found[i].n_removed, found[i].n_spans) for i in range(3)] == [(n, 1), (n, 1), (0, 0)]


def test_passages_of_short_words_in_other_documents_only(spark):
    rng = random.Random(9)
    passage = " ".join(f"{rng.randrange(1000)}" for _ in range(60))
    alone = " ".join(f"{rng.randrange(1000)}" for _ in range(55))
    t = ["a b " + passage + " c", "d\n" + passage.replace(" ", "\n"), alone + " e " + alone, " ".join(passage.split()[:50])]
    found = rows(remove_repeats(documents(spark, t)))
    assert [found[i].n_shared_words for i in range(4)] == [60, 60, 0, 0] == brute_words(t, 51)
    assert [found[i].n_removed for i in range(4)] == [0, 0, 0, 0]


def test_repeated_rows_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "k" * 30, "a"), (1, "k" * 30, "a"), (None, None, "b"), (None, "unique text here", "c")], "doc_id long, text string, tid string")
    found = remove_repeats(df, window=12, anchor=6).collect()
    assert sorted(r.n_shared_words for r in remove_repeats(spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "e f g h e f g h")], "doc_id long, text string"), words=4, words_anchor=2).collect()) == [0, 4, 4]
    twice = spark.createDataFrame([(1, "a b c d x a b c d")] * 2 + [(2, "e f g h y e f g h")], "doc_id long, text string")
    assert sorted(r.n_shared_words for r in remove_repeats(twice, words=4, words_anchor=2).collect()) == [0, 9, 9]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in found) == [(-1, 0, 0), (-1, 16, 0), (1, 30, 30), (1, 30, 30)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 300):
        data = bytes(rng.choice(b"ab") for _ in range(n))
        assert suffix_array(data).tolist() == sorted(range(n), key=lambda i: data[i:])


def test_collisions_are_noticed():
    data = np.frombuffer(b"abcabdabe", np.uint8)
    s = Suffixes(data, np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.int64))
    s.extension = lambda i, j: np.minimum(s.sizes[i], s.sizes[j])  # every pair of hashes collides
    order, common = s.sort()
    assert order.tolist() == [0, 1, 2]
    assert common.tolist() == [-1, 2, 2]


def test_short_texts_are_hashed_together(monkeypatch):
    rng = random.Random(11)
    t = [*("".join(rng.choice("abé \n") for _ in range(rng.randrange(200))) for _ in range(300)), "", None, "abé " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(range(len(t))), pa.array(t), pa.array([False] * len(t))], names=["k", "tid", "text", "more"])
    calls, plain = [], repeats.prefix_sums
    monkeypatch.setattr(repeats, "prefix_sums", lambda values: calls.append(1) or plain(values))
    run = repeats._anchors(repeats.kinds(12, 6, 5, 2), 0, 40)
    found = lambda batches: sorted(r for b in run(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    together = found([batch])
    assert len(together) > 2000 and len(calls) < 10
    assert together == found([batch.slice(k, 1) for k in range(len(t))])

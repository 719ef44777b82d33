"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import runs

from .helpers import documents
from .test_edges import clashing


def plain(x):
    """Stretches of equal letters a period apart, of each only the smallest period."""
    n, out, taken = len(x), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= 2 * q and (i, j - i + q) not in taken:
                taken.add((i, j - i + q))
                if j - i + q >= max(6, 4 * q):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out)


def periodic(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 4, 10])
    x = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n >= 8 else 0):
        p, a = rng.randrange(1, max(2, n // 5)), rng.randrange(n)
        for i in range(a + p, min(n, a + p * rng.randrange(2, 9) + rng.randrange(p))):
            x[i] = x[i - p]
    return x


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_their_definition(seed):
    rng = random.Random(seed)
    for _ in range(700):
        x = periodic(rng)
        assert runs.runs_of(np.array(x, dtype=np.int64)) == plain(x), x
        assert runs.word_runs([str(v).encode() for v in x]) == plain(x), x


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_of_powers(parts):
    x = [v for root, times in parts for v in root * times]
    assert runs.runs_of(np.array(x, dtype=np.int64)) == plain(x)
    assert runs.word_runs([str(v).encode() for v in x]) == plain(x)


def test_runs_of_words_full_of_squares():
    fibonacci, other = [0], [0, 1]
    while len(other) < 600:
        fibonacci, other = other, other + fibonacci
    doubling = [0]
    while len(doubling) < 512:
        doubling += [1 - v for v in doubling]
    for x in (other, doubling, [0] * 500, [0, 1] * 200, ([0, 0, 1] * 5 + [2]) * 20):
        assert runs.runs_of(np.array(x)) == plain(x)
        assert runs.word_runs([str(v).encode() for v in x]) == plain(x)


def test_every_distinct_square_is_in_the_vocabulary():
    rng = random.Random(9)
    for _ in range(300):
        x = [rng.randrange(2) for _ in range(rng.randrange(8, 60))]
        tree = runs.SuffixTree(np.array(x))
        start, k = runs._covering(tree)
        ends = runs._vocabulary(tree, start, k) if len(k) else set()
        found = {tuple(x[tree.least[v] : tree.least[v] + long]) for v, long in ends}
        primitive = lambda r: all(r != r[:d] * (len(r) // d) for d in range(1, len(r)) if len(r) % d == 0)
        want = {tuple(x[i : i + 2 * q]) for q in range(1, len(x) // 4 + 1) for i in range(len(x) - 2 * q + 1) if x[i : i + q] == x[i + q : i + 2 * q] and primitive(x[i : i + q])}
        assert found == want


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_query_against_its_contract(spark):
    rng = random.Random(4)
    space = lambda: rng.choice([" ", "  ", "\n", "\t", "\x0b", " ", "\x1c"])
    data = [(k, "".join(f"{'é' if v == 1 else ''}w{v}{space()}" for v in periodic(rng))) for k in range(250)]
    data += [(k, " ".join(f"u{v % (3 + k % 40)}x{v}" for v in range(rng.randrange(200)))) for k in range(300, 400)]
    data += [(500, None), (501, ""), (502, " \n "), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, "x y " * 20), (503, "a " * 5), (504, "a " * 6)]
    found = [tuple(r) for r in runs.summarize(runs.find_runs(runs.with_planted_runs(documents(spark, [t for _, t in data], [i for i, _ in data])))).collect()]
    assert sorted(found, key=str) == sorted((expected(i, t) for i, t in data), key=str)


def test_long_texts_clashing_columns_and_empty_tables(spark):
    n = 60_000
    filler = " ".join(f"w{k}" for k in range(n))
    tail = " ".join(f"t{k % 9_000}" for k in range(n))
    docs = clashing(spark, [(1, "a " * n), (2, f"{filler} {tail}"), (2, filler), (3, None)])
    found = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], len(r.text.split())) for r in runs.find_runs(docs).collect())
    assert found == [(1, n, [(0, n, 1)], 1), (2, n, [], n), (2, 2 * n, [(n, n, 9_000)], n + 9_000), (3, 0, [], 0)]
    assert runs.summarize(runs.find_runs(runs.with_planted_runs(docs.limit(0)))).count() == 0

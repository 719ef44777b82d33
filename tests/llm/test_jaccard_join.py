import random

import numpy as np
import pytest

from evalloom.llm.hashing import shingles
from evalloom.llm.jaccard_join import Frequent, _candidates, frequent_shingles, merge_skip, search, signatures, similar_documents

from .helpers import documents, rows


def brute(texts, ids, size, percent):
    sets = [set(shingles((t or "").encode(), size).tolist()) for t in texts]
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return {i: (len(s), min(ids[k] for k in range(len(ids)) if root(k) == root(n))) for n, (i, s) in enumerate(zip(ids, sets, strict=True))}


def near_copies(rng, bases, copies, words=60):
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, words))]
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(99)}"
            out.append(" ".join(x))
    return out


@pytest.mark.parametrize("size,percent,block,part", [(3, 90, 10**6, 10**6), (3, 90, 60, 10**6), (2, 60, 10**6, 50)])
def test_matches_brute_force(spark, size, percent, block, part):
    rng = random.Random(size + percent)
    texts = [*near_copies(rng, 12, 6), None, "", "  \t", "one", "One", "a b", "A\vb", "x y z", "x y z"]
    ids = list(range(5, 5 + len(texts)))
    rng.shuffle(ids)
    found = rows(similar_documents(documents(spark, texts, ids), size, percent, block, part))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == brute(texts, ids, size, percent)


def test_search_finds_what_all_pairs_find():
    rng = random.Random(3)
    for _ in range(20):
        sets = [shingles(t.encode(), 3) for t in near_copies(rng, 3, 8)]
        up = list(range(len(sets)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in search(sets, 80):
            up[root(b)] = root(a)
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(x & y) >= 80 * len(x | y):
                    assert root(i) == root(j)


def test_merge_skip_counts():
    lists = [[1, 4, 9], [4, 5], [1, 4, 9], [], [9]]
    assert dict(merge_skip(lists, 2)) == {1: 2, 4: 3, 9: 3}
    assert dict(merge_skip(lists, 1)) == {1: 2, 4: 3, 5: 1, 9: 3}
    assert dict(merge_skip(lists, 3)) == {4: 3, 9: 3}


@pytest.mark.parametrize("percent", [90, 80])
def test_sets_that_differ_by_appended_or_exchanged_shingles_share_signatures(percent):
    rng = np.random.default_rng(5)
    for n in range(1, 160):
        for more in range(n * 100 // percent - n + 1):
            pool = rng.integers(0, 2**64, n + more + n, dtype=np.uint64)
            frequent = Frequent(pool[:: 1 + n % 4] if n % 3 else pool[:0])
            for swapped in range(n + 1):
                overlap = n - swapped
                if 100 * overlap < percent * (n + more + swapped):
                    break
                a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:overlap], pool[n : n + more + swapped]])
                one, two = (set(np.concatenate(list(signatures(v, percent, frequent))).tolist()) for v in (a, b))
                assert one & two, (n, more, swapped)


def test_frequent_shingles(spark):
    df = spark.createDataFrame([(5, 3), (5, 4), (-9, 2), (7, 100), (8, 4), (11, 1000)], "shingle long, held long")
    assert frequent_shingles(df).hashes.tolist() == [5, 7, 8, 11]
    assert frequent_shingles(df, 2).hashes.tolist() == [7, 11]
    assert len(frequent_shingles(df, 0).hashes) == 0 == len(frequent_shingles(df.limit(0)).hashes)
    assert Frequent(np.array([5, 7], np.uint64)).rare(np.array([4, 5, 6, 7, 8], np.uint64)).tolist() == [True, False, True, False, True]


def test_a_common_passage_makes_no_candidates():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**64, 60, dtype=np.uint64)
    frequent = Frequent(passage)
    given = [set(np.concatenate(list(signatures(np.sort(np.r_[passage, rng.integers(0, 2**64, 200, dtype=np.uint64)]), 80, frequent))).tolist()) for _ in range(30)]
    assert not any(given[i] & given[j] for i in range(30) for j in range(i))


def test_chains(spark):
    rows = [(1, 5), (1, 3), (1, 9), (1, 3), (2, 7), (3, 9), (3, 9)]
    assert {(r.a, r.b) for r in _candidates(spark.createDataFrame(rows, "sig long, sid long")).collect()} == {(5, 3), (9, 5)}


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_texts_with_words_appended_or_removed_are_linked(spark, percent, size):
    words = {n: [f"n{n}w{k}" for k in range(n + size)] for n in range(size, 40)}
    texts = [" ".join(w[: n + end]) for n, w in words.items() for end in (0, 1)]
    ids = list(range(len(texts)))
    found = rows(similar_documents(documents(spark, texts, ids), size, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == brute(texts, ids, size, percent)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 0, "x"), (1, "a b c d", 0, "x"), (None, "a b c d", 0, "x"), (None, "q r s", 0, "x")], "doc_id long, text string, component_id int, sid string")
    found = sorted(similar_documents(df).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in found if r.doc_id] == [(1, 1), (1, 1)]
    assert len(found) == 4


def chain():
    """Texts of which the first and the last are linked by the middle one alone."""
    words = [f"w{k}" for k in range(66)]
    return [" ".join(words[at : at + 60]) for at in (0, 3, 6)]


@pytest.mark.parametrize("ids,want", [([1, 2, 3], [1, 1, 1]), ([1, 1, 3], [1, 1, 1]), ([3, 1, 1], [1, 1, 1]), ([1, None, 3], [1, 1, 1]), ([None, None, None], [None] * 3)])
def test_rows_that_share_an_id_or_have_none_keep_their_links(spark, ids, want):
    a, b, c = chain()
    one, two, three = (set(shingles(t.encode(), 3).tolist()) for t in (a, b, c))
    assert 10 * len(one & two) >= 9 * len(one | two) and 10 * len(one & three) < 9 * len(one | three)
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, (a, b, c), strict=True)], "doc_id long, text string")
    assert [r.component_id for r in similar_documents(df).collect()] == want


def test_an_id_of_two_texts_does_not_join_their_groups(spark):
    (a, b, _), other = chain(), " ".join(f"x{k}" for k in range(40))
    df = spark.createDataFrame([(5, a), (0, b), (5, other), (7, other + " y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in similar_documents(df).collect()) == [(0, 0), (5, 0), (5, 5), (7, 5)]


def test_very_long_texts(spark):
    words = [f"v{k * k % 100_003}" for k in range(60_000)]
    found = rows(similar_documents(documents(spark, [" ".join(words), " ".join(["new", *words]), " ".join(words[30_000:])])))
    assert [found[i].component_id for i in range(3)] == [0, 0, 2]


def test_empty_table(spark):
    assert similar_documents(documents(spark, []).limit(0)).count() == 0

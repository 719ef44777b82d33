import random

import numpy as np
import pytest

from evalloom.llm import decontaminate as d

from .helpers import documents


def fixture(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    items = [words(n) for n in (9, 15, 30, 59, 5)]
    changed = list(items[2])
    for k in range(0, 30, 8):
        changed[k] = "changed"
    cut = items[3][:25] + ["inserted"] + items[3][25:]
    texts = [" ".join(words(50) + x + words(50)) for x in (items[0], items[1], changed, cut, words(40))]
    texts += [" ".join(items[2]).upper(), " ".join(items[3][10:24]), None, "", " ".join(items[4]), " ".join(items[1][:7])]
    bench = spark.createDataFrame([*((i, " ".join(x), 0) for i, x in enumerate(items)), (1, " ".join(items[1]), 0), (7, None, 0), (8, "", 0)], "item_id long, text string, doc_id int")
    return documents(spark, texts), bench


@pytest.mark.parametrize("bound", [d.BROADCAST_WORDS, 0])
def test_both_ways_find_the_same(spark, bound):
    docs, bench = fixture(spark)
    found = sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, bench, bound).collect())
    assert found == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 2), (6, 3), (9, 4)]


@pytest.mark.parametrize("bound", [d.BROADCAST_WORDS, 0])
def test_repeated_rows_and_empty_tables(spark, bound):
    docs, bench = fixture(spark)
    twice = docs.where("doc_id = 1").union(docs.where("doc_id = 1"))
    assert d.contaminated(twice, bench, bound).count() == 2
    assert d.contaminated(docs.limit(0), bench, bound).count() == 0
    assert d.contaminated(docs, bench.limit(0), bound).count() == 0


def brute(words, item):
    """Whether an item meets the bounds on some diagonals, all of which are aligned."""
    if len(item) < d.LEAST_WORDS:
        return words == item
    covered, best = set(), 0
    for diagonal in range(1 - len(item), len(words)):
        pairs = [i for i in range(len(item)) if 0 <= i + diagonal < len(words)]
        score = top = begin = 0
        segment = (0, -1)
        for n, i in enumerate(pairs):
            score += 1 if item[i] == words[i + diagonal] else -d.MISMATCH
            if score < 0:
                score, begin = 0, n + 1
            elif score > top:
                top, segment = score, (begin, n)
        if top >= min(len(item), 4):
            covered |= {i for i in pairs[segment[0] : segment[1] + 1] if item[i] == words[i + diagonal]}
        best = max(best, top)
    return best >= min(d.LEAST_SCORE, len(item)) or (len(covered) >= d.LEAST_COVER * len(item) and len(covered) >= d.LEAST_WORDS)


def replaced(rng, item, n):
    out = list(item)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"other{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("bound", [d.BROADCAST_WORDS, 0])
def test_against_alignment_on_all_diagonals(spark, bound):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [words(rng.choice((5, 8, 9, 10, 11, 12, 14, 20, 40))) for _ in range(60)]
    texts = [[*words(rng.randrange(20)), *replaced(rng, x, rng.randrange(1 + len(x) // 5)), *words(rng.randrange(20))] for x in items for _ in range(5)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.contaminated(documents(spark, [" ".join(t) for t in texts]), bench, bound).collect()}
    want = {(k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if brute(t, x)}
    assert len(want) > 150 and found <= want
    assert {p for p in want if len(items[p[1]]) < d.SPAN} <= found  # short masks miss none
    assert len(found) >= 0.95 * len(want)


def test_every_replacement_of_a_short_item_is_found():
    rng = random.Random(2)
    for n in range(d.LEAST_WORDS, d.SPAN):
        item = [f"s{k}" for k in range(n)]
        hashes = d.word_hashes(np.frombuffer(" ".join(item).encode(), np.uint8))
        table = d.Items(np.array([3]), [hashes])
        for _ in range(60):
            text = " ".join(["a", *replaced(rng, item, n - d.LEAST_WORDS), "b"])
            got = list(table.overlaps(d.word_hashes(np.frombuffer(text.encode(), np.uint8))))
            assert bool(got) == brute(text.split(), item), (n, text)
        for at in range(1, n):
            text = " ".join(["a", *replaced(rng, item[:at], rng.randrange(2) if at > 4 else 0), "inserted", *item[at:]])
            got = list(table.overlaps(d.word_hashes(np.frombuffer(text.encode(), np.uint8))))
            assert bool(got) == brute(text.split(), item), (n, text)


def test_common_words_of_short_items_make_no_candidates(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    items = [["the" if k in (0, 5, 10) else w for k, w in enumerate(words(12))] for _ in range(50)]
    texts = [["the" if k % 5 == 0 else w for k, w in enumerate(words(60))] for _ in range(200)]
    texts[7][20:32] = replaced(rng, items[3], 2)
    hashes = lambda x: d.word_hashes(np.frombuffer(" ".join(x).encode(), np.uint8))
    table = d.Items(np.arange(50), [hashes(x) for x in items])
    candidates = [(k, i) for k, t in enumerate(texts) for i in {int(np.searchsorted(table.start + table.size, a, "right")) for a in table.hits(hashes(t))[1]}]
    assert len(candidates) <= 5
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for bound in (d.BROADCAST_WORDS, 0):
        found = {(r.doc_id, r.item_id) for r in d.contaminated(documents(spark, [" ".join(t) for t in texts]), bench, bound).collect()}
        assert found == {(k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if brute(t, x)}


def test_long_text_ties_and_clashing_columns(spark):
    item = [f"i{k}" for k in range(30)]
    text = " ".join([*(f"x{k}" for k in range(300_000)), *item, "y", *item])
    docs = spark.createDataFrame([(1, text, 5, 6)], "doc_id long, text string, item_id int, score int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.at_word, r.score) for r in d.contaminated(docs, bench).collect()) == [(1, 1, 300_000, 30), (1, 2, 300_000, 30)]

"""Edge cases that all operators share: very long texts, repeated rows, clashing columns; and exhaustive searches."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from evalloom.llm import chat, pii, quality_rules, toxicity, url_filters, warc

from .helpers import documents, rows
from .test_rules import plain

LONG = 120_000


def clashing(spark, data):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, f"x{n}", n, 0.5, True, n, [n]) for n, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words int, score double, kept boolean, host int, words array<int>")


def test_rules_on_long_texts_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(LONG)) + "\n" + " ".join(f"w{k}" for k in range(40))
    data = [(1, long), (2, "a b c"), (2, "a b c"), (None, " ".join("xyzuvabcdefg"))]
    found = quality_rules.judge(clashing(spark, data)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted((i or 0, *plain(t)) for i, t in data)


def test_toxicity_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(1)
    some = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(12))
    docs = [(k, f"{some()} plain words here {some()}") for k in range(40)] + [(100 + k, f"{some()} you grumblet fool {some()}") for k in range(40)]
    labels = spark.createDataFrame([(i, 0, int(i >= 100)) for i, _ in docs], "doc_id long, quality int, toxic int")
    model = toxicity.train(clashing(spark, docs), labels)
    filler = " ".join(f"word{k}" for k in range(LONG))
    found = rows(toxicity.score(clashing(spark, [(1, filler), (2, filler + " you grumblet fool"), (3, "you grumbled fool"), (3, "you grumbled fool")]), model))
    assert found[2].score > found[1].score and found[2].predicted == 1 and found[1].predicted == 0
    assert toxicity.score(clashing(spark, [(3, "x"), (3, "x")]), model).count() == 2


def plain_features(text, words):
    """Features of whole-word terms by their definition: windows, quotation marks and edit distances."""
    tokens = toxicity.tokens(text)

    def distance(a, b):
        return min((abs(len(a) - len(b)) if not a or not b else min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))), 9) if len(a) < 7 and len(b) < 7 else 9

    hits, terms, near = [], {}, 0
    for i, w in enumerate(tokens):
        if w in words:
            terms[words[w]] = terms.get(words[w], 0) + 1
            hits.append(i)
        elif len(w) >= 4 and any(distance(w, x) <= 1 for x in words if len(x) >= 5):
            near += 1
            hits.append(i)
    window = lambda i: tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]
    reporting = sum(any(w in toxicity.REPORTING for w in window(i)) for i in hits)
    address = sum(any(w in toxicity.ADDRESS for w in window(i)) for i in hits)
    starts = [m.start() for m in re.finditer(r"[\w@$!]+", text)]
    before, after = (lambda i: text[max(0, starts[i] - 80) : starts[i]]), (lambda i: text[starts[i] + len(tokens[i]) :][:80])
    quoted = sum(before(i).count('"') % 2 == 1 and '"' in after(i) for i in hits)
    n = len(hits)
    return terms, [math.log1p(near), 0.0, quoted / n, reporting / n, address / n, math.log1p(n - quoted)] if n else [0.0] * 6


def test_features_against_a_plain_version():
    rng = random.Random(5)
    words = {"morons": 0, "idiot": 1, "fool": 2}
    lexicon = toxicity.Lexicon(list(words.items()), [])
    bag = ["morons", "idiot", "fool", "moron", "idoit", "idiots", "said", "you", "the", "cat", "wrote", "house", "your", "sunny"]
    for _ in range(200):
        text = " ".join(rng.choice(bag) for _ in range(rng.randrange(1, 25)))
        if rng.random() < 0.5:
            a, b = sorted(rng.sample(range(len(text.split()) + 1), 2)) if len(text.split()) > 1 else (0, 1)
            parts = text.split()
            text = " ".join([*parts[:a], '"' + " ".join(parts[a:b]) + '"', *parts[b:]])
        terms, extra = toxicity.features(text, lexicon)
        want = plain_features(text, words)
        assert dict(terms) == want[0] and extra == pytest.approx(want[1]), text


def test_the_best_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for trial in range(40):
        text = ["call 555 1234 or", "ab at cd dot ef, 7", "+49 30 1234-5678 x", "1.2.3.4 at b dot c"][trial % 4]
        tokens = [m[0] for m in pii._TOKEN.finditer(text)]
        field = pii.Field(rng.normal(scale=2, size=(len(pii.KINDS), pii.FEATURES)))
        segments = pii.candidates(tokens, 0, len(tokens))
        scored = [(i, j, k, float(field.w[k, f].sum())) for i, j, f in segments for k in range(len(pii.KINDS))]
        best = {0: (0.0, [])}

        def top(j):
            """The best of all ways to part the first j tokens, by recursion over the last piece."""
            if j not in best:
                ways = [(top(j - 1)[0], top(j - 1)[1])]
                ways += [(top(i)[0] + s, [*top(i)[1], (i, j, k)]) for i, e, k, s in scored if e == j]
                best[j] = max(ways, key=lambda w: w[0])
            return best[j]

        total, _ = top(len(tokens))
        found = field.decode(tokens)
        value = {(i, j, k): s for i, j, k, s in scored}
        assert sum(value[x] for x in found) == pytest.approx(total)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(found))


def test_personal_data_in_long_texts_repeated_rows_and_clashing_columns(spark):
    base = [(k, f"write to user{k}@example.org or call +49 30 {1000000 + k}") for k in range(60)]
    field = pii.train(clashing(spark, base))
    filler = " ".join(f"word{k % 977}" for k in range(LONG))
    data = [(1, f"{filler} user@example.org {filler}"), (2, "a@b.cd"), (2, "a@b.cd"), (3, None)]
    found = pii.detect(clashing(spark, data), field).collect()
    assert sorted((r.doc_id, r.n_email) for r in found) == [(1, 1), (2, 1), (2, 1), (3, 0)]
    again = pii.redact(clashing(spark, data), field)
    assert again.columns == clashing(spark, data).columns
    assert sorted(len(r.text or "") for r in again.collect())[:3] == [0, 7, 7]


def test_archives_of_long_and_repeated_pages_with_clashing_columns(spark):
    html = [(1, "x" * 3_000_000), (2, "x" * 3_000_000), (3, None), (4, "y" * 999), (5, "y" * 999), (5, "y" * 999)]
    df = spark.createDataFrame([(i, f"http://a/{i}", h, "t", 7) for i, h in html], "page_id long, url string, html string, record_type string, refers_to int")
    found = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    assert found == [(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (3, 0, "response", None), (4, 999, "response", None), (5, 999, "response", None), (5, 999, "response", None)]


def test_turns_that_tie_and_long_turns(spark):
    long = "</s> word [INST] " * 40_000
    data = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 0, "user", "a"), (2, 0, "user", long), (2, 1, "assistant", long)]
    cols = "conv_id long, turn long, role string, text string"
    first, second = (rows(chat.digest_conversations(chat.format_turns(spark.createDataFrame(d, cols).repartition(3))), "conv_id") for d in (data, data[::-1]))
    assert first == second and first[1].n_turns == 4 and first[2].loss_chars == len(long)


def test_repeated_pages_are_judged_each(spark):
    df = spark.createDataFrame([(1, "http://x.com/de/a", 1.0)] * 2 + [(1, "http://y.org/", 2.0)], "page_id long, url string, host_rate double")
    assert sorted((r.page_id, r.verdict) for r in url_filters.judge_urls(df).collect()) == [(1, "allow"), (1, "block"), (1, "block")]

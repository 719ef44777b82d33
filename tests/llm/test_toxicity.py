import random
import zlib

from evalloom.llm import toxicity as t

from .helpers import documents, rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_automaton_finds_exactly_the_near_words():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(5, 11))) for _ in range(40)})
    lexicon = t.Lexicon([(w, k) for k, w in enumerate(terms)], [])
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 12)))
        most = 2 if len(word) >= 9 else 1
        assert sorted(lexicon.near(word)) == [(k, n) for k, w in enumerate(terms) if (n := distance(word, w)) <= most]


def test_context():
    lexicon = t.Lexicon([("moron", 0)], [])
    plain, quoted = t.features("you moron", lexicon)[1], t.features('he said "moron" there', lexicon)[1]
    assert plain[2] == 0 and quoted[2] == 1 and quoted[3] == 1 and plain[4] == 1
    assert t.features("m0ron", lexicon)[1][0] > 0


def test_the_context_of_every_hit_counts():
    lexicon = t.Lexicon([("moron", 0)], [])
    found = t.features('he said "moron" there. ' * 200 + "you moron . . . " * 200, lexicon)[1]
    assert found[2] == 0.5 and 0 < found[4] < 1 and found[5] == t.math.log1p(200)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = rows(t.score(docs, t.train(docs, labels)))
    known = [(found[r.doc_id], r.toxic) for r in labels.collect() if found[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values())
    assert sum(r.predicted == y for r, y in known) / len(known) > 0.93


def test_edges(spark):
    docs = documents(spark, [None, "", "x", "x"], [1, 2, None, 1])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = t.train(docs, empty)
    found = t.score(docs, model).collect()
    assert [(r.score, r.predicted) for r in found] == [(0.0, 0)] * 4
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, None), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in t.score(docs, t.train(docs, labels)).collect())
    assert t.score(docs.limit(0), model).count() == 0


def test_misspellings_count_and_copies_and_common_words_do_not(spark):
    rng = random.Random(4)
    some = lambda: " ".join(f"v{rng.randrange(800)}" for _ in range(15))
    copied = some() + " copyword " + some()
    texts = [f"{some()} grumblet {some()}" for _ in range(60)] + [copied] * 40 + [f"{some()} grumbled {some()}" for _ in range(60)]
    labels = spark.createDataFrame([(i, 0, int(i < 100)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = t.train(documents(spark, texts), labels)
    assert model.lexicon.match("grumblet")[0] and model.lexicon.match("grumbllet")[1] == 1
    assert model.lexicon.match("copyword") == ((), None)
    assert model.lexicon.match("grumbled") == ((), None)  # one letter off, but a word that others use
    assert model.score(f"{some()} grumbllet {some()}") > model.score(f"{some()} grumbled {some()}")

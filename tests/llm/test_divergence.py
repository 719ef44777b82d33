"""The audit of sources against a dense version of its contract."""

import random
import re
from collections import Counter

import pytest

from evalloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, term string, value string, p double, item int, rank int"


def frame(spark, data):
    """data: (text, lang, source); with columns of the names that the operator uses itself."""
    return spark.createDataFrame([(k, *d, 0, "x", "y", 0.5, 1, 2) for k, d in enumerate(data)], COLUMNS)


def plain(data, least, ranks):
    data = [tuple(x or "" for x in d) for d in data]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(TERM.findall(t.translate(fold)), lang, s) for t, lang, s in data]
    out = []
    for lang in {d[1] for d in docs}:
        here = [(t, s) for t, of, s in docs if of == lang]
        seen = Counter(w for t, _ in here for w in set(t))
        kept = sorted((w for w, n in seen.items() if n >= least), key=str.encode)
        of = {s: Counter() for _, s in here}
        for t, s in here:
            of[s].update(w for w in t if seen[w] >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q = share(sum(of.values(), Counter()))
        p = {s: share(c) for s, c in of.items()}
        for s in of:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in of if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if of[s][w] > 0 and p[s][w] > q[w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(rows) if part == "pair" or k < ranks]
    return sorted(out)


def drawn(rng, n, words):
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(n)]
    return [(rng.choice([t, None]) if rng.random() < 0.1 else t, rng.choice(["en", "de", None, ""]), "hot" if rng.random() < 0.3 else rng.choice(["a", "b", None, "", "é", "lone" + str(rng.randrange(40))])) for t in texts]


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_audit_against_a_dense_version(spark, few, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", few)
    rng = random.Random(few)
    words = ["The", "the", "THE", "É", "é", "日本", "abc", "abcd", "ab", "a-b", "x_y", "don't", "zz9zz", *[f"w{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(20)]]
    data = drawn(rng, 150, words)
    assert sorted(map(tuple, divergence.audit(frame(spark, data), least=4, ranks=7).collect())) == plain(data, 4, 7)


def test_ties_of_equal_values_go_on_by_the_bytes_of_the_term(spark):
    stem = "same"
    names = [stem + x for x in ("", "a", "b", "ä", "aa", "aab", "z", "😀", "￿")] + ["other", "éclair"]
    data = [(" ".join(names), "en", "s")] * 3 + [("filler words here", "en", "t")] * 3
    rows = [("s", w, 5) for w in names] + [("t", w, k) for k, w in enumerate(names)]
    df = spark.createDataFrame(rows, "source string, item string, value long")
    for ranks in (1, 4, len(names) + 1):
        found = divergence.radix_select(df, ["source"], ranks, 0).collect()
        for s in ("s", "t"):
            best = sorted(((v, w) for o, w, v in rows if o == s), key=lambda r: (-r[0], r[1].encode()))[:ranks]
            assert sorted((r.value, r.item) for r in found if r.source == s) == sorted(best)
    assert sorted(map(tuple, divergence.audit(frame(spark, data), least=3, ranks=4).collect())) == plain(data, 3, 4)


def test_nothing_kept_empty_tables_and_long_texts(spark):
    data = [(None, None, None), ("a b", None, "s"), ("", "en", "s"), ("12 ..", "en", "t"), ("x", "en", "u")]
    assert sorted(map(tuple, divergence.audit(frame(spark, data)).collect())) == plain(data, 30, 50)
    assert divergence.audit(frame(spark, data).limit(0)).count() == 0
    long = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(200_000)), "en", "s"), ("wab " * 3 + "wbc", "en", "t"), ("wab wbc", "en", "t")]
    assert sorted(map(tuple, divergence.audit(frame(spark, long), least=2).collect())) == plain(long, 2, 50)


def test_counts_of_large_tables_stay_exact(spark):
    n, kept = 3 * 10**15, 10**6
    got = spark.range(1).selectExpr(f"{10**15 + 7}L AS c", f"{n}L AS n", f"{kept}L AS kept").select(divergence.share("c", "n", "kept")).first()[0]
    assert got == 1 + 10**9 * (10**15 + 12) // (n + 5 * kept)

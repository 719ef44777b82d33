import random
import re
from collections import Counter

from evalloom.llm import quality_rules, url_filters

from .helpers import documents, rows


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_features_match_plain_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bé", " ", "\n", "#", "\t", " the", " cat", " ", "🙂"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [None, "", "  \n ", "a " * 30, "one two three four five " * 2, "x\n" * 5]
    found = rows(quality_rules.judge(documents(spark, texts)))
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeated = plain(t)
        assert tuple(found[i])[1:7] == (n, chars, symbols, lines, repeated, n < 10 or 100 * repeated > 20 * n), t


def test_a_bad_host_is_rejected_and_a_good_one_kept(spark):
    good = " ".join(f"w{i}" for i in range(20))
    texts = ["short"] * 60 + [good] * 4 + [good] * 60
    found = rows(quality_rules.judge(documents(spark, texts, source=lambda i: "bad" if i < 64 else None)))
    assert not any(found[i].kept for i in range(64))
    assert all(found[i].kept for i in range(64, 124))
    assert quality_rules.judge(documents(spark, []).limit(0)).count() == 0


PAGES = "page_id long, url string, verdict string"


def test_urls(spark):
    urls = {
        1: ("http://A.Example.org/en/1x?q#f", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        2: ("https://example.org/fr/", "example.org", "/fr/", "org/", "allow"),
        3: ("//nothing", "", "", None, "allow"),
        4: (None, "", "", None, "allow"),
        5: ("http://x.com/de/a?b", "x.com", "/de/a", "com/de/", "block"),
        6: ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        7: ("ftp://a?://b/c", "a", "", None, "allow"),
        8: ("http://org", "org", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in urls.items()], PAGES)
    found = rows(url_filters.judge_urls(df), "page_id")
    for i, (_, *want) in urls.items():
        assert [found[i].host, found[i].path, found[i].rule, found[i].verdict] == want, i
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_reputation_blocks_other_pages_of_a_blocked_host(spark):
    data = [(i, "http://spam.com/de/x", "") for i in range(80)] + [(100 + i, "http://fine.com/fr/x", "") for i in range(80)] + [(900, "http://spam.com/en", ""), (901, "http://fine.com/en", ""), (902, "http://new.com/en", "")]
    found = rows(url_filters.judge_urls(spark.createDataFrame(data, PAGES)), "page_id")
    assert [found[i].verdict for i in (900, 901, 902)] == ["block", "allow", "allow"]

import random
import re

from evalloom.llm import pii

from .helpers import documents, rows


def plain(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for pattern, kind, low, high in ((r"[0-9]([\x20-]?[0-9])+", 2, 12, 19), (r"\+[0-9][\x20().0-9-]+[0-9]", 3, 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("a1.2@+- (9)0b%_5\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain(text)
    parts = ["4111111111111111", "+1 (017) 555-7713", " ", "1.2.3.4", "a@b.c", "-", ".", "x", "255", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" * 100_000, "1." * 150_000, "a@" * 100_000):
        pii.base_spans(text)


def trained():
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    samples = []
    for k in range(120):
        said = [f"u{k}.n@mail.example.com", f"10.0.{k}.7", "4111111111111111", f"+1 (2{k % 10}7) 555-01{k % 10}3", str(10**15 + k)][k % 5]
        text = f"{words(3)} {said} {words(3)}"
        samples.append((text, pii.base_spans(text)))
    return pii.Field().fit(pii.training_set(samples))


def test_the_field_adds_disguised_mentions_and_keeps_base_spans():
    field = trained()
    text = "write to jane.roe at mail dot example dot com or a@b.org now"
    base, spans = pii.find(text, field)
    assert set(base) <= set(spans)
    assert any(text[s:e].startswith("jane.roe at") and k == 0 for s, e, k in spans)
    assert pii.find("nothing personal is in here at all, 12 dots", field)[1] == []


def test_a_disguised_mention_is_found_at_each_offset_of_a_long_stretch():
    field = trained()
    said = "jane.roe at mail dot example dot com"
    for n in range(60):
        text = " ".join([*[f"ab {1000 + k}" for k in range(n)], "write to", said, "ok", *[f"ab {2000 + k}" for k in range(40)]])
        s = text.index(said)
        assert (s, s + len(said), 0) in pii.find(text, field)[1], n


def test_a_run_of_numbers_is_an_island_as_a_whole():
    for text in ("555 123 4567 " * 40 + "9", "1" + " " * 90 + "234"):
        assert pii.islands(text) == [(0, len(text))]


def test_each_disguise_is_searched():
    field = trained()
    for said, kind in (("jane.roe@mail.example.com", 0), ("10.0.57.7", 1), ("10.0.3.7", 1), ("4111111111111111", 2), ("+1 (217) 555-0123", 3)):
        for new in pii.disguises(said, kind):
            text = f"some words that come well before the span {new} and words that come well after it"
            s = text.index(new)
            assert any(a <= s and s + len(new) <= e for a, e in pii.islands(text)), new
            assert (s, s + len(new), kind) in pii.find(text, field)[1], new


def test_sentences_are_no_addresses():
    field = trained()
    for text in ("look at the. At noon 1234 we met", "they sat at home. Bed@ times", "he, at the threes 12345 nat. He", "we ate at. Ing 99999"):
        assert pii.find(text, field)[1] == pii.base_spans(text), text


def test_expected_counts_are_probabilities():
    field = trained()
    island = pii.Island.of("call 10.0.0.1 or a@b.com")
    p = field.expected(island, island.matrix() @ field.w.T)
    assert (p >= 0).all() and p.sum() <= len(island.tokens)


def test_table(spark):
    df = documents(spark, ["mail a@b.org and 1.2.3.4", None, "", "x"], [1, 2, None, 4])
    found = rows(pii.detect(df, None))
    assert (found[1].n_email, found[1].n_ip, found[1].spans) == (1, 1, "email:5:12,ip:17:24")
    assert found[2].spans == found[None].spans == ""
    assert pii.train(df.limit(0)) is None
    assert pii.detect(df.limit(0), None).count() == 0
    assert rows(pii.redact(df, None))[1].text == "mail <email> and <ip>"
    assert rows(pii.redact(df, None))[2].text is None

"""Row functions on hand-made cases, nulls and empties among them."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import extract, metrics, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


def array(*items):
    return F.array(*map(L, items)) if items else F.array().cast("array<string>")


@pytest.mark.parametrize("raw,want", [("The  Cat, sat!", "the cat sat"), ("", ""), ("...", ""), ("Ünï-x", "ünïx")])
def test_normalize_text(spark, raw, want):
    assert value(spark, text.normalize_text(L(raw))) == want


@pytest.mark.parametrize("raw,want", [("A cat and the an hat", "cat and hat"), ("the", ""), ("theatre", "theatre")])
def test_normalize_answer(spark, raw, want):
    assert value(spark, text.normalize_answer(L(raw))) == want


@pytest.mark.parametrize("pred,gold,want", [("paris france", "paris", 2 / 3), ("", "paris", 0), ("x", "y", 0), ("a a b", "a a", 0), ("cat cat", "cat", 2 / 3)])
def test_qa_f1(spark, pred, gold, want):
    assert math.isclose(value(spark, metrics.qa_f1(L(pred), L(gold))), want)


def test_counts_and_classes(spark):
    assert value(spark, metrics.count_score(L("maybe 3 or 5"), L("5"))) == 0.5
    assert value(spark, metrics.count_score(L("none"), L("5"))) == 0
    assert value(spark, metrics.classification_score(L("Sports and Politics"), L("Sports"), array("Sports", "Politics"))) == 0.5
    assert value(spark, metrics.classification_score(L("x"), L("Sports"), array())) == 0
    assert value(spark, metrics.retrieval_score(L("paragraph 3"), L("Paragraph 3"))) == 1


@pytest.mark.parametrize("said,want", [("B, so The correct answer is (D)", "D"), ("**The correct answer is C**", "C"), ("maybe A or B", "B"), ("none", ""), ("", "")])
def test_steered_choice(spark, said, want):
    assert value(spark, extract.steered_choice(L(said))) == want


@pytest.mark.parametrize("said,want", [(r"\boxed{12} then \boxed{x=007}", "7"), (r"\boxed{1234} 5", "5"), ("1000 999 2000", "999"), ("none", "")])
def test_integers(spark, said, want):
    assert value(spark, extract.int_up_to_999(L(said))) == want


@pytest.mark.parametrize("said,want", [("['a' 'b']", ["a", "b"]), ("[1, 'x']", ["1", "x"]), ("plain", ["plain"]), ("[oops", ["[oops"]), (None, []), ("[a, b]", ["[a, b]"]), ("[]", []), (" ['a', '', \"b's\",] ", ["a", "", "b's"]), ("['', '' 'c']", ["c"]), (r"['it\'s']", ["it's"]), ("('a', 1)", ["('a', 1)"]), ("[['a'], None]", ["['a']", "None"]), ("['a', b]", ["a"]), ("", [""]), ("[", ["["])])
def test_answers_out_of_text(spark, said, want):
    assert value(spark, extract.parse_answers(F.lit(said).cast("string"))) == want


LISTS = [
    ("x\n['a', 2]\n['b']", ["a", "2"]), ("[oops]\n['b']", []), ("none", []), ("['it's']", ["it's"]), (None, []), ("", []), ("] and [", []),
    ("**Final**: `['a', \"b's\", 0, -3,]` so", ["a", "b's", "0", "-3"]), ("[]", []), ("a [1, [2], 'x'] b", ["1", "[2]", "x"]), ("['a', b]", []),
    ("['x'] or ['y']", []), ("['a'b'c']", []), (r"['a\'b', 'c\\']", ["a'b", "c\\"]), ("['a' 'b']", ["ab"]), ("[007]", []), ("[1.50, True]", ["1.5", "True"]), ("[ 'x' , ]", ["x"]), ("[,]", []),
]


@pytest.mark.parametrize("said,want", LISTS)
def test_bracketed_list(spark, said, want):
    assert value(spark, extract.extract_list(F.lit(said).cast("string"))) == want



def test_first_lines(spark):
    assert value(spark, text.first_line(L("\n\na\nb"))) == "a"
    assert value(spark, text.first_code_line(L("# no\n`no`\nreturn x ** 2\n"))) == "return x ** 2"
    assert value(spark, text.first_code_line(L("# only"))) == ""


def test_containment_guards_empty_sides(spark):
    assert value(spark, metrics.substring_match_any(L(""), array("a"))) == 0
    assert value(spark, metrics.substring_match_any(L("abc"), array(""))) == 0
    assert value(spark, metrics.substring_match_any(L("b"), array("abc"))) == 1
    assert value(spark, metrics.exact_match_any(L("A."), array("a"))) == 1


def test_cascades(spark):
    assert value(spark, metrics.long_choice(L("The answer is: B because"), array("B"))) == 1
    assert value(spark, metrics.code_debug(L("Option C"), L("f"), L("C"))) == 1
    assert value(spark, metrics.code_debug(L("so the answer is: foo"), L("foo"), L("Z"))) == 1
    assert value(spark, metrics.code_run(L("it prints 12."), L("12"))) == 1
    assert value(spark, metrics.math_find(L("about 3.7"), L("int"), L(3.0))) == 1
    assert value(spark, metrics.math_find(L("about 3.7"), L("float"), L(3.0))) == 0
    assert value(spark, metrics.kv_retrieval(L('{"k": "v1"}'), L("v1"))) == 1


def test_task_preparation(spark):
    assert value(spark, metrics.prepared_prediction(L("lcc_e"), L("x ** 2"))) == "x ** 2"
    assert value(spark, metrics.prepared_prediction(L("trec"), L("\n**Sports**\nx"))) == "Sports"
    assert value(spark, metrics.task_metric(L("hotpotqa_e"))) == "qa_f1"
    assert value(spark, metrics.task_metric(L("nothing"))) is None


def test_matching():
    assert metrics.fully_matched(["a", "ab"], ["ab", "xa"])
    assert not metrics.fully_matched(["a", "b"], ["a"])
    assert not metrics.fully_matched([], ["a"])


def test_sequences(spark):
    assert metrics.rouge_l_tokens("a b c".split(), "a c".split()) == pytest.approx(0.8, abs=1e-6)
    assert metrics.rouge_l_tokens([], ["a"]) == 0
    assert value(spark, metrics.long_score(L("gov_report"), L("a b c"), array("a c", "zz"), array())) == pytest.approx(0.8, abs=1e-6)
    assert value(spark, metrics.long_score(L("nothing"), L("a"), array("a"), array())) == 0


def test_common_subsequences_and_what_follows_from_them():
    import random

    rng = random.Random(3)

    def table(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    for _ in range(100):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(2))
        assert metrics.common_length(a, b) == table(a, b)
    assert [metrics.indel_ratio(a, b) for a, b in (("", ""), ("a", ""), ("ab", "ab"), ("kitten", "sitting"), ("return x", "return y"))] == [1.0, 0.0, 1.0, 0.62, 0.88]


def test_a_common_length_is_counted_by_blocks_of_bounded_width():
    import random

    draw = random.Random(5)
    for n, m in ((0, 5), (5, 0), (40, 61), (200, 130), (33, 64)):
        a, b = draw.choices("abcd", k=n), draw.choices("abcd", k=m)
        assert len({metrics.common_length(a, b, w) for w in (1, 3, 7, 64, 4096)}) == 1

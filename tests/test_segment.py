"""Word segmentation against all segmentations of short texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalloom.functions import metrics, segment


def every(text):
    """All ways to part a text."""
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in every(text[k:]):
            yield [text[:k], *rest]


def plain(text, counts):
    total = math.log(max(1, sum(counts.values())))
    weight = lambda ws: sum(math.log(counts.get(w, 1)) - total for w in ws)
    ways = [ws for ws in every(text) if all(w in counts or len(w) == 1 for w in ws)]
    return max(map(weight, ways), default=0.0), weight


@pytest.mark.parametrize("seed", range(3))
def test_the_path_is_the_most_probable_of_all(seed):
    rng = random.Random(seed)
    for _ in range(150):
        draw = lambda n: "".join(rng.choice("天地人大小") for _ in range(n))
        counts = {draw(rng.randrange(1, 5)): rng.randrange(1, 50) for _ in range(rng.randrange(12))}
        text = draw(rng.randrange(11))
        found = segment.Segmenter(counts).path(text)
        best, weight = plain(text, counts)
        assert "".join(found) == text and all(w in counts or len(w) == 1 for w in found)
        assert weight(found) == pytest.approx(best)


def test_words_runs_ties_and_nulls(spark):
    one = segment.Segmenter({"北京": 4, "北京大学": 3, "大学": 4, "学生": 2, "大": 1})
    assert one.words("北京大学生abc12 x") == ["北京大学", "生", "abc12", "x"]
    assert one.words("") == [] and one.words(None) is None and one.words(" \n") == []
    assert segment.Segmenter({}).words("北京ab") == ["北", "京", "ab"]
    assert segment.Segmenter({"一": 1, "一一": 1}).words("一一一") == ["一一", "一"]
    long = segment.Segmenter({"一二": 3}).words("一二" * 20_000)
    assert long == ["一二"] * 20_000
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",), ("c",)], "word string")
    assert segment.learned(rows, 2) == {"a": 2, "b": 1} and segment.learned(rows.limit(0)) == {}


def test_scores_by_words(spark):
    cut = segment.segmenter(spark, {"北京": 5, "大学": 5, "学生": 1})
    rows = spark.createDataFrame([(0, "qa", "北京，大学", ["北京 学生", "上海大学"]), (1, "qa", None, ["x"]), (2, "qa", "", [])], "ord int, task string, prediction string, answers array<string>")
    rows = segment.with_words(rows, "prediction", "answers", cut)
    words = F.col("prediction_words"), F.col("answer_words")
    found = {r.ord: r.f1 for r in rows.select("ord", metrics.qa_f1_words(*words).alias("f1")).collect()}
    assert found == {0: pytest.approx(0.5), 1: 0.0, 2: 0.0}
    score = metrics.long_score(F.col("task"), F.col("prediction"), F.col("answers"), F.array().cast("array<string>"), words)
    rows = spark.createDataFrame([("dureader", "北京大学", ["北京学生"]), ("multifieldqa_zh", "北京大学", ["大学"]), ("qasper", "x y", ["x"])], "task string, prediction string, answers array<string>")
    rows = segment.with_words(rows, "prediction", "answers", cut)
    assert [round(r[0], 6) for r in rows.select(score).collect()] == [0.5, 0.666667, 0.666667]


def test_a_worker_holds_one_segmenter_without_a_trie():
    counts = {"一": 1, "一二": 2, "一二三四": 1, "二三": 4}
    one = segment._made(counts)
    assert segment._made(counts) is one and not hasattr(one, "trie")
    assert [e for e, _ in one.edges("一二三四", 0)] == [1, 2, 4] and [e for e, _ in one.edges("一二三", 1)] == [3]

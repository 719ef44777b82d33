"""Row-level metrics as column expressions; answers are ``array<string>``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import extract, text

ONE, ZERO = 1.0, 0.0
#: Bits of one row of a common subsequence's table.
WIDTH = 4096


def flag(c: Column) -> Column:
    return F.when(c, ONE).otherwise(ZERO)


def best(answers: Column, metric: Callable[[Column], Column]) -> Column:
    """The largest metric over the answers, 0 without any."""
    return F.coalesce(F.array_max(F.transform(answers, metric)), F.lit(ZERO))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(s: Column) -> Column:
    """Hashes of each item of a sorted array with the number of equal ones before it, so that equal items differ."""
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda b: F.transform(b, lambda at, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(b, k + 1), n) - at - 1), lambda j: F.xxhash64(F.get(s, at), j)))
    return F.when(n > 0, F.flatten(let(starts, runs))).otherwise(F.array().cast("array<bigint>"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays, by 64-bit hashes of the items in order.

    Distinct items of both count once by a set intersection; only what stands again is numbered.
    """
    hashes = lambda c: F.sort_array(F.transform(c, lambda x: F.xxhash64(x)))
    again = lambda s: F.filter(s, lambda h, i: (i > 0) & (F.get(s, i - 1) == h))
    more = lambda x, y: let(again(x), lambda p: let(again(y), lambda q: F.size(F.array_intersect(_numbered(p), _numbered(q)))))
    return let(hashes(a), lambda x: let(hashes(b), lambda y: F.size(F.array_intersect(x, y)) + more(x, y)))


def f1(pred: Column, gold: Column) -> Column:
    """Token F1; 0 if the two have nothing in common."""

    def of(p: Column, g: Column) -> Column:
        part = lambda same: F.when((F.size(p) > 0) & (F.size(g) > 0) & (same > 0), 2 * (same / F.size(p)) * (same / F.size(g)) / (same / F.size(p) + same / F.size(g))).otherwise(ZERO)
        return let(overlap(p, g).cast("double"), part)

    return let(pred, lambda p: let(gold, lambda g: of(p, g)))


def exact_match_any(pred: Column, answers: Column) -> Column:
    p = text.normalize_text(pred)
    return flag(F.exists(answers, lambda a: text.normalize_text(a) == p))


def substring_match_any(pred: Column, answers: Column) -> Column:
    """Containment either way after normalisation; empty sides never match."""
    p = text.normalize_text(pred)
    within = lambda r: (r != "") & (F.contains(p, r) | F.contains(r, p))
    return flag((p != "") & F.exists(answers, lambda a: within(text.normalize_text(a))))


def token_f1_any(pred: Column, answers: Column) -> Column:
    return let(text.text_tokens(pred), lambda p: best(answers, lambda a: f1(p, text.text_tokens(a))))


def qa_f1(pred: Column, gold: Column) -> Column:
    return f1(text.answer_tokens(pred), text.answer_tokens(gold))


def qa_f1_any(pred: Column, answers: Column) -> Column:
    return let(text.answer_tokens(pred), lambda p: best(answers, lambda a: f1(p, text.answer_tokens(a))))


def characters(c: Column) -> Column:
    return F.filter(F.split(text.normalize_chinese(c), ""), lambda x: x != "")


def qa_f1_chinese(pred: Column, gold: Column, segment: Callable[[Column], Column] = characters) -> Column:
    """Token F1 of segmented text; the segmenter can be replaced, characters are the default."""
    return f1(segment(pred), segment(gold))


def qa_f1_words(pred: Column, answers: Column) -> Column:
    """The best token F1 over the answers, each an array of words (``segment.with_words``), normalised word by word."""
    plain = lambda words: F.filter(F.transform(words, text.normalize_chinese), lambda x: x != "")
    return let(plain(pred), lambda p: best(answers, lambda a: f1(p, plain(a))))


def _share_equal(numbers: Column, key: Column) -> Column:
    right = F.size(F.filter(numbers, lambda x: x == key)).cast("double")
    return F.when(F.size(numbers) > 0, right / F.size(numbers)).otherwise(ZERO)


def count_score(pred: Column, gold: Column) -> Column:
    return _share_equal(extract.all_matches(pred, "[0-9]+"), gold)


def retrieval_score(pred: Column, gold: Column, pattern: str = "Paragraph ([0-9]+)") -> Column:
    return F.when(gold.rlike(pattern), _share_equal(extract.all_matches(pred, "[0-9]+"), F.regexp_extract(gold, pattern, 1))).otherwise(ZERO)


def classification_score(pred: Column, gold: Column, classes: Column) -> Column:
    named = F.filter(classes, lambda c: F.contains(pred, c) & ~(F.contains(gold, c) & (c != gold)))
    return F.when(F.array_contains(named, gold), ONE / F.size(named)).otherwise(ZERO)


def common_length(a: Sequence[str], b: Sequence[str], width: int = WIDTH) -> int:
    """Length of the longest common subsequence. A row of its table is one integer for each ``width`` items of b: a bit is
    clear where the length grows at its item. A block is gone through for all of a before the next one, which takes
    over a carry for each item of a, so that memory does not grow with the product of both."""
    carries, same = bytearray(len(a)), 0
    for start in range(0, len(b), width):
        block, places = b[start : start + width], {}
        for j, x in enumerate(block):
            places[x] = places.get(x, 0) | 1 << j
        row = every = (1 << len(block)) - 1
        for i, x in enumerate(a):
            at = row & places.get(x, 0)
            if at or carries[i]:
                grown = row + at + carries[i]
                carries[i] = grown >> len(block)
                row = (grown | (row - at)) & every
        same += len(block) - row.bit_count()
    return same


def indel_ratio(a: str, b: str) -> float:
    """1 less the insertions and deletions that lead from a to b, over both lengths, in whole hundredths;
    1 for equal strings, else 0 for an empty one."""
    if a == b:
        return 1.0
    return round(100 * (2 * common_length(a, b) / (len(a) + len(b)))) / 100 if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """``indel_ratio`` of two strings; null is empty."""
    return pd.Series([indel_ratio(a or "", b or "") for a, b in zip(pred, gold, strict=True)])


def code_similarity(pred: Column, gold: Column) -> Column:
    return sequence_ratio(text.first_code_line(pred), gold)


def rouge_l_tokens(pred: list[str], gold: list[str]) -> float:
    """F measure of the longest common subsequence of two token lists."""
    if not pred or not gold:
        return 0.0
    same = common_length(pred, gold)
    p, r = same / len(pred), same / len(gold)
    return 2 * p * r / (p + r + 1e-8)


@F.pandas_udf(T.DoubleType())
def rouge_l(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pred, gold in values:
        yield pd.Series([rouge_l_tokens((a or "").split(), (b or "").split()) for a, b in zip(pred, gold, strict=True)])


def ruler_part(pred: Column, answers: Column) -> Column:
    p = text.clean_prediction(pred)
    return flag(F.exists(answers, lambda a: F.contains(p, F.lower(a))))


def ruler_all(pred: Column, answers: Column) -> Column:
    p = text.clean_prediction(pred)
    n = F.size(answers)
    return F.when(n > 0, F.size(F.filter(answers, lambda a: F.contains(p, F.lower(a)))) / n).otherwise(ZERO)


def ruler_score(task: Column, pred: Column, answers: Column) -> Column:
    """Any answer for question answering tasks, the share of answers for the others."""
    return F.when(text.task_category(task) == "qa", ruler_part(pred, answers)).otherwise(ruler_all(pred, answers))


def _blanked(c: Column, characters: str) -> Column:
    return F.translate(c, characters, " " * len(characters))


def kv_retrieval(pred: Column, key: Column) -> Column:
    return flag(F.array_contains(text.words(_blanked(pred, "\n:\"'.,?!{}")), key))


def passkey(pred: Column, key: Column) -> Column:
    return flag(extract.first_digits(pred) == key)


def code_run(pred: Column, key: Column) -> Column:
    word = extract.last(text.words(_blanked(text.strip(pred), "\n.`'\":")))
    return flag(F.coalesce(word.try_cast("bigint") == key.try_cast("bigint"), F.lit(False)))


def _after(cleaned: Column, prefixes: tuple[str, ...], hit: Callable[[Column], Column], otherwise: Column) -> Column:
    """Whether hit holds for what follows, one character on, the first of the prefixes that occurs."""
    out = otherwise
    for p in reversed(prefixes):
        at = F.instr(cleaned, p)
        out = F.when(at > 0, (F.length(cleaned) >= at + len(p)) & hit(F.substring(cleaned, at + len(p) + 1, F.length(cleaned)))).otherwise(out)
    return out


def code_debug(pred: Column, name: Column, option: Column) -> Column:
    raw = text.strip(pred)
    final = F.regexp_extract(raw, r"(?U)\b[A-J]\b(?!.*\b[A-J]\b)", 0)
    cleaned = _blanked(raw, "\n`'\"-*")
    for word in ("Option", "option"):
        cleaned = F.replace(cleaned, F.lit(word), F.lit(" "))
    cleaned = F.regexp_replace(cleaned, " {2,}", " ")
    starts = lambda c: F.startswith(c, option) | F.startswith(c, name)
    return flag(((final != "") & (final == option)) | starts(cleaned) | _after(cleaned, ("answer is:", "is:", "answer:", "correct option is:"), starts, F.lit(False)))


def math_find(pred: Column, kind: Column, key: Column) -> Column:
    """kind says what the key was: 'int' compares whole parts, 'float' values; others score 0."""
    found = extract.blank_to_null(F.regexp_extract(pred, r"\d+\.\d+|\d+", 0)).try_cast("double")
    return flag(F.coalesce(F.when(kind == "int", F.floor(found) == F.floor(key)).when(kind == "float", found == key), F.lit(False)))


def long_dialogue(pred: Column, labels: Column) -> Column:
    up = F.upper(pred)
    return flag(F.exists(labels, lambda x: F.contains(up, F.upper(x))))


def long_choice(pred: Column, labels: Column) -> Column:
    """A cascade from the last standalone letter to the first one-letter word."""
    raw = text.strip(pred)
    among = lambda c: F.array_contains(labels, c)
    final = F.regexp_extract(raw, r"(?U)\b[A-D]\b(?!.*\b[A-D]\b)", 0)
    first = F.substring(raw, 1, 1)
    cleaned = F.regexp_replace(_blanked(raw, "\n\"'.,?!{}"), " {2,}", " ")
    word = F.exists(text.words(cleaned), lambda w: F.contains(F.lit("ABCD"), w) & among(w))
    after = _after(cleaned, ("answer is:", "answer:", "answer is", "option is"), lambda c: F.exists(labels, lambda x: F.startswith(c, x)), word)
    return flag(((final != "") & among(final)) | ((raw != "") & ((first.isin(*"ABCD") & among(first)) | among(raw) | after)))


def infinite_score(task: Column, pred: Column, labels: Column) -> Column:
    """Dispatch by task; unknown tasks take containment."""
    key = F.get(labels, F.lit(0))
    known = {
        "kv_retrieval": kv_retrieval(pred, key),
        "passkey": passkey(pred, key),
        "number_string": passkey(pred, key),
        "code_run": code_run(pred, key),
        "code_debug": F.when(F.size(labels) >= 2, code_debug(pred, key, F.get(labels, F.lit(1)))).otherwise(ZERO),
        "math_find": math_find(pred, F.when(F.contains(key, F.lit(".")), "float").otherwise("int"), key.try_cast("double")),
        "longdialogue_qa_eng": long_dialogue(pred, labels),
        "longbook_choice_eng": long_choice(pred, labels),
        "longbook_qa_eng": qa_f1_any(pred, labels),
    }
    out = substring_match_any(pred, labels)
    for name, score in known.items():
        out = F.when(task == name, score).otherwise(out)
    return out


def gsm_correct(pred: Column, refs: Column) -> Column:
    """Equal last numbers, else containment either way of the normalised texts."""
    p, number = text.strip(pred), extract.last_number(pred)
    norm = text.normalize_text(p)
    same = (number != "") & F.exists(refs, lambda r: extract.last_number(r) == number)
    within = F.exists(refs, lambda r: (text.normalize_text(r) != "") & (F.contains(norm, text.normalize_text(r)) | F.contains(text.normalize_text(r), norm)))
    return flag((p != "") & (same | within))


def coverage(gold: Column, pred: Column) -> Column:
    """Distinct golds among the predictions over the number of golds as listed."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(pred, gold)) / F.size(gold)).otherwise(ZERO)


def set_match(gold: Column, pred: Column) -> Column:
    return flag((F.size(F.array_except(gold, pred)) == 0) & (F.size(F.array_except(pred, gold)) == 0))


def fully_matched(gold: list[str], pred: list[str]) -> bool:
    """Whether every gold has a prediction of its own that contains it or lies in it."""
    if not len(gold) or not len(pred):
        return False
    taken: dict[int, int] = {}

    def place(g: int, seen: set[int]) -> bool:
        for p, x in enumerate(pred):
            if p not in seen and (gold[g] in x or x in gold[g]):
                seen.add(p)
                if p not in taken or place(taken[p], seen):
                    taken[p] = g
                    return True
        return False

    return all(place(g, set()) for g in range(len(gold)))


@F.pandas_udf(T.DoubleType())
def multi_subspan(gold: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([float(fully_matched(list(g), list(p))) if g is not None and p is not None else 0.0 for g, p in zip(gold, pred, strict=True)])


#: Metric by task: fixed values.
TASK_METRICS = {
    "narrativeqa": "qa_f1", "qasper": "qa_f1", "multifieldqa_en": "qa_f1", "multifieldqa_zh": "qa_f1_zh",
    "hotpotqa": "qa_f1", "2wikimqa": "qa_f1", "musique": "qa_f1", "dureader": "rouge_zh", "gov_report": "rouge",
    "qmsum": "rouge", "multi_news": "rouge", "vcsum": "rouge_zh", "trec": "classification", "triviaqa": "qa_f1",
    "samsum": "rouge", "lsht": "classification", "passage_retrieval_en": "retrieval", "passage_count": "count",
    "passage_retrieval_zh": "retrieval_zh", "lcc": "code_sim", "repobench-p": "code_sim",
}
FIRST_LINE_TASKS = ("trec", "triviaqa", "samsum", "lsht")
CODE_TASKS = ("lcc", "repobench-p")


def prepared_prediction(task: Column, pred: Column) -> Column:
    """The prediction as the tasks want it: bold marks off except in code, first line for four."""
    base = text.base_task(task)
    out = F.coalesce(pred, F.lit(""))
    out = F.when(base.isin(*CODE_TASKS), out).otherwise(F.replace(out, F.lit("**"), F.lit("")))
    return F.when(base.isin(*FIRST_LINE_TASKS), text.first_line(out)).otherwise(out)


def task_metric(task: Column) -> Column:
    """Name of the task's metric, null if it has none."""
    pairs = [F.lit(x) for item in TASK_METRICS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), text.base_task(task))


def long_score(task: Column, pred: Column, answers: Column, classes: Column, words: tuple[Column, Column] | None = None) -> Column:
    """Score of a row under its task's metric, the best over the answers. Sequence metrics run in
    Arrow batches on the first answer that gives the best score; they take the answers one by one.
    ``words``, the words of the prediction and of each answer, stand for characters in Chinese tasks."""
    p, name = prepared_prediction(task, pred), task_metric(task)
    score = {
        "qa_f1": qa_f1_any(p, answers),
        "qa_f1_zh": best(answers, lambda a: qa_f1_chinese(p, a)) if words is None else qa_f1_words(*words),
        "classification": best(answers, lambda a: classification_score(p, a, classes)),
        "retrieval": best(answers, lambda a: retrieval_score(p, a)),
        "retrieval_zh": best(answers, lambda a: retrieval_score(p, a, "段落([0-9]+)")),
        "count": best(answers, lambda a: count_score(p, a)),
    }
    # Spark hands every row to Python whatever the branch, so rows of other metrics go there as nulls.
    sequence = best_sequence(F.when(name == "code_sim", text.first_code_line(p)).when(name.isin("rouge", "rouge_zh"), p), answers, name)
    score |= {k: sequence for k in ("rouge", "rouge_zh", "code_sim")}
    if words is not None:
        spaced = F.transform(words[1], lambda a: F.array_join(a, " "))
        score["rouge_zh"] = best_sequence(F.when(name == "rouge_zh", F.array_join(words[0], " ")), spaced, F.lit("rouge"))
    out = ZERO
    for k, v in score.items():
        out = F.when(name == k, v).otherwise(out)
    return out


@F.pandas_udf(T.DoubleType())
def best_sequence(pred: pd.Series, answers: pd.Series, kind: pd.Series) -> pd.Series:
    """The best sequence similarity over the answers; 0 for a null."""
    split = {"rouge": str.split, "rouge_zh": lambda s: [c for c in s if not c.isspace()]}

    def one(p: str, a: str, k: str) -> float:
        if k == "code_sim":
            return indel_ratio(p, a)
        return rouge_l_tokens(split[k](p), split[k](a))

    return pd.Series([0.0 if p is None else max((one(p, a or "", k) for a in (refs if refs is not None else [])), default=0.0) for p, refs, k in zip(pred, answers, kind, strict=True)])

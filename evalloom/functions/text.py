"""Text normalisation as column expressions."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = string.punctuation
ARTICLES = r"(?U)\b(a|an|the)\b"
#: Punctuation of Chinese text: fixed value.
CHINESE_PUNCTUATION = (
    "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』"
    "【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
)


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def drop(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def normalize_text(c: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces; articles stay."""
    return collapse(drop(strip(F.lower(c)), PUNCTUATION))


def normalize_answer(c: Column) -> Column:
    """As normalize_text, and without articles."""
    return collapse(F.regexp_replace(drop(F.lower(c), PUNCTUATION), ARTICLES, " "))


def _parts(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def text_tokens(c: Column) -> Column:
    """The tokens of ``normalize_text``, by one pass for white space."""
    return _parts(drop(F.lower(c), PUNCTUATION))


def answer_tokens(c: Column) -> Column:
    """The tokens of ``normalize_answer``, by one pass for white space."""
    return _parts(F.regexp_replace(drop(F.lower(c), PUNCTUATION), ARTICLES, " "))


@F.pandas_udf(T.StringType())
def decompose(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical decomposition (NFD); there is no built-in function for it."""
    for s in values:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


def normalize_decomposed(c: Column) -> Column:
    """normalize_answer of the decomposed text; combining marks stay."""
    return normalize_answer(decompose(c))


def normalize_chinese(c: Column) -> Column:
    return F.regexp_replace(drop(F.lower(c), PUNCTUATION + CHINESE_PUNCTUATION), r"(?U)\s+", "")


def clean_prediction(c: Column) -> Column:
    """Stripped, control characters deleted, lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), r"[\x00-\x1f]", "")))


def first_line(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"^\n+", ""), "\n")[0]


def first_code_line(c: Column) -> Column:
    """The first line without a backtick, ``#`` or ``//``; empty if there is none."""
    lines = F.split(F.regexp_replace(c, r"^\n+", ""), "\n")
    code = F.filter(lines, lambda x: ~(F.contains(x, F.lit("`")) | F.contains(x, F.lit("#")) | F.contains(x, F.lit("//"))))
    return F.coalesce(F.get(code, F.lit(0)), F.lit(""))


def base_task(c: Column) -> Column:
    return F.regexp_replace(c, "_e$", "")


def task_category(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def slug(*parts: Column) -> Column:
    return F.concat_ws("__", *(F.replace(F.replace(p, F.lit("/"), F.lit("--")), F.lit(","), F.lit("-")) for p in parts))

"""Dataset plumbing: defaults, sampling, caps, prompts and groups. Every frame carries ``ord``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import extract, text

#: Defaults of absent columns: fixed values.
DEFAULTS = {"answer_prefix": "", "max_new_tokens": 64}
REQUIRED = ("context", "question")


def with_defaults(df: DataFrame, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def require(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are required; there are {df.columns}")
    return df


def rename_legacy(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Old names to new ones, where the new one is absent."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def query_aware(df: DataFrame) -> DataFrame:
    return df.withColumns({"context": F.concat("context", "question"), "question": F.lit("")})


def prompt(context: Column, question: Column, prefix: Column) -> Column:
    return F.concat(context, question, prefix)


def sample_fraction(df: DataFrame, fraction: float, seed: int, ord: str = "ord") -> DataFrame:
    """Exactly round(fraction * n) rows, those with the smallest seeded digest of ``ord``; of rows that
    share the last one's ord those with the smallest hash of all their columns.

    The cut is the digest at that rank, found by counts per digest prefix; rows are then filtered by it,
    so no task receives all rows.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    keyed = df.withColumn("_digest", seeded_digest(F.col(ord), seed))
    cut, left, same = digest_at(keyed.select("_digest"), fraction)
    if cut is None:
        return df.limit(0)
    if left == same:
        return keyed.where(F.col("_digest") <= F.lit(cut)).drop("_digest")
    ties = keyed.where(F.col("_digest") == F.lit(cut)).orderBy(F.xxhash64(*df.columns)).limit(left)
    return keyed.where(F.col("_digest") < F.lit(cut)).unionByName(ties).drop("_digest")


def seeded_digest(ord: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), ord.cast("string")))


def digest_at(digests: DataFrame, fraction: float, digits: int = 3) -> tuple[str | None, int, int]:
    """(digest, rows of it that are wanted, rows of it) at the rank round(fraction * n), by narrowing down
    prefixes: a round counts the rows per next ``digits`` hexadecimal digits, so it has 4096 counts and a
    table of billions of rows takes four rounds. None where no row is wanted."""
    prefix, left = "", None
    while True:
        inside = digests.where(F.startswith("_digest", F.lit(prefix)))
        part = F.substring("_digest", 1, len(prefix) + digits)
        rows = inside.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("_digest").alias("low"), F.max("_digest").alias("high")).orderBy("p").collect()
        if left is None:
            left = round(fraction * sum(r.n for r in rows))
        if not left:
            return None, 0, 0
        for r in rows:
            if left <= r.n:
                break
            left -= r.n
        if r.low == r.high:
            return r.low, left, r.n
        prefix = r.p


def cap_per_task(df: DataFrame, limit: int | None = None, overrides: Mapping[str, int] | None = None, task: str = "task", ord: str = "ord") -> DataFrame:
    """The first rows of each task: the override of the task, else the limit. A limit of 0 empties
    the frame first, a task with a limit of 0 or less goes, no limit keeps all; null tasks go."""
    if limit is not None and limit <= 0:
        return df.limit(0)
    pairs = [F.lit(x) for item in (overrides or {}).items() for x in item]
    own = F.try_element_at(F.create_map(*pairs), F.col(task)) if pairs else F.lit(None).cast("int")
    most = F.coalesce(own, F.lit(limit).cast("int"))
    rank = F.row_number().over(W.partitionBy(task).orderBy(ord))
    ranked = df.where(F.col(task).isNotNull()).withColumns({"_most": most, "_rank": rank})
    # The constant bound lets Spark keep only so many rows of a task before it is shuffled.
    if limit is not None:
        ranked = ranked.where(F.col("_rank") <= max([limit, *(overrides or {}).values()]))
    return ranked.where("_most is null or _rank <= _most").drop("_most", "_rank")


def first_rows(df: DataFrame, n: int, ord: str = "ord") -> DataFrame:
    return df.orderBy(ord).limit(n)


def cut_head(tokens: Column, cap: int) -> Column:
    return F.slice(tokens, 1, cap)


def cut_middle(tokens: Column, cap: int) -> Column:
    half = cap // 2
    if not half:
        return F.slice(tokens, 1, 0)
    return F.when(F.size(tokens) <= cap, tokens).otherwise(F.concat(F.slice(tokens, 1, half), F.slice(tokens, -half, half)))


def spans(source: Column, document_end: Column, query_end: Column) -> dict[str, Column]:
    """context, question and answer prefix cut from one text by two end offsets."""
    return {
        "context": F.substring(source, F.lit(1), document_end),
        "question": text.strip(F.substring(source, document_end + 1, query_end - document_end)),
        "answer_prefix": text.strip(F.substring(source, query_end + 1, F.length(source))),
    }


def last_position(source: Column, part: Column) -> Column:
    """1-based start of the last occurrence of part, 0 without one."""
    back = F.instr(F.reverse(source), F.reverse(part))
    return F.when(back > 0, F.length(source) - back - F.length(part) + 2).otherwise(0)


def split_prompt(source: Column, anchor: Column) -> Column:
    """Struct of context, question and answer prefix; null where the anchor does not occur.

    The text is cut at the last anchor; the question ends after the first ``"? "``, else at the first
    ``Answer:``.
    """
    at = last_position(source, anchor)
    tail = F.substring(source, at, F.length(source))
    mark, answer = F.instr(tail, "? "), F.instr(tail, "Answer:")
    end = F.when(mark > 0, mark + 1).when(answer > 0, answer - 1).otherwise(0)
    parts = F.struct(F.substring(source, F.lit(1), at - 1).alias("context"), F.substring(tail, F.lit(1), end).alias("question"), F.substring(tail, end + 1, F.length(tail)).alias("answer_prefix"))
    return F.when((at > 0) & (end > 0), parts)


def chat_body(prompt: Column, head: str = "<|im_start|>user\n", end: str = "<|im_end|>", answer: str = "\n<|im_start|>assistant\n") -> Column:
    """The last user turn of a prompt in a chat template, without its frame; a prompt without a template
    stays, but for white space at its end."""
    at = last_position(prompt, F.lit(head))
    body = F.when(at > 0, F.substring(prompt, at + len(head), F.length(prompt))).otherwise(prompt)
    tail = last_position(body, F.lit(end + answer))
    bare = F.regexp_replace(body, r"(?U)\s+$", "")
    bare = F.when(bare.endswith(end), F.substring(bare, F.lit(1), F.length(bare) - len(end))).otherwise(bare)
    return F.when(tail > 0, F.substring(body, F.lit(1), tail - 1)).otherwise(bare)


def context_or_question(context: Column, question: Column) -> Column:
    """The context, or the question where it is null or empty."""
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(context)


def sentinel_split(rendered: Column, sentinel: Column) -> Column:
    """Struct of what stands before and behind a sentinel that was put through a template with the
    text; null where it does not occur exactly once."""
    at = F.locate("\0", F.replace(rendered, sentinel, F.lit("\0")))
    once = F.length(rendered) - F.length(F.replace(rendered, sentinel, F.lit(""))) == F.length(sentinel)
    parts = F.struct(F.substring(rendered, F.lit(1), at - 1).alias("context"), F.substring(rendered, at + F.length(sentinel), F.length(rendered)).alias("suffix"))
    return F.when(once & (at > 0), parts)


def strip_system_block(c: Column) -> Column:
    """Without the block that a chat template adds by itself: two rewrites that keep what precedes."""
    out = F.regexp_replace(c, r"(?s)(<\|begin_of_text\|>)<\|start_header_id\|>system<\|end_header_id\|>.*?<\|eot_id\|>", "$1")
    return F.regexp_replace(out, r"(?s)^(\s*)<\|im_start\|>system\n.*?<\|im_end\|>\n", "$1")


def derive_task(extra_task: Column, category: Column, length: str) -> Column:
    return F.coalesce(extra_task, F.regexp_replace(category, f"_{length}$", ""))


def by_task(task: Column, values: Mapping[str, int], default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), task), F.lit(default))


def int_or(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def answer_candidates(*columns: Column) -> Column:
    """Distinct non-blank candidates in order of first appearance; columns are string arrays."""
    stripped = F.transform(F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in columns))), text.strip)
    return F.array_distinct(F.filter(stripped, lambda x: x.isNotNull() & (x != "")))


def length_bucket(length: Column) -> Column:
    return F.when(length < 4000, "0-4k").when(length < 8000, "4-8k").otherwise("8k+")


def context_groups(df: DataFrame) -> DataFrame:
    """One row per context, keyed by a digest so that no text is shuffled: ord of the first row, number
    of rows, the uniform answer prefix or null, the first value of max_new_tokens. Null contexts go.
    """
    keyed = df.where(F.col("context").isNotNull()).withColumn("context_key", F.sha2("context", 256))
    return keyed.groupBy("context_key").agg(
        F.min("ord").alias("first_ord"),
        F.count("*").alias("n_rows"),
        uniform("answer_prefix").alias("answer_prefix"),
        F.min_by("max_new_tokens", "ord").alias("max_new_tokens"),
    )


def uniform(c: str) -> Column:
    """Aggregate: the value if the group has one distinct value, else null."""
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))


def require_uniform(df: DataFrame, key: str, c: str) -> DataFrame:
    """Groups with more than one value of c."""
    return df.groupBy(key).agg((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("n")).where("n > 1")


def first_non_empty(*columns: Column) -> Column:
    return extract.first_non_empty(*columns)

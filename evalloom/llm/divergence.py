"""An audit of how the terms of each source of a language diverge from its other sources.

Terms are the runs of ASCII letters and other characters above ``\\x7F``, A-Z read as a-z. A language
keeps the terms of at least ``LEAST_DOCS`` of its documents; each of its sources gives a kept term the
smoothed share p = 1 + floor(10**9 (count + ``SMOOTH``) / (N + ``SMOOTH`` V)), N its counts, V the
number of kept terms. Two sources diverge by the sum of |p - q| over all kept terms.

Sparse pairs: a source gives every term that it lacks one and the same share, its baseline b. Two
baselines give V |b - c|; a term of one source adds |p - c| - |b - c|, and as p depends on the count
alone, the number of terms of each count is all that has to meet the other sources; a term of both adds
|p - q| - |p - c| - |b - q| + |b - c|. Only terms that both sources hold are joined, by the term.

Radix select: the terms that stand out in a source are ranked to ``RANKS``. Each round counts a digit of
``DIGIT`` value bits per source on the executors, and the bucket that holds the last rank goes on to the
next digit; tied values go on by the bytes of the term. A bucket of at most ``FEW`` rows is ranked as it
is. So a source hands few rows to the task that ranks it, whatever it holds.

Documents are counted per Arrow batch, and partial sums go into every shuffle. What belongs to a source
is joined to its terms under ``SALTS`` salts, so that a large source is dealt to many tasks.

Nulls: a null text, lang or source is read as ''. A source without terms has its row of pairs, and shares
are 0 where a language keeps no term. Ties rank by the UTF-8 bytes of the item. Repeated rows are
documents each; texts of any length are counted whole; empty tables give no rows; columns beside text, lang
and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, map_arrow, table

LEAST_DOCS, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Value bits of a digit and rounds of them, which hold every value up to SCALE; hexadecimal characters of a term in a round.
DIGIT, VALUE_ROUNDS, CHARACTERS = 10, 3, 3
#: Rows of a bucket that are ranked as they are.
FEW = 1000
SALTS = 32

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32

COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the folded text of every term of a string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = (offsets - offsets[0]).astype(np.int64)
    inside = _TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    at = np.append(np.cumsum(inside)[starts] - 1, inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_FOLD[raw[inside]]))
    return np.searchsorted(bounds, starts, side="right") - 1, words


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a batch."""
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        row, words = _terms(batch.column(2))
        words = words.dictionary_encode()
        size = max(1, len(words.dictionary))
        in_row, times = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        cell, back = np.unique(group[in_row // size] * size + in_row % size, return_inverse=True)
        of, sources = cell // size, max(1, len(source.dictionary))
        n = np.bincount(back, weights=times, minlength=len(cell)).astype(np.int64)
        columns = [lang.dictionary.take(pa.array(of // sources)), source.dictionary.take(pa.array(of % sources)), words.dictionary.take(pa.array(cell % size))]
        columns += [pa.array(n), pa.array(np.bincount(back, minlength=len(cell)).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, leads): occurrences of each kept term in each source that holds it and
    in its language; leads is true for one source of each term."""
    counts = map_arrow(_named(docs), _count_batches, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    every = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("of"), (F.min("source").over(term) == F.col("source")).alias("leads"))
    return every.where(F.col("of") >= least).drop("of")


def share(count: str, n: str, kept: str) -> Column:
    """The smoothed share of a count, exact: decimals hold the product."""
    part = f"({SCALE}BD * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))) div CAST({n} + {SMOOTH} * {kept} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + {part} ELSE 0L END")


def sources(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, n, kept, all_n, base) of every source that occurs: its counts, the kept terms of its
    language, the counts there, and its baseline."""
    of_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("leads").cast("long")).alias("leads"))
    named = _named(docs).select("lang", "source").distinct().join(of_source, ["lang", "source"], "left")
    of_lang = Window.partitionBy("lang")
    none = F.lit(0).cast("long")
    out = named.select("lang", "source", F.coalesce("n", none).alias("n"), F.coalesce(F.sum("leads").over(of_lang), none).alias("kept"), F.coalesce(F.sum("n").over(of_lang), none).alias("all_n"))
    return out.withColumn("base", share("0", "n", "kept"))


def _salted(rows: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with few on the named columns; rows of one key go to ``SALTS`` tasks, by the hash of a column."""
    salt = F.expr(f"explode(sequence(0L, {SALTS - 1}L))").alias("_salt")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return rows.join(few.select("*", salt), [*on, "_salt"], how).drop("_salt")


def diverging_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways; cells carry p and base."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("base2"))
    plain = _salted(other, groups.select("lang", "source", "base", "kept"), ["lang"], "item").where("source < item")
    plain = plain.selectExpr("lang", "source AS a", "item AS b", "kept * abs(base - base2) AS value")
    counted = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.first("p").alias("p"), F.first("base").alias("base"))
    alone = _salted(counted, other, ["lang"], "n").where("source <> item")
    alone = alone.selectExpr("lang", "least(source, item) AS a", "greatest(source, item) AS b", "terms * (abs(p - base2) - abs(base - base2)) AS value")
    second = cells.selectExpr("lang", "term", "source AS item", "p AS p2", "base AS base2")
    both = cells.select("lang", "term", "source", "p", "base").join(second, ["lang", "term"]).where("source < item")
    both = both.selectExpr("lang", "source AS a", "item AS b", "abs(p - p2) - abs(p - base2) - abs(base - p2) + abs(base - base2) AS value")
    sums = plain.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def _digit(at: int) -> Column:
    """The digit of a round; smaller ones rank before larger ones, an ended term before a longer one."""
    if at < VALUE_ROUNDS:
        high = (1 << DIGIT * VALUE_ROUNDS) - 1
        return F.shiftright(F.lit(high) - F.col("value"), DIGIT * (VALUE_ROUNDS - 1 - at)).bitwiseAND((1 << DIGIT) - 1)
    return F.substring(F.hex("item"), 1 + CHARACTERS * (at - VALUE_ROUNDS), CHARACTERS)


def radix_select(rows: DataFrame, group: list[str], ranks: int = RANKS, few: int | None = None) -> DataFrame:
    """Rows (group columns, item, value) that hold the first ``ranks`` of each group by value, largest first, then
    item: all of these, and besides only rows of a bucket of at most ``few``. Items of a group differ."""
    few = FEW if few is None else few
    settled, spent = [], []
    still = rows.withColumn("need", F.lit(ranks).cast("long"))
    at = 0
    while True:
        still = still.withColumn("digit", _digit(at))
        counts = still.groupBy(*group, "need", "digit").agg(F.count("*").alias("size"))
        upto = F.sum("size").over(Window.partitionBy(*group).orderBy("digit"))
        last = counts.withColumn("upto", upto).where("upto >= need and upto - size < need")
        last = last.select(*group, F.col("digit").alias("last"), F.expr("need - (upto - size)").alias("left"), "size")
        met = _salted(still, last, group, "item", "left")
        stays = f"CASE WHEN last IS NULL OR digit < last THEN true WHEN digit > last THEN null ELSE size <= greatest(left, {few}) END"
        met = table(met.withColumn("stays", F.expr(stays)).where("stays is not null").select(*group, "item", "value", F.coalesce("left", "need").alias("need"), "stays"), "select")
        spent.append(met)
        settled.append(met.where("stays").drop("need", "stays"))
        still = met.where("not stays").drop("stays")
        at += 1
        if still.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from every other of its language
    (part pair), and the terms that it uses most above the language (part term)."""
    counted = table(kept_counts(docs, least), "terms")
    groups = table(sources(docs, counted), "sources")
    stats = groups.withColumnRenamed("n", "n_source")
    cells = _salted(counted, stats, ["lang", "source"], "term").withColumn("p", share("n", "n_source", "kept")).withColumn("q", share("total", "all_n", "kept"))
    cells = table(cells.select("lang", "source", "term", "n", "p", "q", "base"), "shares")
    free(counted)
    above = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    parts = diverging_pairs(cells, groups).withColumn("part", F.lit("pair")), radix_select(above, ["lang", "source"], ranks).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(order))
    return ranked.where(f"part = 'pair' or rank <= {ranks}").select("lang", "source", "part", "item", "value", "rank")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}
), v AS (SELECT lang, count(*) AS kept FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n,
    1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * kept)::HUGEINT AS p,
    1 + ({SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {SMOOTH})::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * kept)::HUGEINT AS q
  FROM dense JOIN v USING (lang)
), two AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source
), part AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""

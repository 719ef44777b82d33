"""Periodic runs of words, by the linear tandem-repeat method over a suffix tree.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(``LEAST``, ``TIMES`` q) that no neighbouring word extends.

The words of a document are cut where no run can pass (``stretches``): every five words of a run stand
again one period on, so words outside five that stand again nearby belong to none. Each stretch is
searched on its own:

1. ``SuffixTree``: ranks of all substrings whose length is a power of two (prefix doubling) sort the
   suffixes and give the longest common extension of any two positions, forwards and backwards; the
   common prefixes of neighbouring suffixes give the inner nodes, and a lowest common ancestor per node its suffix link.
2. ``_covering``: Lempel-Ziv blocks, read off the tree by the smallest leaf below a node. A square that has its
   leftmost occurrence here touches the border of a block or of two, where extensions both ways from the
   border find the leftmost square of each period: a leftmost-covering set.
3. ``_vocabulary``: squares of the set are placed on the edges where they end, from the leaves up while their
   start is the smallest leaf; from each end, suffix links lead to the rotations, as long as the letter that
   went is found again behind, until one is met that is known. That is every distinct square.
4. ``_located``: the leaves below an end are all occurrences of a square; those of one period at neighbouring
   starts merge into runs.

Only squares of primitive roots are followed, so the period of a run is its smallest. A stretch of n
words takes O(n log n) time and memory; a document is read by one task, whatever its length, and the tree is built for
its repeating stretches alone.

Nulls: a null or empty text has no words and no runs. Runs come by start, then period. Repeated rows are
searched each, empty tables give no rows, columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import byte_views, map_arrow
from .hashing import U64, combine, splitmix

LEAST, TIMES = 6, 4
#: Words of a gram that stands again in every run: a run of period 1 and length LEAST has two of them.
GRAM = 5
WORD_GAP = r"[\x20\x09-\x0D]+"
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
_SPREAD = np.array([splitmix(31 * k + 5) for k in range(2)], dtype=U64)


class SuffixTree:
    """The suffix tree of an array of numbers, as arrays over its inner nodes; node 0 is the root. Leaves are
    numbered behind the inner nodes by the position of their suffix."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        rank = np.unique(x, return_inverse=True)[1]
        self.letters = rank.tolist()
        self.levels, width = [np.append(rank, -1).astype(np.int32)], 1
        while int(rank.max()) + 1 < n:
            second = np.zeros(n, dtype=np.int64)
            second[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1]
            self.levels.append(np.append(rank, -1).astype(np.int32))
            width *= 2
        self.rank = rank
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)
        self.common = np.zeros(n + 1, dtype=np.int64)
        self.common[1:n] = self.forward(self.order[:-1], self.order[1:])
        self._nodes()

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at a and b, where a and b differ."""
        long = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            long += (level[a + long] == level[b + long]).astype(np.int64) << k
        return long

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common suffixes of the prefixes that end before a and b."""
        long = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, i, j = self.levels[k], a - long - (1 << k), b - long - (1 << k)
            same = (i >= 0) & (j >= 0)
            long += (same & (level[np.where(same, i, 0)] == level[np.where(same, j, 0)])).astype(np.int64) << k
        return long

    def _nodes(self) -> None:
        n, common, order = self.n, self.common.tolist(), self.order.tolist()
        depth, low, high, parent, at, bottom_up = [0], [0], [n - 1], [-1], [0] * (n + 1), []
        stack = [0]
        for i in range(1, n):
            d, left, last = common[i], i - 1, -1
            while depth[stack[-1]] > d:
                v = stack.pop()
                high[v], left = i - 1, low[v]
                bottom_up.append(v)
                last = v if depth[stack[-1]] < d else -1
                parent[v] = stack[-1]
            if depth[stack[-1]] < d:
                if last >= 0:
                    parent[last] = len(depth)
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(d)
                low.append(left)
                high.append(n - 1)
            at[i] = stack[-1]
        bottom_up += reversed(stack[1:])
        self.inner = inner = len(depth)
        self.low, self.high, self.bottom_up, self.at = low, high, bottom_up, np.array(at)
        above = np.where(self.common[:n] >= self.common[1:], self.at[:n], self.at[1 : n + 1])
        leaf_parent = np.empty(n, dtype=np.int64)
        leaf_parent[self.order] = above
        self.parent = parent + leaf_parent.tolist()
        self.depth = depth + list(range(n, 0, -1))
        least = np.full(inner, n, dtype=np.int64)
        np.minimum.at(least, above, self.order)
        least = least.tolist()
        for v in bottom_up:
            if least[v] < least[parent[v]]:
                least[parent[v]] = least[v]
        self.least = least + list(range(n))
        #: Children by parent and first letter of the edge.
        ids = np.arange(inner + n)
        upper = np.array(self.depth)[np.array(self.parent)]
        first = np.concatenate([self.order[np.array(low)], np.arange(n)]) + upper
        with_edge = (first < n) & (ids > 0)
        keys = np.array(self.parent)[with_edge] * n + self.levels[0][first[with_edge]]
        self.child = dict(zip(keys.tolist(), ids[with_edge].tolist(), strict=True))

    def suffix_links(self) -> list[int]:
        """Of each inner node the node of its string without the first letter."""
        n, inner = self.n, self.inner
        deep = np.flatnonzero(np.array(self.depth[:inner]) > 1)
        link = np.zeros(inner, dtype=np.int64)
        low, high = (self.rank[self.order[np.array(x)[deep]] + 1] for x in (self.low, self.high))
        step = self.common[:n] * n + np.arange(n)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in range(int(level.max()) + 1 if len(deep) else 0):
            here = np.flatnonzero(level == k)
            lowest = np.minimum(step[low[here] + 1], step[high[here] - (1 << k) + 1]) % n
            link[deep[here]] = self.at[lowest]
            step[: n - (1 << k)] = np.minimum(step[: n - (1 << k)], step[1 << k :])
        return link.tolist()


def _primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which squares of root length k have a root that is no power."""
    top = int(k.max()) + 1
    smallest = np.zeros(top, dtype=np.int64)
    for p in range(2, int(top**0.5) + 1):
        if smallest[p] == 0:
            view = smallest[p * p :: p]
            view[view == 0] = p
    smallest = np.where(smallest == 0, np.arange(top), smallest)
    out, left = np.ones(len(k), dtype=bool), k.copy()
    while (left > 1).any():
        here = np.flatnonzero((left > 1) & out)
        if not len(here):
            break
        p = smallest[left[here]]
        period = k[here] // p
        out[here] = tree.forward(start[here], start[here] + period) < 2 * k[here] - period
        left[here] //= p
    return out


def _covering(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of a set of squares that covers the leftmost occurrence of every square."""
    n, parent, least, depth = tree.n, tree.parent, tree.least, tree.depth
    borders, i = [], 0
    while i < n:
        borders.append(i)
        v = parent[tree.inner + i]
        while v and least[v] == i:
            v = parent[v]
        i += max(1, depth[v])
    h = np.array(borders)
    h1, h2 = np.append(h[1:], n), np.append(h[2:], [n, n])[: len(h)]

    def each(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block the numbers 1 to its reach, at most those of roots that can be repeated TIMES times."""
        reach = np.minimum(reach, n // TIMES)
        block = np.repeat(np.arange(len(h)), reach)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(reach) - reach, reach) + 1

    block, k = each(h1 - h)
    inside = h1[block] < n
    block, k = block[inside], k[inside]
    a, b = h1[block], h1[block] - k
    ahead, behind = tree.forward(a, b), tree.backward(a, b)
    found = (ahead + behind >= k) & (ahead > 0)
    starts, roots = [np.maximum(b - behind, b - k + 1)[found]], [k[found]]
    block, k = each(h2 - h)
    inside = h[block] + k < n
    block, k = block[inside], k[inside]
    a, b = h[block], h[block] + k
    ahead, behind = tree.forward(a, b), tree.backward(a, b)
    start = np.maximum(a - behind, a - k + 1)
    found = (ahead + behind >= k) & (ahead > 0) & (start + k <= h1[block])
    start, k = np.concatenate([*starts, start[found]]), np.concatenate([*roots, k[found]])
    if not len(k):
        return start, k
    both = np.unique(start * (n + 1) + k)
    start, k = both // (n + 1), both % (n + 1)
    kept = _primitive(tree, start, k)
    return start[kept], k[kept]


def _vocabulary(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> set[tuple[int, int]]:
    """(node below the end, length) of every distinct square."""
    n, parent, depth, least, child, letters = tree.n, tree.parent, tree.depth, tree.least, tree.child, tree.letters
    squares: dict[int, list[int]] = {}
    for s, r in sorted(zip(start.tolist(), k.tolist(), strict=True), reverse=True):
        squares.setdefault(s, []).append(2 * r)
    ends = []
    for s, lengths in squares.items():
        v, at = tree.inner + s, 0
        while at < len(lengths):
            upper = depth[parent[v]]
            while at < len(lengths) and lengths[at] > upper:
                ends.append((v, lengths[at]))
                at += 1
            v = parent[v]
            if least[v] != s:
                break
    link = tree.suffix_links()
    known = set(ends)
    for v, long in ends:
        while True:
            s = least[v]
            a, u = letters[s], link[parent[v]]
            c = u
            while depth[c] < long - 1:
                c = child[c * n + letters[s + 1 + depth[c]]]
            if depth[c] == long - 1:
                v = child.get(c * n + a)
            else:
                after = least[c] + long - 1
                v = c if after < n and letters[after] == a else None
            if v is None or (v, long) in known:
                break
            known.add((v, long))
    return known


def _located(tree: SuffixTree, ends: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that the occurrences of all squares make up."""
    n = tree.n
    parts = [tree.order[tree.low[v] : tree.high[v] + 1] if v < tree.inner else np.array([v - tree.inner]) for v, _ in ends]
    roots = np.repeat([long // 2 for _, long in ends], [len(p) for p in parts])
    key = np.sort(roots * (n + 1) + np.concatenate(parts))
    first = np.flatnonzero(np.append(True, np.diff(key) != 1))
    last = np.append(first[1:], len(key)) - 1
    k, start = key[first] // (n + 1), key[first] % (n + 1)
    length = key[last] - key[first] + 2 * k
    return list(zip(start.tolist(), length.tolist(), k.tolist(), strict=True))


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of an array of numbers, by start, then period."""
    if len(x) < LEAST:
        return []
    tree = SuffixTree(x)
    start, k = _covering(tree)
    if not len(k):
        return []
    return sorted(r for r in _located(tree, _vocabulary(tree, start, k)) if r[1] >= max(LEAST, TIMES * r[2]))


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches that hold all runs.

    A gram of a run stands again a period before or behind it in the same stretch, and a period is at most
    a fourth of the stretch. Grams for which that is not so go, the rest part into new stretches, until all
    stay. Equal hashes of different grams keep a stretch that could go, nothing else.
    """
    grams = combine(x.astype(U64) * _SPREAD[0] + _SPREAD[1], tuple(range(GRAM)))
    at = np.arange(len(grams))
    block = np.zeros(len(grams), dtype=np.int64)
    while len(at):
        size = np.bincount(block)
        limit = (size[block] + GRAM - 1) // TIMES
        key = grams[at] + block.astype(U64) * _SPREAD[1]
        order = np.argsort(key, kind="stable")
        gap = np.diff(at[order])
        near = (np.diff(key[order]) == 0) & (gap <= np.minimum(limit[order][1:], limit[order][:-1]))
        stays = np.zeros(len(at), dtype=bool)
        stays[order[1:][near]] = True
        stays[order[:-1][near]] = True
        kept = at[stays]
        if not len(kept):
            return []
        block = np.cumsum(np.append(0, np.diff(kept) != 1))
        wide = np.bincount(block)[block] > LEAST - GRAM
        if len(kept) == len(at) and wide.all():
            break
        at, block = kept[wide], np.unique(block[wide], return_inverse=True)[1]
    if not len(at):
        return []
    first = np.flatnonzero(np.append(True, np.diff(at) != 1))
    return [(int(at[i]), int(at[j - 1]) + GRAM) for i, j in zip(first, [*first[1:], len(at)], strict=True)]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start, then period."""
    if len(words) < LEAST:
        return []
    number = defaultdict(count().__next__)
    x = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    return sorted((a + s, n, k) for a, b in stretches(x) for s, n, k in runs_of(x[a:b]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only the first period."""
    if runs:
        stays = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words), and text, collapsed to the first period of each run."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("n_words", LongType()), StructField("runs", RUNS), StructField("text", StringType())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            n, runs, texts = [], [], []
            for raw in byte_views(batch.column(1)):
                words = raw.tobytes().split()
                found = word_runs(words)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(collapse(words, found))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(item)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])

    return map_arrow(docs.select("doc_id", "text"), search, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a document in ten, by the checksum of its id, repeats its words from one on.

    With h the CRC-32 of the id, h % 10 = 0, g = h div 10 and n words, each word i >= a becomes word
    a + (i - a) % p for a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.array_remove(F.split("text", WORD_GAP), "")).alias("_w"))
    some = some.withColumn("_n", F.size("_w")).withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.expr("CASE WHEN _n > 0 THEN _g % _n END"))
    some = some.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0L, _n - 1L), i -> _w[CAST(CASE WHEN i < _a THEN i ELSE _a + (i - _a) % _p END AS INT)]), ' ')")
    return some.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def summarize(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length for its period (start, length, period, exponent_milli) and digests."""
    best = F.expr("aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Runs by their definition: equal words a period apart, in islands of neighbouring starts.
ORACLE = f"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS digits FROM documents
), h AS (
  SELECT r, doc_id, words, len(words) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, crc
), g AS (SELECT r, doc_id, words, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM h
), p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM g
), w AS (
  SELECT r, n, i, words[CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)
), pair AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM w a JOIN w b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND {TIMES} * (b.i - a.i) <= a.n
), island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair
), stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY r, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)
), run AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length
), best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) = 1
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), text AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM p LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN text USING (r)
"""

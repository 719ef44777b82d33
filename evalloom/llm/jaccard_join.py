"""Exact Jaccard self-join of documents on word shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. The join
runs in three steps.

1. *Signatures.* Sets within the threshold differ in at most D shingles, D following from their
   sizes. The shingle universe is dealt by hash into more than D classes, so two linked sets agree
   exactly on all classes but D. The hash of each class of a set is a signature, and a set gives its
   D + 1 most telling ones, which are enough (see ``signatures``): those with the most rare shingles.
   A set takes part in the size interval it lies in and in each later one its partners may lie in, so
   both sides are dealt alike; sets that share a signature are candidates. Which shingles are frequent is
   counted over all texts: those that several sets of one Arrow batch hold are summed up, and as many
   powers of two of the largest sums as ``FREQUENT`` shingles allow go to the executors. Any choice of
   them is exact; this one keeps passages that many documents share from making candidates.
2. *Groups.* Connected components over candidates hold every link inside; each text is sent
   to its group once. Copies with one shingle set count as a single set throughout.
3. *T-occurrence search* inside a group. Each set asks the inverted lists of its shingles for the
   sets that occur at least T times. Its L longest lists are put aside (DivideSkip), the short
   ones are merged with a heap that skips ahead when too few heads remain (MergeSkip), and each
   survivor is looked up in the long lists by binary search until T is reached or out of reach.
   A set of which too many shingles occur nowhere else in the group can have no partner and is
   taken out first. Candidates already known to be in one component are not compared again.

A group above ``PART_SHINGLES`` is dealt into ``PARTS`` blocks by hash, and one above ``BLOCK_SHINGLES``
for each block into as many as that needs; blocks are searched one against another, so a task holds two
blocks at most and no link is lost; its links then go through the distributed
components. Equality of the 64-bit shingle hashes stands for equality of shingles.

Nulls: a null text is a text without words. Without words a document has the empty set, links with
nothing and is its own component. A null doc_id is never the smallest id unless all of the
component are null. Sets, not ids, are linked: rows that share a doc_id are documents of their own, and
rows of null ids link others. Repeated rows stay repeated in the result. Other columns are ignored; texts
are read whole, an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, free, map_arrow, sieved, signed, table
from .components import connected_components
from .hashing import U64, mix, shingles, splitmix

#: Shingles held by one block of a group, at most; two blocks are held at a time.
BLOCK_SHINGLES = 1_500_000
#: Shingles from which a group is searched by three tasks, in two blocks, so that each set is sent twice.
PART_SHINGLES, PARTS = 600_000, 2
#: Ratio between the ends of a size interval.
SIZE_RATIO = 1.5
#: Classes dealt for each one that the differences need.
SPARE = 2.0
_CLASS_SALT = U64(splitmix(4_242))
#: Frequent shingles that the executors are told of, at most, and the sum from which one is.
FREQUENT, LEAST_FREQUENT = 100_000, 4


def needed(nx: int, ny: int, percent: int) -> int:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (nx + ny) // (100 + percent))


@cache
def most_differences(low: int, high: int, percent: int) -> int:
    """Most shingles in which two linked sets differ, the larger of ``low`` to ``high`` shingles.

    It depends on the sum of both sizes alone, and rounding lets it fall where the sum grows.
    """
    least = low + -(-low * percent // 100)
    return max(s - 2 * needed(s, 0, percent) for s in range(least, 2 * high + 1))


def size_intervals(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(number, smallest, largest size) of the intervals of size n: its own, then those of larger partners."""
    out, largest = [], n * 100 // percent
    k, low = 0, 1
    while low <= largest:
        high = max(low, int(low * SIZE_RATIO))
        if n <= high:
            out.append((k, low, high))
        k, low = k + 1, high + 1
    return out


class Frequent:
    """A set of shingles that many sets hold."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)

    def rare(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(s), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)] != s


def signatures(s: np.ndarray, percent: int, frequent: Frequent) -> Iterator[np.ndarray]:
    """The signatures of a sorted shingle set for each of its size intervals.

    Classes are ranked by what they hold alone: their number of rare shingles, then a hash. Each set gives
    its ``most + 1`` highest classes. Of two linked sets let x be the one whose last class given ranks
    higher; one of the classes that x gives is among those on which both agree, so the other set has it
    too, ranked above its own last one, and gives it.
    """
    spread, rare = mix(s ^ _CLASS_SALT), frequent.rare(s)
    for k, low, high in size_intervals(len(s), percent):
        most = most_differences(low, high, percent)
        classes = int((most + 1) * SPARE) if most else 1
        which = ((spread >> U64(32)) * U64(classes) >> U64(32)).astype(np.int64)
        sums = np.zeros(classes, dtype=U64)
        np.add.at(sums, which, spread | U64(1))
        names = mix(sums + np.arange(classes, dtype=U64) * U64(splitmix(k) | 1) + U64(splitmix(k + 1000)))
        telling = np.minimum(np.bincount(which, weights=rare, minlength=classes), 63).astype(U64)
        ranks = telling << U64(58) | names >> U64(6)
        yield names if classes == most + 1 else names[np.argpartition(ranks, classes - most - 1)[classes - most - 1 :]]


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    d = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_NUMBERS = ("tid", "n_shingles", "sid", "sid2", "shingle", "held")
_SETS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _NUMBERS)])


def _sets(size: int):
    """A row for each text, and rows (shingle, held) for shingles that several sets of a batch hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, distinct = [], [], [], {}
            for raw in byte_views(b.column(2)):
                s = shingles(raw.tobytes(), size)
                name = identity(s)
                n.append(len(s))
                one.append(name[0])
                two.append(name[1])
                distinct[name] = s
            none = pa.nulls(len(b), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (n, one, two)), none, none], schema=_SETS)
            every, held = np.unique(np.concatenate([np.zeros(0, U64), *distinct.values()]), return_counts=True)
            every, held = every[held > 1], held[held > 1]
            none = pa.nulls(len(every), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(signed(every)), pa.array(held, pa.int64())], schema=_SETS)

    return run


def frequent_shingles(counts: DataFrame, most: int = FREQUENT) -> Frequent:
    """The most frequent out of (shingle, held) rows. At most ``most`` come to the driver: the number of
    shingles of each power of two says from which power on."""
    sums = table(counts.groupBy("shingle").agg(F.sum("held").alias("held")).where(f"held >= {LEAST_FREQUENT}"), "frequent")
    powers = sums.groupBy(F.floor(F.log2("held")).alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect()
    total, from_ = 0, None
    for r in powers:
        total += r.n
        if total > most:
            break
        from_ = r.power
    found = sums.where(f"held >= {2**from_}" if from_ is not None else "false").select("shingle").toArrow()
    free(sums)
    return Frequent(np.asarray(found.column("shingle")).astype(np.int64).view(U64))


def _signature_rows(size: int, percent: int, frequent: Frequent):
    """(sig, sid) of the signatures of each set, once in a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, len(b), 500):
                cols: tuple[list, list] = ([], [])
                for raw in byte_views(b.column(0).slice(at, 500)):
                    s = shingles(raw.tobytes(), size)
                    sid = identity(s)[0]
                    if not len(s) or sid in seen:
                        continue
                    seen.add(sid)
                    for sig in signatures(s, percent, frequent):
                        cols[0].append(signed(sig))
                        cols[1].append(np.full(len(sig), sid))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["sig", "sid"])

    return run


def _candidates(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets that share a signature, from rows (sig, sid): the sets of a
    signature are chained in order."""
    chained = rows.sparkSession.sql("SELECT sid AS a, lag(sid) OVER (PARTITION BY sig ORDER BY sid) AS b FROM {rows}", rows=rows)
    return chained.where("b is not null and a <> b").distinct()


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, count) of those in at least ``least`` of the sorted lists, by a heap of list heads.

    When the smallest head occurs too rarely, further heads are popped up to ``least - 1`` in all
    and moved by binary search to the smallest value that can still reach the count.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield value, len(popped)
            for _, k, at in popped:
                if at + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            return
        target = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


def search(sets: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple[int, int]]:
    """Links (y, x), y < x, that connect the same sets as all links among ``sets`` do.

    With ``first``, only links between the sets before and from position ``first`` are sought.
    """
    n = len(sets)
    forest, links = Forest(n), []
    token, sizes = np.unique(np.concatenate(sets), return_inverse=True)[1], np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    live = np.ones(n, dtype=bool)
    while True:  # a partner shares at least percent % of a set's shingles
        count = np.bincount(token[live[owner]], minlength=int(token.max()) + 1)
        shared = np.add.reduceat(count[token] > 1, ends - sizes)
        keep = live & (shared * 100 >= sizes * percent)
        if (keep == live).all():
            break
        live = keep
    lists: dict[int, list[int]] = {}
    for x in np.flatnonzero(live).tolist():
        mine = token[ends[x] - sizes[x] : ends[x]]
        mine = mine[np.argsort(count[mine], kind="stable")]
        nx = len(mine)
        t = -(-nx * percent // 100)
        longest = int(count[mine[-1]])
        long = min(t - 1, max(int(t / (0.02 * math.log2(longest + 1) + 1)), 0))
        own = mine.tolist()
        if first is None or x >= first:
            short = [v for v in (lists.get(k) for k in own[: nx - long]) if v]
            probe = [v for v in (lists.get(k) for k in own[nx - long :]) if v]
            at = forest.root(x)
            for y, seen in merge_skip(short, t - long):
                if forest.root(y) == at:
                    continue
                want, left = needed(nx, len(sets[y]), percent), len(probe)
                for v in probe:
                    if seen >= want or seen + left < want:
                        break
                    left -= 1
                    k = bisect_left(v, y)
                    seen += k < len(v) and v[k] == y
                if seen >= want:
                    links.append((y, x))
                    forest.join(x, y)
                    at = forest.root(x)
        if first is None or x < first:
            for k in own:
                lists.setdefault(k, []).append(x)
    return links


_LINKS = pa.schema([(c, pa.int64()) for c in ("a", "a2", "b", "b2")])


def _within(size: int, percent: int):
    """Input rows sorted by task and side: (task, side, sid, sid2, text). Links between sets (sid, sid2)."""

    def flush(rows: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        order = sorted(rows, key=lambda v: (rows[v][0], v))
        if len(order) < 2:
            return None
        sides = [rows[v][0] for v in order]
        first = sides.index(1) if sides[0] == 0 and sides[-1] == 1 else None
        if sides[0] != sides[-1] and first is None:
            return None
        found = search([rows[v][1] for v in order], percent, first)
        columns = zip(*((*order[y], *order[x]) for y, x in found), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_LINKS) if found else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, {}
        for b in batches:
            tasks, sides, *names = (b.column(k).to_pylist() for k in range(4))
            for k, raw in enumerate(byte_views(b.column(4))):
                if tasks[k] != task:
                    if (out := flush(rows)) is not None:
                        yield out
                    task, rows = tasks[k], {}
                name = (names[0][k], names[1][k])
                if name not in rows:
                    s = shingles(raw.tobytes(), size)
                    if identity(s) == name:
                        rows[name] = (sides[k], s)
        if (out := flush(rows)) is not None:
            yield out

    return run


def link_classes(docs: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK_SHINGLES, part: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, tid, n_shingles, class) for each row of ``docs`` (doc_id, text): tid is a hash of the
    text, class names the connected component of its set, null without words."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tid"), F.col("text").cast("string").alias("text"))
    both = table(text.transform(map_arrow, _sets(size), "doc_id long, " + ", ".join(f"{c} long" for c in _NUMBERS)), "sets")
    sets = both.where("shingle is null").drop("shingle", "held")
    frequent = frequent_shingles(both.where("shingle is not null").select("shingle", "held"))

    rows = text.select("text").transform(map_arrow, _signature_rows(size, percent, frequent), "sig long, sid long")
    groups = table(connected_components(_candidates(rows)).selectExpr("node AS sid", "component AS grp"), "groups")

    # The text of a set is read from one of its rows. Sets of one sid are told apart by sid2.
    key = F.expr("coalesce(doc_id, -9223372036854775808)")
    nodes = sets.where("n_shingles > 0").groupBy("sid", "sid2", "n_shingles").agg(F.min(F.struct(key.alias("k"), "tid")).alias("row"))
    nodes = nodes.join(groups, "sid")
    blocks = f"greatest(ceil(weight / {block}), least({PARTS}, ceil(weight / {part})))"
    totals = nodes.groupBy("grp").agg(F.sum("n_shingles").alias("weight")).selectExpr("grp", f"cast({blocks} as int) AS blocks")
    nodes = nodes.join(totals, "grp").selectExpr("row.k AS k", "row.tid AS tid", "sid", "sid2", "grp", "blocks", "cast(pmod(xxhash64(sid, 17L), blocks) as int) AS mine")
    # A block meets every block once: pair (i, j) with i < j by sides 0 and 1, (i, i) by side 0 alone.
    nodes = nodes.selectExpr("*", "explode(sequence(0, blocks - 1)) AS other")
    nodes = table(nodes.selectExpr("k", "tid", "sid", "sid2", "xxhash64(grp, least(mine, other), greatest(mine, other)) AS task", "cast(mine > other as int) AS side"), "nodes")
    grouped = sieved(text.select(key.alias("k"), "tid", "text"), F.col("tid"), nodes.select("tid"))[1]
    sent = nodes.join(grouped, ["k", "tid"]).repartition("task").sortWithinPartitions("task", "side", "sid", "sid2")
    found = sent.select("task", "side", "sid", "sid2", "text").transform(map_arrow, _within(size, percent), "a long, a2 long, b long, b2 long")
    links = table(found.selectExpr("named_struct('sid', a, 'sid2', a2) AS a", "named_struct('sid', b, 'sid2', b2) AS b"), "links")
    classes = table(connected_components(links).selectExpr("node.sid AS sid", "node.sid2 AS sid2", "component"), "classes")
    free(groups, links, nodes)
    name = F.expr("if(n_shingles > 0, coalesce(component, named_struct('sid', sid, 'sid2', sid2)), null)")
    return sets.join(classes, ["sid", "sid2"], "left").select("doc_id", "tid", "n_shingles", name.alias("class"))


def similar_documents(docs: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK_SHINGLES, part: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    rows = table(link_classes(docs, size, percent, block, part), "rows")
    # Copies of one class are summed up before the shuffle; adaptive execution splits them in the join.
    named = table(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1"), "named")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.expr("if(n > 1, component_id, doc_id)").alias("component_id"))

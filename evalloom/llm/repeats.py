"""Removal of every byte that a repeated string covers, and the words of passages shared by documents.

Two kinds of repetition are found in one pass, each over a sequence of units:

* *bytes*: a unit is a byte, a window ``WINDOW`` bytes. A byte goes if some window over it also
  starts anywhere else, in the same document or another one.
* *words*: a unit is a word ``[^\\x20\\x09-\\x0D]+``, given by 32 bits of its hash, a window
  ``PASSAGE`` words. A word counts as shared if some window over it stands in another document as well,
  whatever separates the words. (51 words may be fewer than 400 bytes, so the first kind misses such passages.)

Not all windows are compared: each window names an *anchor*, the stretch of a fixed length inside it
with the smallest hash, so equal windows name equal anchors at equal offsets. Consecutive windows
with one anchor form a *region*.

1. Anchors that occur once are dropped by a count with partial sums.
2. Regions with equal bytes form a *class*: an equal anchor hash (63 bits) and an equal BLAKE2b digest
   of the whole region (64 bits) stand for equal bytes. A class with several members is repeated.
3. One member of each class goes to its anchor's group, if that has other classes. There the extensions
   to the right and to the left of the anchor are suffix-sorted by hash comparison (``suffix_sort``), which
   verifies its extensions on the bytes; windows are equal where they agree in the left order and in the
   right order at the depths they need. What holds for a member holds for its class.
4. An anchor with more than ``CROWD`` classes would make too large a group. One region of each class (of words that a
   single row holds more than once, each region)
   is dealt again with longer anchors, and at last with anchors as long as a window, where a group is
   one class: so no group is large and none is left out.

Nulls: a null text has no bytes. An empty or short text loses nothing unless it has a whole
repeated window. Repeated rows count as documents of their own, so each is a copy of the other.
A null doc_id is kept; an empty table gives no rows. Other columns are ignored. Texts of any length are
read in pieces of ``PIECE`` windows that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, free, map_arrow, signed, table
from .hashing import BYTE_VALUES, U64, mix, powers, prefix_sums, word_bounds, word_hashes
from .suffix_sort import Suffixes

WINDOW, ANCHOR, CROWD, PIECE = 400, 200, 2000, 1 << 20
#: Words of a passage, and of its anchors.
PASSAGE, PASSAGE_ANCHOR = 51, 20
#: Regions sorted together; bounds the memory of a task.
BATCH = 4000
#: Units of short texts that are hashed together.
TOGETHER = 1 << 16
_PLACE = U64((1 << 21) - 1)


@dataclass(frozen=True)
class Kind:
    """Windows and, by level, anchors in units; ``size`` is the bytes that stand for a unit."""

    size: int
    window: int
    anchors: tuple[int, ...]

    @property
    def own(self) -> bool:
        """Whether the windows of one document among themselves count."""
        return self.size == 1


def kinds(window: int, anchor: int, words: int, words_anchor: int) -> tuple[Kind, Kind]:
    return tuple(Kind(size, w, (a, (a + w + 1) // 2, w)) for size, w, a in ((1, window, anchor), (4, words, words_anchor)))


def _sequences(raws: list[np.ndarray], kind: Kind) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash of each unit, the bytes that stand for the units) of each text, all texts hashed at once."""
    if kind.own:
        data, ends = np.concatenate(raws), np.cumsum([len(r) for r in raws])
        values = BYTE_VALUES[data]
    else:
        joined = np.frombuffer(b" ".join(raws), np.uint8)
        bounds = word_bounds(joined)
        values = word_hashes(joined, False, bounds)
        data = (values >> U64(32)).astype("<u4").view(np.uint8)
        ends = np.searchsorted(bounds[0], np.cumsum([len(r) + 1 for r in raws]))
    ends, each = ends.tolist(), kind.size
    return [(values[a:e], data[a * each : e * each]) for a, e in zip([0, *ends[:-1]], ends, strict=True)]


def _together(sizes: list[int]) -> Iterator[list[int]]:
    """The numbers of consecutive texts or stretches, so many at a time that they have at most ``TOGETHER`` units, or one."""
    mine, total = [], 0
    for k, n in enumerate(sizes):
        if mine and total + n > TOGETHER:
            yield mine
            mine, total = [], 0
        mine.append(k)
        total += n
    if mine:
        yield mine


def _chosen(part: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(the position of each window's anchor, the hash of each position's stretch)."""
    prefix = prefix_sums(part)
    n = len(part) - anchor + 1
    hashes = mix((prefix[anchor:] - prefix[:n]) * powers(n)[1])
    least = (hashes & ~_PLACE) | np.arange(n).astype(U64)
    span, width = window - anchor + 1, 1
    while 2 * width <= span:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (least & _PLACE).astype(np.int64), hashes


def regions(parts: list[np.ndarray], window: int, anchor: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the sequence, first window, last window, anchor position, anchor hash) of the regions of sequences of units.

    Short sequences are taken together, one after another in one array; windows that cross a border are left out. Longer ones come piece by piece.
    """
    pieces = [(k, begin, p[begin : begin + piece + window - 1]) for k, p in enumerate(parts) for begin in range(0, max(0, len(p) - window + 1), piece)]
    for some in _together([len(p) for _, _, p in pieces]):
        mine = [pieces[k] for k in some]
        sizes = np.array([len(p) for _, _, p in mine])
        begin = np.cumsum(sizes) - sizes
        end = begin + sizes - window + 1
        chosen, hashes = _chosen(np.concatenate([p for _, _, p in mine]), window, anchor)
        opens = np.r_[True, chosen[1:] != chosen[:-1]]
        opens[begin] = True
        first = np.flatnonzero(opens)
        stop = np.r_[first[1:], len(chosen)]
        owner = np.searchsorted(begin, first, "right") - 1
        inside = first < end[owner]
        first, stop, owner = first[inside], stop[inside], owner[inside]
        stop, at = np.minimum(stop, end[owner]), chosen[first]
        move = np.array([b for _, b, _ in mine])[owner] - begin[owner]
        yield np.array([k for k, _, _ in mine])[owner], first + move, stop - 1 + move, at + move, hashes[at]


def _anchors(both: tuple[Kind, ...], level: int, piece: int, whole: bool = True):
    """Regions of whole texts, given whether their row is repeated, or on later levels of the large
    groups' regions given with them; only the anchors' hashes unless ``whole``. ``more`` says that a
    part stands in other documents too. The lowest bit of an anchor's hash is its kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 500):
                rows, cols = b.slice(start, 500), [[] for _ in range(8 if whole else 1)]
                ids, tids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                given, raws = rows.column(3).to_pylist(), list(byte_views(rows.column(2)))
                for number, kind in enumerate(both):
                    each = kind.size
                    if level:
                        asked = [sorted({(x["lo"], x["size"], x["several"]) for x in g if x["large"] and x["h"] & 1 == number}) for g in given]
                    else:
                        asked = [[(0, None, g)] for g in given]
                    wanted = [k for k, a in enumerate(asked) if a]
                    for some in _together([len(raws[k]) for k in wanted]):
                        texts = [wanted[i] for i in some]
                        parts = []
                        for k, (values, data) in zip(texts, _sequences([raws[k] for k in texts], kind), strict=True):
                            parts += [(k, lo, more, values[lo : None if size is None else lo + size], data[lo * each : None if size is None else (lo + size) * each]) for lo, size, more in asked[k]]
                        found = regions([p[3] for p in parts], kind.window, kind.anchors[level], piece)
                        if not whole:
                            cols[0] += [signed((hashes & ~U64(1)) | U64(number)) for *_, hashes in found]
                            continue
                        row, moved, more = (np.array([p[i] for p in parts], np.int64) for i in range(3))
                        sizes = np.array([len(p[4]) for p in parts])
                        view, base = memoryview(b"".join(p[4] for p in parts)), np.cumsum(sizes) - sizes
                        for of, first, last, at, hashes in found:
                            last = last + kind.window
                            spans = zip((base[of] + first * each).tolist(), (base[of] + last * each).tolist(), strict=True)
                            digests = b"".join([blake2b(view[s:e], digest_size=8).digest() for s, e in spans])
                            new = (signed((hashes & ~U64(1)) | U64(number)), np.frombuffer(digests, np.int64), ids[row[of]], tids[row[of]], first + moved[of], at - first, last - first, more[of])
                            for out, v in zip(cols, new, strict=True):
                                out.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=["h", "rd", "k", "tid", "lo", "at", "size", "more"][: len(cols)])

    return run


_MEMBERS = "h long, rd long, k long, tid long, at int, several boolean, bytes binary"


def _members(both: tuple[Kind, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the regions that go to their anchor's group."""
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for b in batches:
            for start in range(0, len(b), 200):
                part, rows = b.slice(start, 200), []
                ids, tids, lists = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
                for k, raw in enumerate(byte_views(part.column(2))):
                    for number, kind in enumerate(both):
                        mine = [x for x in lists[k] if not x["large"] and x["h"] & 1 == number]
                        data, each = _sequences([raw], kind)[0][1] if mine else raw, kind.size
                        rows += [(x["h"], x["rd"], ids[k], tids[k], x["at"], x["several"], data[x["lo"] * each : (x["lo"] + x["size"]) * each].tobytes()) for x in mine]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h", "rd", "k", "tid", "at", "several", "bytes"])

    return run


def repeated_windows(parts: list[bytes], anchors: np.ndarray, groups: np.ndarray, docs: np.ndarray, several: np.ndarray, window: int, unit: int = 1) -> list[np.ndarray]:
    """For each region the offsets of its windows that regions of different ``docs`` in its group hold,
    or one that stands for ``several``. All in bytes; windows start at multiples of ``unit``."""
    n = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    right_order, right_common = Suffixes(np.frombuffer(b"".join(parts), np.uint8), starts + anchors, sizes - anchors, groups).sort()
    left = np.frombuffer(b"".join(p[a - 1 :: -1] if a else b"" for p, a in zip(parts, anchors.tolist(), strict=True)) or b"\0", np.uint8)
    left_order, left_common = Suffixes(left, np.cumsum(anchors) - anchors, anchors, groups).sort()
    found: list[list[int]] = [[] for _ in range(n)]
    for depth in range(0, int(anchors.max()) + 1, unit):
        # Windows that start `depth` bytes before the anchor.
        has = np.flatnonzero((anchors >= depth) & (sizes - anchors >= window - depth))
        if not len(has):
            continue
        kind = np.empty(n, np.int64)
        kind[left_order] = np.cumsum(left_common < depth)
        same = kind[has] * (n + 1)
        kind[right_order] = np.cumsum(right_common < window - depth)
        same += kind[has]
        order = np.lexsort((docs[has], same))
        first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        end = np.r_[first[1:], len(order)]
        repeated = (docs[has[order[first]]] != docs[has[order[end - 1]]]) | np.logical_or.reduceat(several[has[order]], first)
        for i in has[order[np.repeat(repeated, end - first)]].tolist():
            found[i].append(int(anchors[i]) - depth)
    return [np.array(sorted(f), np.int64) for f in found]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[first], reach[np.r_[first[1:] - 1, len(starts) - 1]]


def _groups(both: tuple[Kind, ...]):
    def settle(rows: list[tuple], kind: Kind) -> Iterator[pa.RecordBatch]:
        """Spans of the classes of whole groups, in units within their regions."""
        if len(rows) < 2:
            return
        each = kind.size
        group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        seen: dict[tuple, int] = {}
        docs = np.arange(len(rows)) if kind.own else np.array([seen.setdefault(r[2:4], len(seen)) for r in rows])
        anchors, several = np.array([r[4] * each for r in rows], np.int64), np.array([r[5] for r in rows])
        out = []
        for r, at in zip(rows, repeated_windows([r[6] for r in rows], anchors, group, docs, several, kind.window * each, each), strict=True):
            if len(at):
                out += [(r[0], r[1], lo, hi) for lo, hi in zip(*(v.tolist() for v in merged(at // each, at // each + kind.window)), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "rd", "start", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor hash and content; whole groups are sorted a batch at a time."""
        rows: list[tuple] = []
        last: tuple | None = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] == last:
                    continue  # a repeated row
                if last is not None and row[0] != last[0] and len(rows) >= BATCH:
                    for number, kind in enumerate(both):
                        yield from settle([r for r in rows if r[0] & 1 == number], kind)
                    rows = []
                rows.append(row)
                last = row[:2]
        for number, kind in enumerate(both):
            yield from settle([r for r in rows if r[0] & 1 == number], kind)

    return run


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        # Spans of each text and kind on a stretch of one line of their own, merged all at once.
        lists = b.column(3)
        kind, lo, hi = (lists.flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("kind", "lo", "hi"))
        line = 2 * np.repeat(np.arange(len(b)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + kind
        stretch = int(hi.max(initial=0)) + 2
        lo, hi = merged(lo + line * stretch, hi + line * stretch)
        ends = np.searchsorted(lo, np.arange(2 * len(b) + 1) * stretch)
        size, runs = np.r_[0, np.cumsum(hi - lo)][ends], ends.tolist()
        place = lo // stretch * stretch
        lo, hi, digests = (lo - place).tolist(), (hi - place).tolist(), []
        for k, raw in enumerate(byte_views(b.column(2))):
            kept, at, text = sha256(), 0, memoryview(raw)
            for r in range(runs[2 * k], runs[2 * k + 1]):
                kept.update(text[at : lo[r]])
                at = hi[r]
            kept.update(text[at:])
            digests.append(kept.hexdigest())
        covered = np.diff(size)
        columns = [b.column(0), b.column(1), pa.array(covered[::2]), pa.array(np.diff(ends)[::2]), pa.array(digests, pa.string()), pa.array(covered[1::2])]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "tid", "n_removed", "n_spans", "kept_sha256", "n_shared_words"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, crowd: int = CROWD, words: int = PASSAGE, words_anchor: int = PASSAGE_ANCHOR, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words) for each row of ``docs`` (doc_id, text).

    ``n_shared_words`` counts the words in passages of ``words`` words or more that another row holds too.
    ``window`` may exceed ``anchor`` by at most some thousands: the difference is how far two
    anchors lie apart at most.
    """
    both = kinds(window, anchor, words, words_anchor)
    plain = docs.select("doc_id", F.expr("coalesce(doc_id, -9223372036854775808)").cast("long").alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    plain = plain.select("doc_id", "k", F.xxhash64("text").alias("tid"), "text")
    text = plain.select("k", "tid", "text").where(f"octet_length(text) >= {min(window, 2 * words - 1)}")
    twins = table(plain.groupBy("k", "tid").agg(F.count("*").alias("n")).where("n > 1").select("k", "tid"), "twins")
    source, spans, levels = text.withColumn("more", F.lit(False)), None, len(both[0].anchors)
    if not twins.isEmpty():
        source = text.join(twins.withColumn("more", F.lit(True)), ["k", "tid"], "left").select("k", "tid", "text", F.coalesce("more", F.lit(False)).alias("more"))
    for level in range(levels):
        hashes = source.transform(map_arrow, _anchors(both, level, piece, False), "h long")
        # Written first, so that the join below stands alone and a frequent anchor's rows can be split.
        often = table(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
        rows = source.transform(map_arrow, _anchors(both, level, piece), "h long, rd long, k long, tid long, lo long, at long, size long, more long")
        rows = rows.selectExpr("h", "rd", "k", "tid", "cast(lo as int) lo", "cast(at as int) at", "cast(size as int) size", "more > 0 AS more")
        found = table(rows.join(often, "h"), "anchors")
        free(often)
        # One row for each class says all about it, so the rows of one anchor part by their content.
        member = F.struct("k", "tid", "lo", "at", "size")
        classes = found.groupBy("h", "rd").agg(F.count("*").alias("n"), F.min(member).alias("one"), F.max(member).alias("last"), F.max("more").alias("more"))
        # Words count where another row holds them: of another id or text, or a repeated row.
        apart = "(h & 1 = 0 or one.k <> last.k or one.tid <> last.tid)"
        classes = table(classes.selectExpr("h", "rd", "n", "one", f"more or (n > 1 and {apart}) AS several"), "classes")
        counts = table(classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "counts")
        crowded = level + 1 < levels and not counts.where(f"m > {crowd}").isEmpty()
        item = F.expr(f"struct(h, rd, several, one.lo AS lo, one.at AS at, one.size AS size, m > {crowd if level + 1 < levels else 1 << 62} AS large)")
        items = classes.join(counts, "h").select("one.k", "one.tid", item.alias("item"))
        if crowded:
            # Words that one row alone holds, more than once: no other row's finding covers these members, so each is dealt again.
            alike = classes.where("n > 1 and not several").join(counts.where(f"m > {crowd}"), "h").select("h", "rd", F.col("one.lo").alias("first"))
            again = F.expr("struct(h, rd, false AS several, lo, at, size, true AS large)")
            items = items.unionByName(found.join(alike, ["h", "rd"]).where("lo <> first").select("k", "tid", again.alias("item")))
        lists = items.groupBy("k", "tid").agg(F.collect_list("item").alias("items"))
        held = source.select("k", "tid", "text").join(lists.hint("shuffle_hash"), ["k", "tid"]).select("k", "tid", "text", "items")
        held = table(held, "held") if crowded else held
        members = held.transform(map_arrow, _members(both), _MEMBERS)
        sorted_ = table(members.repartition("h").sortWithinPartitions("h", "rd").transform(map_arrow, _groups(both), "h long, rd long, start int, stop int"), "sorted")
        settled = sorted_.union(classes.where("several").selectExpr("h", "rd", "0", "one.size"))
        here = found.join(settled, ["h", "rd"]).selectExpr("k", "tid", "cast(h & 1 as int) AS kind", "lo + start AS lo", "lo + stop AS hi")
        spans = here if spans is None else spans.union(here)
        if not crowded:
            break
        source = held.where("exists(items, x -> x.large)")
    spans = spans.groupBy("k", "tid").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("spans"))
    done = text.join(spans.hint("shuffle_hash"), ["k", "tid"]).select("k", "tid", "text", "spans").transform(map_arrow, _finish, "k long, tid long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long").dropDuplicates(["k", "tid"])
    base = plain.select("doc_id", "k", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return base.join(done, ["k", "tid"], "left").selectExpr("doc_id", "n_bytes", "coalesce(n_removed, 0) AS n_removed", "coalesce(n_spans, 0) AS n_spans", "coalesce(kept_sha256, whole) AS kept_sha256", "coalesce(n_shared_words, 0) AS n_shared_words")

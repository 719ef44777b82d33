"""Suffix sort by hash comparison.

Suffixes are compared through their longest common extension, found by binary search over
prefix polynomial hashes: a comparison costs a logarithmic number of look-ups, however long the
shared text is. A bottom-up mergesort sorts all groups of suffixes at once with numpy; a run is
merged by ranking each of its members in the neighbouring run with binary search. Adjacent
extensions are checked against the bytes afterwards; should a hash collision have misled the sort,
the groups are sorted by their bytes instead.
"""

from __future__ import annotations

import numpy as np

from .hashing import prefix_hashes, span_hashes


class Suffixes:
    """Suffixes ``raw[start : start + size]`` in contiguous groups, to be ordered within each."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> None:
        self.raw, self.starts, self.sizes = raw, starts.astype(np.int64), sizes.astype(np.int64)
        self.prefix = prefix_hashes(raw)
        n = len(starts)
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
        lengths = np.diff(np.r_[first, n])
        self.base, self.length = np.repeat(first, lengths), np.repeat(lengths, lengths)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes i and j."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        si, sj = self.starts[i], self.starts[j]
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hashes(self.prefix, si, si + mid) == span_hashes(self.prefix, sj, sj + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def _next(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = at < self.sizes[i]
        return np.where(inside, self.raw[np.where(inside, self.starts[i] + at, 0)].astype(np.int16), -1)

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Negative, zero or positive as suffix i sorts before, with or after suffix j."""
        at = self.extension(i, j)
        return self._next(i, at) - self._next(j, at)

    def _merge(self, order: np.ndarray, width: int) -> np.ndarray:
        place = np.flatnonzero(self.length > width)
        local = place - self.base[place]
        pair = local // (2 * width) * (2 * width)
        left = local - pair < width
        start = pair + np.where(left, width, 0)
        low, high = np.zeros(len(place), np.int64), np.clip(self.length[place] - start, 0, width)
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) >> 1
            sign = self.compare(order[self.base[place[todo]] + start[todo] + mid], order[place[todo]])
            before = np.where(left[todo], sign < 0, sign <= 0)
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        own = local - pair - np.where(left, 0, width)
        out = order.copy()
        out[self.base[place] + pair + own + low] = order[place]
        return out

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): suffixes in order, and for each how many bytes it shares with the one
        before it in its group, -1 for the first of a group."""
        order, width = np.arange(len(self.starts)), 1
        longest = int(self.length.max()) if len(order) else 0
        while width < longest:
            order, width = self._merge(order, width), 2 * width
        common = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(np.arange(len(order)) > self.base)
        common[inner] = self.extension(order[inner - 1], order[inner])
        return (order, common) if self._verified(order, common, inner) else self._by_bytes()

    def _bytes(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def _verified(self, order: np.ndarray, common: np.ndarray, inner: np.ndarray) -> bool:
        for k in inner.tolist():
            a, b, c = self._bytes(order[k - 1]), self._bytes(order[k]), int(common[k])
            if a[:c] != b[:c] or a[c : c + 1] > b[c : c + 1] or (a[c : c + 1] == b[c : c + 1] != b""):
                return False
        return True

    def _by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.array(sorted(range(len(self.starts)), key=lambda i: (self.base[i], self._bytes(i))), dtype=np.int64)
        common = np.full(len(order), -1, np.int64)
        for k in np.flatnonzero(np.arange(len(order)) > self.base).tolist():
            a, b = self._bytes(order[k - 1]), self._bytes(order[k])
            m = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8)[:m] != np.frombuffer(b, np.uint8)[:m])
            common[k] = differ[0] if len(differ) else m
        return order, common


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of all suffixes of data in lexicographic order."""
    n = len(data)
    at = np.arange(n)
    return Suffixes(np.frombuffer(data, np.uint8), at, n - at, np.zeros(n, np.int64)).sort()[0]

"""Vectorised hashing of bytes, words and shingles, shared by the operators of this subpackage.

All hashes are polynomial hashes modulo 2**64 over a fixed random value per byte. The prefix hash
``P[i] = sum(value[b[j]] * BASE**j for j < i)`` makes the hash of any substring two look-ups, one
subtraction and one multiplication with a power of the inverse base, so a whole text is hashed
with a handful of numpy passes and no Python loop over its words. Callers verify equal hashes
where a collision would change a result.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MASK64 = (1 << 64) - 1


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK64
    return x ^ (x >> 31)


BASE = splitmix(20_011) | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.array([splitmix(b + 1) for b in range(256)], dtype=U64)
#: The same with A-Z read as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept and doubled as needed."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all bits (a bijection)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P of length len(values) + 1 for an array of 64-bit values."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def prefix_hashes(raw: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """P of length len(raw) + 1 for an array of bytes."""
    return prefix_sums(values[raw])


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    inverse = powers(len(prefix))[1]
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~IS_SPACE[raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, folded: bool = True, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash per word, lower-casing A-Z if folded; ``bounds`` are those of ``word_bounds``, if known."""
    starts, ends = word_bounds(raw) if bounds is None else bounds
    if not len(starts):
        return np.zeros(0, dtype=U64)
    prefix = prefix_hashes(raw, FOLDED_VALUES if folded else BYTE_VALUES)
    return mix(span_hashes(prefix, starts, ends) + (ends - starts).astype(U64))


_ORDER = [U64(splitmix(7_001 + k) | 1) for k in range(64)]


def combine(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """For each position the hash of the words at the given offsets from it, in order."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for k, at in enumerate(offsets):
        out += words[at : at + n] * _ORDER[k]
    return mix(out)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text.

    With fewer words than ``size`` the whole sequence is the one shingle; without words the set is
    empty. The number of words is part of the hash of such a short sequence.
    """
    words = word_hashes(np.frombuffer(text, dtype=np.uint8))
    if not len(words):
        return words
    if len(words) < size:
        return combine(words, tuple(range(len(words)))) ^ U64(splitmix(len(words)))
    return np.unique(combine(words, tuple(range(size))))

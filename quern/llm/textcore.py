"""Vectorised words and rolling hashes over the UTF-8 bytes of many documents at once.

A word is a maximal run of a-z, 0-9 and bytes over 0x7F once A-Z is lower-cased. In UTF-8 that is exactly the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over characters. Hashes only propose: callers compare the words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: One random 64-bit value for each byte, and odd bases with their inverses modulo 2**64.
BYTE_VALUES = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


#: Bytes that hashes are computed over at once, so that temporary arrays don't grow with a text.
STEP = 1 << 16


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, for n up to STEP or so."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        grown = np.full(max(n, STEP), base, np.uint64)
        grown[0] = 1
        _powers[base] = known = np.cumprod(grown, dtype=np.uint64)
    return known[:n]


def power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64 from two short tables."""
    high = at >> 16
    top = powers(pow(base, STEP, 2**64), int(high.max()) + 1 if len(at) else 1)
    return powers(base, STEP)[at & (STEP - 1)] * top[high]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of byte values times powers of BASE."""
    out = np.zeros(len(data) + 1, np.uint64)
    table = powers(BASE, STEP)
    for a in range(0, len(data), STEP):
        part = BYTE_VALUES[data[a : a + STEP]]
        part *= table[: len(part)]
        part *= np.uint64(pow(BASE, a, 2**64))
        part[:1] += out[a : a + 1]
        np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    out = prefix[ends]
    out -= prefix[starts]
    out *= power_at(INVERSE, starts)
    return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """Words of consecutive documents. ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.starts, self.ends)

    def text(self, i: int, k: int) -> bytes:
        """k words from i on, joined by spaces."""
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + k].tolist(), self.ends[i : i + k].tolist())])


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_WORD[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds).astype(np.int64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive word hashes; the caller leaves out those that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * GRAM_BASE + hashes[j : j + n]
    return mix(out)


def inside_one(found: Words, at: np.ndarray, k: int) -> np.ndarray:
    """Which of the grams of k words at these places stay in one document."""
    owner = np.searchsorted(found.first, at, side="right") - 1
    return at + k <= found.first[owner + 1]


class HashSet:
    """Membership of 64-bit hashes: a bit table by the lowest bits, then a sorted array."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.sorted & self.mask).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of hashes that are in the set."""
        if not len(self.sorted) or not len(hashes):
            return np.zeros(0, np.int64)
        near = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.sorted, hashes[near]), len(self.sorted) - 1)
        return near[self.sorted[where] == hashes[near]]

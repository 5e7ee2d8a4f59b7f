"""Repeated windows of a block of contexts by a suffix array built with a difference cover.

Every two positions have a shift below ``PERIOD`` that puts both into the cover sample, so the order of two suffixes is
that of their first bytes, or else that of the ranks of two sampled suffixes. The block's sample is ranked first (by
``PERIOD`` bytes, then doubled); then suffixes are sorted bucket by bucket: by 8 bytes at a time up to
``PERIOD``, and what is still tied by ternary quicksort on cover ranks. Working memory is some 60 bytes a byte of the block.
"""

from __future__ import annotations

import numpy as np

PERIOD = 32
#: Its differences give every number modulo PERIOD.
COVER = (0, 1, 2, 3, 7, 11, 19)

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
#: SHIFT[i, j]: the least d with i + d and j + d both in the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(i + d) % PERIOD] and _IN_COVER[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)], np.int64)


def eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; zeros follow the text."""
    padded = np.append(text, np.zeros(8, np.uint8))
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(text)]
    return out


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the rows of keys (the first is the most significant); equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def cover_ranks(text: np.ndarray, eight: np.ndarray, longest: int) -> np.ndarray:
    """Rank of the suffix at each sampled position by its first ``longest`` bytes at least; 0 elsewhere and past the end."""
    at = np.flatnonzero(_IN_COVER[np.arange(len(text)) % PERIOD])
    padded = np.append(eight, np.zeros(PERIOD, np.uint64))
    rank = np.zeros(len(text) + PERIOD + longest, np.int64)
    rank[at] = dense(*[padded[at + i] for i in range(0, PERIOD, 8)])
    width = PERIOD
    while width < longest:
        rank[at] = dense(rank[at], rank[np.minimum(at + width, len(text))])
        width *= 2
    return rank


def sort_suffixes(text: np.ndarray, starts: np.ndarray, buckets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, by bucket and then by content, and for each place in it whether its first ``longest`` bytes equal those before it in its bucket."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    eight = eights(text)
    padded = np.append(eight, np.zeros(longest + PERIOD, np.uint64))
    order = np.lexsort((padded[starts], buckets))
    group = np.zeros(n, np.int64)  # by place in the order; equal for what is still tied
    group[1:] = np.cumsum((buckets[order][1:] != buckets[order][:-1]) | (padded[starts[order]][1:] != padded[starts[order]][:-1]))
    for i in range(8, PERIOD, 8):
        tied = _tied(group)
        own, key = order[tied], padded[starts[order[tied]] + i]
        again = np.lexsort((key, group[tied]))
        order[tied], key = own[again], key[again]
        split = np.zeros(n, bool)
        split[tied[1:]] = (group[tied][1:] == group[tied][:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
    tied = _tied(group)
    if len(tied):
        rank = cover_ranks(text, eight, longest)
        active, key = tied, group[tied]
        while len(active):
            suffix = starts[order[active]]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            pivot = np.repeat(suffix[first + sizes // 2], sizes)
            shift = SHIFT[suffix % PERIOD, pivot % PERIOD]
            side = np.sign(rank[suffix + shift] - rank[pivot + shift])
            again = np.lexsort((side, key))
            order[active], side = order[active][again], side[again]
            part = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])))
            keep = (side != 0) & (np.bincount(part)[part] > 1)  # what equals the pivot is in place, and so is what stands alone
            active, key = active[keep], part[keep]
    same = np.zeros(n, bool)
    a, b = starts[order[1:]], starts[order[:-1]]
    same[1:] = buckets[order[1:]] == buckets[order[:-1]]
    live = np.flatnonzero(same[1:])
    for i in [*range(0, longest - 8, 8), longest - 8]:
        live = live[padded[a[live] + i] == padded[b[live] + i]]
    same[1:] = False
    same[live + 1] = True
    return order, same


def _tied(group: np.ndarray) -> np.ndarray:
    """Places whose group has another place."""
    like = np.zeros(len(group) + 1, bool)
    like[1:-1] = group[1:] == group[:-1]
    return np.flatnonzero(like[1:] | like[:-1])


def repeated_windows(text: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, width: int) -> np.ndarray:
    """For every window of every context, in order: does an earlier window of its bucket have the same ``width`` bytes?

    ``bounds`` are n + 1 offsets of contexts of at least ``width`` bytes; ``buckets`` the bucket of each.
    """
    counts = np.diff(bounds) - width + 1
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(bounds[:-1], counts) + within
    order, same = sort_suffixes(text, starts, np.repeat(buckets, counts), width)
    if not len(order):
        return np.zeros(0, bool)
    group = np.cumsum(~same) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(~same))
    out = np.empty(len(order), bool)
    out[order] = order > first[group]
    return out

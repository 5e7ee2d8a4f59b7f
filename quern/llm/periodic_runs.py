"""Periodic run detection: stretches of words that repeat with a period, by the method of Kolpakov and Kucherov.

1. Words of a run of exponent x occur x times in it, so a document is cut at the words that occur less often, again and again until nothing
   is left to cut: what remains are stretches whose every word occurs often enough, and every run lies in one of them, neighbours included.
2. A stretch's LZ factors (the longest that started earlier) are read off its suffix automaton.
3. Main's algorithm finds the runs that touch a factor's start: common prefixes and suffixes around it, within the factor and what a run can
   reach before it (twice the last factor and once this one).
4. All other runs lie strictly inside a factor, so they are copied from its earlier occurrence, by start.

Documents are worked off where they are: nothing is shuffled, and a task holds one document's words at a time.

Defined cases: null text has no words; white space is the blank and the bytes 9 to 13, so every other byte is part of a word; rows are judged each on its own, so
repeated rows give repeated results; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces

#: A run has LEAST words at least, and EXPONENT times its period.
LEAST, EXPONENT = 6, 4
RUNS_SCHEMA = "doc_id long, start long, length long, period long"
DIGEST_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"

Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def automaton(word: Sequence[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton, and where each state's words end for the first time."""
    steps: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for i, letter in enumerate(word):
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        first.append(i)
        link.append(0)
        at = last
        while at >= 0 and letter not in steps[at]:
            steps[at][letter] = new
            at = link[at]
        if at >= 0:
            to = steps[at][letter]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                twin = len(steps)
                steps.append(steps[to].copy())
                size.append(size[at] + 1)
                first.append(first[to])
                link.append(link[to])
                while at >= 0 and steps[at].get(letter) == to:
                    steps[at][letter] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return steps, first


def factors(word: Sequence[int]) -> list[tuple[int, int, int]]:
    """LZ factors as (start, length, start of an earlier occurrence or -1)."""
    steps, first = automaton(word)
    out, at, n = [], 0, len(word)
    while at < n:
        state, length = 0, 0
        while at + length < n:
            to = steps[state][word[at + length]]
            if first[to] >= at + length:
                break
            state, length = to, length + 1
        out.append((at, length, first[state] - length + 1) if length else (at, 1, -1))
        at += max(length, 1)
    return out


def prefixes(word: Sequence[int]) -> list[int]:
    """For each place, how many letters from there on are the word's first ones."""
    n = len(word)
    out = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def touching(word: list[int], low: int, at: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions in word[low:high] that hold the period's letters just before ``at`` or just from there on."""
    ahead, behind = high - at, at - low
    right = prefixes([*word[at:high], -1, *word[low:high]])
    left = prefixes([*reversed(word[low:at]), -1, *reversed(word[low:high])])
    for q in range(1, ahead + 1):
        more = right[q] if q < ahead else 0
        less = left[behind + 1 + ahead - q] if behind else 0
        if more + less >= q:
            yield at - less, at + q + more, q
    for q in range(1, behind + 1):
        more = right[ahead + 1 + behind - q] if ahead else 0
        less = left[q] if q < behind else 0
        if more + less >= q:
            yield at - q - less, at + more, q


def runs_of(word: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """Runs of ``least`` letters and ``exponent`` periods (2 or more) at least, by start and period."""
    n = len(word)
    ends: dict[int, dict[int, int]] = {}  # start -> end -> smallest period

    def add(start: int, end: int, period: int) -> None:
        known = ends.setdefault(start, {})
        known[end] = min(period, known.get(end, period))

    before = 0
    for at, length, source in [*factors(word), (n, 0, -1)]:
        for s, e, q in touching(word, max(0, at - 2 * before - length), at, at + length):
            if e - s >= max(least, exponent * q) and (s == 0 or word[s - 1] != word[s - 1 + q]) and (e == n or word[e] != word[e - q]):
                add(s, e, q)
        if source >= 0 and ends:
            for s in range(source + 1, source + length):
                for e, q in list(ends.get(s, {}).items()):
                    if e < source + length:
                        add(s + at - source, e + at - source, q)
        before = length
    return sorted((s, e - s, q) for s, found in ends.items() for e, q in found.items())


def stretches(words: list[bytes], least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts, of ``least`` words or more, whose every word occurs ``times`` times or more in the part."""
    open_ = [(0, len(words))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        part = words[a:b]
        counts = Counter(part)
        cuts = [i for i, w in enumerate(part, a) if counts[w] < times]
        if not cuts:
            yield a, b
            continue
        open_ += [(x + 1, y) for x, y in zip([a - 1, *cuts], [*cuts, b]) if y - x > least]


def word_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """A document's runs, by start and period."""
    out = []
    for a, b in stretches(words, least, exponent):
        names: dict[bytes, int] = {}
        letters = [names.setdefault(w, len(names)) for w in words[a:b]]
        out += [(s + a, n, q) for s, n, q in runs_of(letters, least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: Iterable[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:a] if a > at else []
        at = max(at, b)
    return out + words[at:] if at else words


def _documents(piece: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[tuple[int | None, list[bytes]]]:
    for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.large_binary())):
        words = (text.as_py() or b"").split()
        yield doc_id, rewrite(doc_id, words) if rewrite else words


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row a run: doc_id, start (word number), length, period."""
    if least < 1 or exponent < 2:
        raise ValueError("least is 1 or more, exponent 2 or more")

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(doc_id, *run) for doc_id, words in _documents(piece, None) for run in word_runs(words, least, exponent)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 4)], ["doc_id", "start", "length", "period"])

    return map_pieces(_rows(docs), "text", step, RUNS_SCHEMA)


def without_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id and the text with each run cut to its first period, words joined by one blank."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = [b" ".join(collapsed(words, word_runs(words, least, exponent))) for _, words in _documents(piece, None)]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return map_pieces(_rows(docs), "text", step, "doc_id long, text string")


def run_digest(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per input row: the number of runs, the longest one, and digests of all runs and of the collapsed words. ``rewrite`` may change a document's words first."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, words in _documents(piece, rewrite):
            runs = word_runs(words, least, exponent)
            kept = collapsed(words, runs)
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            rows.append((doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept)))
        names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*rows))], names)

    return map_pieces(_rows(docs), "text", step, DIGEST_SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The test's rewriting: with h the CRC-32 of the id, every tenth document repeats a stretch from one of its words on to its end. Null ids are left alone."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]

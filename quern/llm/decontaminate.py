"""Benchmark decontamination: windows of test words are looked up in documents by hash, verified, counted and cut out.

A window is 10 consecutive words of an item; an item of fewer words (not none) is one window of all of them. The
windows' hashes are broadcast while there are at most ``MAX_BROADCAST_WINDOWS`` of them (16 MB of hashes and their words); beyond that
the windows of documents are joined to those of items by a shuffle (:func:`joined_hits`, :func:`joined_cuts`), with the same rows. Before that shuffle each task
drops what isn't in a table of ``FILTER_BITS`` bits of the items' window hashes (4 MB, however many windows there are); the join compares words.

Defined cases: null and empty texts have no words; an empty benchmark hits nothing; repeated rows come out as often as
they go in; items that share words are each counted; an item without an id hits, but is not counted; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, map_pieces, utf8

WINDOW = 10
#: A window's hash and words take some 300 bytes in each Python worker.
MAX_BROADCAST_WINDOWS = 200_000
FILTER_BITS = 1 << 25

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (k, words, item_id) of all items; a row for each window."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = tc.words(*utf8(piece.column("text")))
        ks, texts, items = [], [], []
        for name, a, b in zip(piece.column("item_id").to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist()):
            k = min(WINDOW, b - a)
            for i in range(a, b - k + 1) if k else ():
                ks.append(k)
                texts.append(found.text(i, k))
                items.append(name)
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(texts, pa.binary()), pa.array(items, pa.string())], ["k", "words", "item_id"])

    read = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_pieces(read, "text", step, "k int, words binary, item_id string").distinct()


class Windows:
    """The broadcast side: for each length a hash set, and the items by the exact words."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[str]] = {}
        by_k: dict[int, list[bytes]] = defaultdict(list)
        for k, text, item in rows:
            text = bytes(text)
            if text not in self.items:
                by_k[k].append(text)
                self.items[text] = []
            if item is not None:
                self.items[text].append(item)
        self.sets = {k: tc.HashSet(hashes_of(texts, k)) for k, texts in by_k.items()}

    def hits(self, found: tc.Words) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Verified places, their lengths in words, and the items."""
        hashes = found.hashes()
        at, length, items = [], [], []
        for k, wanted in self.sets.items():
            places = wanted.places(tc.gram_hashes(hashes, k))
            places = places[tc.inside_one(found, places, k)]
            for i in places.tolist():
                if (who := self.items.get(found.text(i, k))) is not None:
                    at.append(i)
                    length.append(k)
                    items.append(who)
        return np.array(at, np.int64), np.array(length, np.int64), items


def hashes_of(texts: list[bytes], k: int) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = tc.words(data, np.cumsum([0, *map(len, texts)]))
    return tc.gram_hashes(found.hashes(), k)[found.first[:-1]]


def covered(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in a hit."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:-1]) > 0


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def bounded_windows(benchmark: DataFrame, most: int = MAX_BROADCAST_WINDOWS):
    """(broadcast Windows, None) or, where there are more than ``most``, (None, their table)."""
    found = item_windows(benchmark)
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        return None, checkpointed(found)
    return benchmark.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in rows])), None


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per input row: how many of its words are hit, and by which items."""
    shared, many = bounded_windows(benchmark, most)
    if shared is None:
        return joined_hits(docs, many)

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = tc.words(*utf8(piece.column("text")))
        at, length, items = shared.value.hits(found)
        hit = np.add.reduceat(np.append(covered(len(found.starts), at, length), False).astype(np.int64), np.minimum(found.first[:-1], len(found.starts))) if piece.num_rows else np.zeros(0, np.int64)
        hit[found.counts() == 0] = 0
        who: dict[int, set[str]] = defaultdict(set)
        for d, names in zip((np.searchsorted(found.first, at, side="right") - 1).tolist(), items):
            who[d].update(names)
        none = digest(set())
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"), pa.array(found.counts(), pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(who[d]) if d in who else 0 for d in range(piece.num_rows)], pa.int64()),
                pa.array([digest(who[d]) if d in who else none for d in range(piece.num_rows)], pa.string()), pa.array(hit > 0),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return map_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", step, HITS)


def joined_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows where the windows are too many to broadcast: each distinct text's windows meet item windows in a shuffle join."""

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = tc.words(*utf8(piece.column("text")))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(found.counts(), pa.int64())], ["doc_id", "text_key", "n_words"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("string").alias("text")).withColumn("text_key", key_of("text"))
    sizes = map_pieces(read, "text", count, "doc_id long, text_key string, n_words long")
    hits = checkpointed(spelt_places(read.select("text_key", "text").dropDuplicates(["text_key"]), windows).join(windows, ["k", "words"]).select("text_key", "at", "k", "item_id"))
    places = hits.select("text_key", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("word")).distinct().groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.groupBy("text_key").agg(F.collect_set("item_id").alias("items"))
    out = sizes.join(places.join(items, "text_key"), "text_key", "left")
    n_hit, who = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(who).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(who), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut_once(found: tc.Words, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> str:
    """One text (and its words) without the words at these places, a line break instead of each span."""
    hit = covered(len(found.starts), at, length)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    parts, last = [], 0
    for a, b in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()):
        parts.append(data[last : found.starts[a]].tobytes())
        last = int(found.ends[b])
    parts.append(data[last:].tobytes())
    return b"\n".join(parts).decode("utf-8", "replace")


def words_of(text: str) -> tuple[np.ndarray, tc.Words]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, tc.words(data, np.array([0, len(data)]))


def cut_words(text: str, windows: Windows) -> str:
    """The text without its hit words, a line break in their place; again until nothing is hit, as a cut joins what stood apart."""
    while True:
        data, found = words_of(text)
        at, length, _ = windows.hits(found)
        if not len(at):
            return text
        text = cut_once(found, data, at, length)


def decontaminated(docs: DataFrame, benchmark: DataFrame, most: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with hit spans removed and n_chars set anew; documents with no word left go. All columns stay."""
    shared, many = bounded_windows(benchmark, most)
    if shared is None:
        return joined_cuts(docs, many)
    names = docs.columns

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = tc.words(*utf8(piece.column("text")))
        at, _, _ = shared.value.hits(found)
        if not len(at):
            return piece
        texts, keep = piece.column("text").to_pylist(), np.ones(piece.num_rows, bool)
        for d in np.unique(np.searchsorted(found.first, at, side="right") - 1).tolist():
            texts[d] = cut_words(texts[d], shared.value)
            keep[d] = len(words_of(texts[d])[1].starts) > 0
        cols = [piece.column(c) for c in names]
        cols[names.index("text")] = pa.array(texts, piece.column("text").type)
        if "n_chars" in names:
            n = names.index("n_chars")
            cols[n] = pa.array([x if x is None or t is None else len(t) for t, x in zip(texts, cols[n].to_pylist())], cols[n].type)
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return map_pieces(docs, "text", step, docs.schema)


def filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit for every value of the upper bits of a hash: set for those of the windows. Bits are gathered as words, at most FILTER_BITS / 64 rows."""

    def window_hash(piece: pa.RecordBatch) -> pa.RecordBatch:
        ks = piece.column("k").to_numpy(zero_copy_only=False)
        texts, grams = piece.column("words").to_pylist(), np.zeros(piece.num_rows, np.uint64)
        for k in np.unique(ks).tolist():
            own = np.flatnonzero(ks == k)
            grams[own] = hashes_of([texts[i] for i in own.tolist()], k)
        return pa.RecordBatch.from_arrays([pa.array(bit_of(grams))], ["bit"])

    words = map_pieces(windows.select("k", "words"), "words", window_hash, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    found, out = words.toArrow(), np.zeros(FILTER_BITS >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def bit_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def spelt_places(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(text_key, at, k, words) of the windows of the texts (text_key, text) that may be some item's; to be joined by k and words."""
    lengths = sorted(r[0] for r in windows.select("k").distinct().limit(WINDOW + 1).collect())
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(filter_bits(windows)))

    def spell(piece: pa.RecordBatch) -> pa.RecordBatch:
        found, table = tc.words(*utf8(piece.column("text"))), shared.value
        hashes, rows, ats, ks, words = found.hashes(), [], [], [], []
        for k in lengths:
            own = bit_of(tc.gram_hashes(hashes, k))
            at = np.flatnonzero(table[own >> 3] >> (7 - (own & 7)).astype(np.uint8) & 1)
            at = at[tc.inside_one(found, at, k)] if len(at) else at
            row = np.searchsorted(found.first, at, side="right") - 1
            rows.append(row)
            ats.append(at - found.first[row])
            ks.append(np.full(len(at), k, np.int32))
            words += [found.text(i, k) for i in at.tolist()]
        flat = lambda x, t: pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))
        return pa.RecordBatch.from_arrays([piece.column("text_key").take(flat(rows, np.int64)), flat(ats, np.int64), flat(ks, np.int32), pa.array(words, pa.binary())], ["text_key", "at", "k", "words"])

    return map_pieces(texts, "text", spell, "text_key string, at long, k int, words binary")


def joined_places(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(text_key, at: [(word, k)]) of the texts (text_key, text) that hold a window."""
    return spelt_places(texts, windows).join(windows.select("k", "words").distinct(), ["k", "words"], "left_semi").groupBy("text_key").agg(F.collect_list(F.struct("at", "k")).alias("at"))


def key_of(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def joined_cuts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """What :func:`decontaminated` gives, where the windows are too many to broadcast.

    Each distinct text is cut at its hit places; what was cut is looked up again until nothing is hit. ``text_key`` is that of the text as it came in.
    """

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, places in zip(piece.column("text").to_pylist(), piece.column("at").to_pylist()):
            data, found = words_of(text)
            texts.append(cut_once(found, data, np.array([x["at"] for x in places], np.int64), np.array([x["k"] for x in places], np.int64)))
        left = [len(words_of(t)[1].starts) > 0 for t in texts]
        return pa.RecordBatch.from_arrays([piece.column("text_key"), pa.array(texts, pa.string()), pa.array(left)], ["text_key", "text", "left"])

    now = docs.where(F.col("text").isNotNull()).select(key_of("text").alias("text_key"), F.col("text").cast("string").alias("text")).dropDuplicates(["text_key"])
    rounds: list[DataFrame] = []
    while True:
        hit = now.select("text_key", "text").join(joined_places(now.select("text_key", "text"), windows), "text_key")
        now = checkpointed(map_pieces(hit, "text", cut, "text_key string, text string, left boolean"))
        if now.isEmpty():
            break
        rounds.append(now.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return docs
    last = reduce(DataFrame.unionByName, rounds).groupBy("text_key").agg(F.max_by(F.struct("text", "left"), "round").alias("cut")).alias("cut")
    both = docs.alias("docs").join(last, key_of("docs.text") == F.col("cut.text_key"), "left").where(F.coalesce(F.col("cut.cut.left"), F.lit(True)))
    text = F.coalesce(F.col("cut.cut.text"), F.col("docs.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.col("docs.n_chars")
        new["n_chars"] = F.when(F.col("cut.cut.text").isNotNull() & n_chars.isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return both.select(*(new[c].alias(c) if c in new else F.col(f"docs.`{c}`") for c in docs.columns))

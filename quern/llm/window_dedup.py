"""Substring dedup by level-wise doubling: words in a window that also starts in a document with a smaller id are removed.

1. Every window of ``width`` words has an anchor, its ``GRAM``-word gram of least hash; consecutive windows with one anchor are a span. Equal windows have equal anchors at equal
   places, so a gram that no other document has rules its windows out.
2. Only what repeats at one length is looked at with twice that length: 4 words, 8, ... as long as windows of that length around the anchor fit into every window on one side of it.
   The loop ends early when nothing survives.
3. At full length the surviving spans are compared whole first; windows of a span that is the earliest of its kind are then compared one by one.
4. What is removed is cut out of the documents.

A round at one length: texts lie in a bucketed table, in pieces of some ``PIECE_BYTES``. A task computes a piece's distinct hashes and deals them, sorted and packed (some 3 bytes each), by hash range;
the task of a range sends one bit a hash back to its piece. So a round shuffles neither texts nor a row for each window, and a gram that every document has is one entry a piece.
Each task works the earlier rounds out again from the bits. Hashes of the first rounds are cut short: a false repetition just goes on to the next length. At full length they have 96 bits and all 96 are compared; no
words are compared after that (two different ones of 10^12 windows agree with a chance below 10^-4).

Defined cases: null text has no words; documents of fewer words than a window lose nothing; a null doc_id comes after all others, and rows of one doc_id (repeated rows, nulls) never remove each
other's words; each row comes out; other columns are ignored, whatever their names; an empty table gives an empty result. A piece holds at least one whole text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import dropped, pieces, shared_folder, utf8

WIDTH, GRAM = 13, 4
#: Text of a piece, and the part of it that is hashed at once; text for each hash range and for each bucket of the table.
PIECE_BYTES, HASH_BYTES, RANGE_BYTES, BUCKET_BYTES = 4 << 20, 1 << 20, 16 << 20, 64 << 20
#: Bits of a hash, beyond those that count the text's bytes, in the rounds before the last two.
SPARE_BITS = 10
LAST_ID = 2**63 - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
OTHER_BASE = 0xD1342543DE82EF95
INVERSES = {tc.BASE: tc.INVERSE, OTHER_BASE: pow(OTHER_BASE, -1, 2**64)}
_PIECES = "piece long, ids array<long>, bounds array<long>, packed binary"
_PARTS = "range int, piece long, n int, multi binary, h1 binary, h2 binary, docs binary"
_FLAGS = "piece long, round int, range int, bits binary"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def lengths_of(width: int, gram: int) -> list[int]:
    """gram, twice that, and so on, while a window holds that many words to the right of its anchor's start or to the left of its end."""
    out = [gram]
    while 4 * out[-1] <= width + gram + 1:
        out.append(2 * out[-1])
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive documents, and n + 1 places of the documents among them; some HASH_BYTES of whole documents at once."""
    found, counts = [np.zeros(0, np.uint64)], []
    part = (bounds[1:] - 1) // HASH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(bounds) - 1]
    for a, b in zip(cuts, cuts[1:]):
        text, edges = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = ~SPACE[text]
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        inner = edges[(edges > 0) & (edges < len(text))]
        opens[inner] |= inside[1:-1][inner]
        closes[inner - 1] |= inside[1:-1][inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        found.append(tc.span_hash(tc.prefix_hash(text), starts, ends))
        counts.append(np.diff(np.searchsorted(starts, edges)))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """n + 1 prefix sums of values times powers of ``base``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * tc.power_at(base, np.arange(len(values))), out=out[1:])
    return out


def hashed(prefix: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return tc.mix((prefix[ends] - prefix[starts]) * tc.power_at(INVERSES[base], starts))


@dataclass
class Spans:
    """Runs of ``count`` windows from ``start`` on, whose anchor is at ``at``, of the document number ``owner``."""

    at: np.ndarray
    start: np.ndarray
    count: np.ndarray
    owner: np.ndarray

    def where(self, mask: np.ndarray) -> Spans:
        return Spans(self.at[mask], self.start[mask], self.count[mask], self.owner[mask])


def anchored(grams: np.ndarray, first: np.ndarray, width: int, gram: int) -> Spans:
    """All windows of the documents, as spans. ``grams`` are the hashes of the gram at each word."""
    n_windows, reach = int(first[-1]) - width + 1, width - gram + 1
    if n_windows <= 0:
        return Spans(*(np.zeros(0, np.int64),) * 4)
    low = np.uint64((1 << 28) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # least hash, then leftmost
    table = np.full(-(-len(keys) // reach) * reach, ~np.uint64(0))
    table[: len(keys)] = keys
    table = table.reshape(-1, reach)
    ahead, back = np.minimum.accumulate(table, axis=1).ravel(), np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n_windows], ahead[reach - 1 : reach - 1 + n_windows]) & low).astype(np.int64)
    owner = np.searchsorted(first, np.arange(n_windows), side="right") - 1
    window = np.flatnonzero(np.arange(n_windows) + width <= first[owner + 1])
    if not len(window):
        return Spans(*(np.zeros(0, np.int64),) * 4)
    at, owner = anchor[window], owner[window]
    opens = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    return Spans(at[opens], window[opens], np.diff(np.append(opens, len(window))), owner[opens])


def by_side(spans: Spans, length: int, width: int, gram: int) -> tuple[Spans, np.ndarray]:
    """Spans cut where their windows stop to hold ``length`` words from the anchor's start on, and the start of what each one's windows hold: those, or as many up to the anchor's end."""
    right = np.clip(spans.at + length - width, spans.start, spans.start + spans.count)  # first window on the right side
    left = Spans(spans.at, spans.start, right - spans.start, spans.owner)
    rest = Spans(spans.at, right, spans.start + spans.count - right, spans.owner)
    l, r = left.count > 0, rest.count > 0
    both = Spans(*(np.concatenate((getattr(left, c)[l], getattr(rest, c)[r])) for c in ("at", "start", "count", "owner")))
    return both, np.concatenate((spans.at[l] + gram - length, spans.at[r]))


class Piece:
    """One piece's words, and the rounds on them."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, width: int, gram: int, n_ranges: int, bits: int):
        self.docs, self.width, self.gram, self.n_ranges, self.bits = ids, width, gram, n_ranges, bits
        words, self.first = word_hashes(data, bounds)
        self.one = sums(tc.mix(words), tc.BASE)
        self.two = sums(tc.mix(words ^ np.uint64(0x5851F42D4C957F2D)), OTHER_BASE)
        at = np.arange(max(len(words) - gram + 1, 0))
        self.lengths = lengths_of(width, gram)
        self.spans = anchored(hashed(self.one, tc.BASE, at, at + gram), self.first, width, gram)
        self.gone = np.zeros(len(words) + 1, np.int64)  # changes of the number of removed windows over a word
        self.round = -1

    def begin(self) -> None:
        """Next round: what it asks about, as distinct sorted hashes with their least document, and which of these each candidate has."""
        self.round += 1
        self.full = self.round >= len(self.lengths)
        if not self.full:
            length = self.lengths[self.round]
            self.spans, starts = by_side(self.spans, length, self.width, self.gram)
            ends = starts + length
        else:
            if self.round > len(self.lengths):  # windows of the spans that are left
                n = self.spans.count
                self.spans = Spans(np.repeat(self.spans.at, n), np.repeat(self.spans.start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.ones(int(n.sum()), np.int64), np.repeat(self.spans.owner, n))
            starts = self.spans.start
            ends = starts + self.spans.count - 1 + self.width
        h1, doc = hashed(self.one, tc.BASE, starts, ends), self.docs[self.spans.owner]
        h2 = hashed(self.two, OTHER_BASE, starts, ends) >> np.uint64(32) if self.full else np.zeros(len(h1), np.uint64)
        if not self.full:
            h1 &= ~np.uint64((1 << (64 - self.bits)) - 1)
        order = np.lexsort((doc, h2, h1))
        a, b, d = h1[order], h2[order], doc[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        self.entry = np.zeros(len(a), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        at = np.flatnonzero(fresh)
        self.h1, self.h2, self.least = a[at], b[at], d[at]
        self.several = d[np.append(at[1:], len(d)) - 1] != self.least if len(at) else np.zeros(0, bool)
        self.cuts = np.searchsorted((self.h1 >> np.uint64(32)) * np.uint64(self.n_ranges) >> np.uint64(32), np.arange(self.n_ranges + 1))

    def end(self, flags: dict[int, bytes]) -> None:
        """Take the round's answers: bits of each hash range."""
        said = np.zeros(len(self.h1), bool)
        for number, bits in flags.items():
            a, b = self.cuts[number], self.cuts[number + 1]
            said[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
        if not self.full:
            self.spans = self.spans.where(said[self.entry])
            return
        gone = said[self.entry] | (self.docs[self.spans.owner] > self.least[self.entry])
        lost = self.spans.where(gone)
        np.add.at(self.gone, lost.start, 1)
        np.add.at(self.gone, lost.start + lost.count - 1 + self.width, -1)
        self.spans = self.spans.where(~gone)

    def parts(self, piece: int) -> pa.RecordBatch:
        """The round's hashes, packed by range."""
        rows = []
        for number in np.flatnonzero(np.diff(self.cuts)).tolist():
            a, b = self.cuts[number], self.cuts[number + 1]
            h1 = packed(np.diff(self.h1[a:b], prepend=np.uint64(0)) >> np.uint64(0 if self.full else 64 - self.bits))
            more = (self.h2[a:b].astype(np.uint32).tobytes(), packed(self.least[a:b])) if self.full else (None, None)
            rows.append((number, piece, int(b - a), np.packbits(self.several[a:b]).tobytes(), h1, *more))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 7, _PART_TYPES)], _PART_NAMES)


_PART_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_PART_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T).view(kind).ravel()


def answers(rows: list[dict], number: int, bits: int, full: bool) -> Iterator[tuple[int, bytes]]:
    """(piece, bits) of one hash range: whether another document has the hash; at full length, whether one with a smaller id than any of the piece's has it."""
    h1 = np.concatenate([np.cumsum(unpacked(r["h1"], np.uint64) << np.uint64(0 if full else 64 - bits), dtype=np.uint64) for r in rows])
    h2 = np.concatenate([np.frombuffer(r["h2"], np.uint32) for r in rows]) if full else np.zeros(len(h1), np.uint32)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(a))))
    said = np.zeros(len(a), bool)
    if full:
        docs = np.concatenate([unpacked(r["docs"], np.int64) for r in rows])
        said[order] = np.minimum.reduceat(docs[order], heads)[group] < docs[order]
    else:
        several = np.concatenate([np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=r["n"]).astype(bool) for r in rows])
        said[order] = ((np.diff(np.append(heads, len(a))) > 1) | np.logical_or.reduceat(several[order], heads))[group]
    at = 0
    for r in rows:
        mine = said[at : at + r["n"]]
        at += r["n"]
        if mine.any():
            yield r["piece"], np.packbits(mine).tobytes()


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze, n = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            data, bounds = utf8(part.column("text"))
            ids, edges = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column("doc_id"), pa.array(bounds)))
            yield pa.RecordBatch.from_arrays([pa.array([n]), ids, edges, pa.array([squeeze(data)], pa.binary())], ["piece", "ids", "bounds", "packed"])
            n += 1


def _opened(batches: Iterable[pa.RecordBatch], width: int, gram: int, n_ranges: int, bits: int, rounds: int) -> Iterator[tuple[int, pa.Array, bytes, np.ndarray, Piece]]:
    """Pieces after ``rounds`` rounds."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, bounds = batch.column("ids")[i].values, batch.column("bounds")[i].values.to_numpy()
            data = zstandard.ZstdDecompressor().decompress(batch.column("packed")[i].as_py())
            piece = Piece(pc.fill_null(ids, LAST_ID).to_numpy(), np.frombuffer(data, np.uint8), bounds, width, gram, n_ranges, bits)
            flags: list[dict[int, bytes]] = [{} for _ in range(rounds)]
            for x in batch.column("flags")[i].as_py() or ():
                flags[x["round"]][x["range"]] = x["bits"]
            for said in flags:
                piece.begin()
                piece.end(said)
            yield batch.column("piece")[i].as_py(), ids, data, bounds, piece


def _deduplicated(docs: DataFrame, width: int, gram: int, finish, schema: str) -> DataFrame:
    """``finish`` (ids, texts' bytes, bounds, removed words, places of documents among the words) makes the result of a piece; it is written before the pieces go."""
    if not 1 <= gram <= width:
        raise ValueError("gram is 1 to width")
    spark, folder, name = docs.sparkSession, shared_folder(docs.sparkSession), f"quern_{uuid.uuid4().hex}"
    result = shared_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    how = (width, gram, max(16, size // RANGE_BYTES), min(64, size.bit_length() + SPARE_BITS))
    rows.mapInArrow(_pieces, _PIECES).repartition(buckets, "piece").write.bucketBy(buckets, "piece").sortBy("piece").option("compression", "none").saveAsTable(name)

    def with_flags(rounds: int, kind: str) -> DataFrame:
        table = spark.table(name)
        if not rounds:
            return table.withColumn("flags", F.lit(None).cast("array<struct<round:int,range:int,bits:binary>>"))
        flags = spark.read.schema(_FLAGS).parquet(*(f"{folder}/{n}" for n in range(rounds)))
        flags = flags.groupBy("piece").agg(F.collect_list(F.struct("round", "range", "bits")).alias("flags"), F.max("round").alias("last"))
        if kind == "inner":  # a piece has to have something left from the last round of shorter windows
            flags = flags.where(F.col("last") >= min(rounds, len(lengths)) - 1)
        return table.join(flags.drop("last"), "piece", kind)

    def ask(rounds: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, _, _, _, piece in _opened(batches, *how, rounds):
                piece.begin()
                yield piece.parts(number)

        return run

    def reply(rounds: int):
        def closed(rows: list[dict]) -> pa.RecordBatch:
            found = list(answers(rows, rows[0]["range"], how[3], rounds >= len(lengths)))
            cols = [[p for p, _ in found], [rounds] * len(found), [rows[0]["range"]] * len(found), [b for _, b in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["piece", "round", "range", "bits"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and row["range"] != held[0]["range"]:
                        yield closed(held)
                        held = []
                    held.append(row)
            if held:
                yield closed(held)

        return run

    lengths = lengths_of(width, gram)
    rounds = 0
    while rounds < len(lengths) + 2:
        parts = with_flags(rounds, "inner").select("piece", "ids", "bounds", "packed", "flags").mapInArrow(ask(rounds), _PARTS)
        parts.repartition("range").sortWithinPartitions("range", "piece").mapInArrow(reply(rounds), _FLAGS).write.parquet(f"{folder}/{rounds}")
        rounds += 1
        if rounds <= len(lengths) and spark.read.schema(_FLAGS).parquet(f"{folder}/{rounds - 1}").isEmpty():
            break

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, data, bounds, piece in _opened(batches, *how, rounds):
            yield finish(ids, data, bounds, np.cumsum(piece.gone[:-1]) > 0, piece.first)

    with_flags(rounds, "left").select("piece", "ids", "bounds", "packed", "flags").mapInArrow(last, schema).write.parquet(result)
    spark.sql(f"DROP TABLE {name}")
    dropped(spark, folder)
    return spark.read.schema(schema).parquet(result)


def _kept(data: bytes, bounds: np.ndarray, gone: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Words, removed words, and the kept ones joined, of each document."""
    lost = np.concatenate(([0], np.cumsum(gone)))[first]
    for d in range(len(bounds) - 1):
        words = data[bounds[d] : bounds[d + 1]].split()
        n = int(lost[d + 1] - lost[d])
        if n:
            words = [w for w, out in zip(words, gone[first[d] : first[d + 1]].tolist()) if not out]
        yield len(words) + n, n, b" ".join(words)


def window_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a blank)."""

    def finish(ids, data, bounds, gone, first) -> pa.RecordBatch:
        rows = [(n, out, hashlib.sha256(text).hexdigest()) for n, out, text in _kept(data, bounds, gone, first)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _deduplicated(docs, width, gram, finish, SCHEMA)


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id and the kept words of each row, joined by a blank."""

    def finish(ids, data, bounds, gone, first) -> pa.RecordBatch:
        texts = [text for _, _, text in _kept(data, bounds, gone, first)]
        return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return _deduplicated(docs, width, gram, finish, "doc_id long, text string")

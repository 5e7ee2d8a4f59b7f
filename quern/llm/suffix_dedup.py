"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

1. Anchors. Every 100-byte window has one anchor, its 32-byte gram of least hash. Consecutive windows share an anchor
   and make one span. A task emits one row a span, about one for 32 bytes: hash of the gram, hash of the span. Spans that repeat
   within the task go no further than that task (pre-aggregation, bytes compared on the spot): only its earliest stays. A long text is worked off in
   overlapping parts.
2. Equal windows have equal grams at equal places, so windows are compared within a gram's rows only. Rows sorted by
   (gram, span, document, place) stream past: a span seen before is to be removed whole; if a gram has several distinct spans,
   the earliest of each is looked at byte by byte.
3. Those spans' contexts are cut out of the texts and dealt into buckets by the gram with 34 or 35 bytes on the side that
   all its windows hold. A task takes whole buckets, up to ``BLOCK_BYTES`` at a time, and sorts their suffixes by
   difference-cover blockwise construction (:mod:`suffix_blocks`).
   Buckets are counted first: one of over ``MAX_BUCKET`` contexts is not gathered; its windows go on from where they are as 128-bit BLAKE2b digests, of
   which a grouped minimum keeps the earliest. Windows of such a bucket alone are removed on a digest's word.
4. Whole spans that are to go are claims: this document's bytes, merged to runs and cut at every ``SEGMENT`` bytes of the source's text, equal the source's.
   Distinct claims (a passage of a million copies makes a few) are compared with the source's bytes; no claim is taken on a hash's word. Where one
   does not hold, different spans have one hash: all claims on those bytes of that source, and the source's own span, go through step 3 instead.
5. Removed runs are merged a document, and what remains is hashed.

Order of documents is by doc_id (null last), and where a doc_id has several texts by the texts' hashes.

Defined cases: null text is empty; texts under 100 bytes lose nothing; repeated rows (same doc_id and text) are one document,
and each comes out; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import small

from . import textcore as tc
from .common import checkpointed, dropped, map_pieces, shared_folder, utf8
from .suffix_blocks import repeated_windows

WIDTH, GRAM = 100, 32
WINDOWS = WIDTH - GRAM + 1
#: A window whose gram starts up to so many bytes in holds WIDTH - GRAM - HALF bytes after it; any other holds HALF + 1 before it.
HALF = (WIDTH - GRAM) // 2
#: Text that a task takes at once, and so the reach of its pre-aggregation.
PIECE_BYTES = 1 << 20
BLOCK_BYTES, MAX_BUCKET = 1 << 20, 8192
SEGMENT = 256
#: Of a span's 64-bit hash; its number of windows and its gram's place take the other 14.
SPAN_BITS = 50
LAST_ID = 2**63 - 1

_SPANS = "gram long, span long, doc long, alt long, at int, n int"
#: Kind 0: removed bytes (at, n), the gram's place from there, and the place in the source (sat, -1 if bytes have been compared); kind 1: a span to look at (at, windows).
_RUNS = "kind int, doc long, alt long, at int, n int, inner int, sdoc long, salt long, sat int"
#: Kind 0: a claim on the bytes of doc, alt; kind 1: a context of a bucket.
_CUT = "kind int, bucket long, doc long, alt long, at int, bytes binary"
_FOUND = "kind int, doc long, alt long, at int, n int, h1 long, h2 long"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, span hash, document, first window, windows, place of the gram from the first window) of every span."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    n_windows = len(data) - WIDTH + 1
    if n_windows <= 0:
        return none
    prefix = tc.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    hashes = tc.span_hash(prefix, at, at + GRAM)
    low = np.uint64((1 << 28) - 1)
    keys = (hashes & ~low) | at.astype(np.uint64)  # least hash, then leftmost
    rows = -(-len(keys) // WINDOWS)
    table = np.full(rows * WINDOWS, ~np.uint64(0))
    table[: len(keys)] = keys
    table = table.reshape(rows, WINDOWS)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n_windows], ahead[WINDOWS - 1 : WINDOWS - 1 + n_windows]) & low).astype(np.int64)
    whole = np.zeros(n_windows + 1, np.int64)
    long = np.diff(bounds) >= WIDTH
    np.add.at(whole, bounds[:-1][long], 1)
    np.add.at(whole, bounds[1:][long] - WIDTH + 1, -1)
    window = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(window):
        return none
    owner = np.searchsorted(bounds, window, side="right") - 1
    gram = anchor[window]
    opens = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])))
    first, count = window[opens], np.diff(np.append(opens, len(window)))
    span = tc.span_hash(prefix, first, first + count - 1 + WIDTH)
    return hashes[gram[opens]], span, owner[opens], first - bounds[owner[opens]], count, gram[opens] - first


def spans_by_parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """:func:`spans_of`, with texts of over PIECE_BYTES taken in parts whose windows follow on each other; a span ends with its part."""
    long = np.flatnonzero(np.diff(bounds) > PIECE_BYTES)
    if not len(long):
        return spans_of(data, bounds)
    found, last = [], 0
    for d in [*long.tolist(), len(bounds) - 1]:
        if d > last:
            few = spans_of(data[bounds[last] : bounds[d]], bounds[last : d + 1] - bounds[last])
            found.append((*few[:2], few[2] + last, *few[3:]))
        if d < len(bounds) - 1:
            for a in range(int(bounds[d]), int(bounds[d + 1]) - WIDTH + 1, PIECE_BYTES):
                part = data[a : min(a + PIECE_BYTES + WIDTH - 1, int(bounds[d + 1]))]
                few = spans_of(part, np.array([0, len(part)]))
                found.append((*few[:2], few[2] + d, few[3] + a - int(bounds[d]), *few[4:]))
        last = d + 1
    return tuple(np.concatenate(c) for c in zip(*found))


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a : a + n] is other than data[b : b + n], for each of them; each n is 8 at least."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    eight = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data).data, 0, (1,))
    for i in range(0, int(n.max()), 8):
        live = np.flatnonzero(n > i)
        step = np.minimum(i, n[live] - 8)
        out[live] |= eight[a[live] + step] != eight[b[live] + step]
    return out


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) runs, sorted, with those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def span_rows(rows: DataFrame, bits: int = SPAN_BITS) -> DataFrame:
    """Spans, each task's repeats left out; those come as rows of gram = their document, span = -1 and the removed bytes at, n. ``bits`` of a span's hash are kept."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = utf8(piece.column("text"))
        gram, span, owner, first, count, inner = spans_by_parts(data, bounds)
        doc, alt = piece.column("doc").to_numpy()[owner], piece.column("alt").to_numpy()[owner]
        packed = ((span >> np.uint64(64 - bits)) << np.uint64(14)) | (count << 7 | inner).astype(np.uint64)
        order = np.lexsort((first, alt, doc, packed, gram))
        g, s, d, a, f, c = (x[order] for x in (gram, packed, doc, alt, first, count))
        again = np.append(False, (g[1:] == g[:-1]) & (s[1:] == s[:-1])) if len(g) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(g)))) if len(g) else np.zeros(0, np.int64)
        place = (bounds[owner] + first)[order]
        again[again] = ~differing(data, place[again], place[head[again]], (c + WIDTH - 1)[again])  # of one hash, yet different: goes on as it is
        other = again & ((d != d[head]) | (a != a[head]) | (f != f[head]))  # else a repeated row's
        by_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for key_d, key_a, x, y in zip(d[other].tolist(), a[other].tolist(), f[other].tolist(), (f + c - 1 + WIDTH)[other].tolist()):
            by_doc.setdefault((key_d, key_a), []).append((x, y))
        gone = [(x, y, p, q - p) for (x, y), found in by_doc.items() for p, q in merged(found)]
        gone = np.array(gone, np.int64).reshape(-1, 4)
        stay = ~again
        cols = [
            np.concatenate((g[stay].view(np.int64), tc.mix(gone[:, 0].view(np.uint64)).view(np.int64))),
            np.concatenate((s[stay].view(np.int64), np.full(len(gone), -1))),
            np.concatenate((d[stay], gone[:, 0])),
            np.concatenate((a[stay], gone[:, 1])),
            np.concatenate((f[stay], gone[:, 2])).astype(np.int32),
            np.concatenate((np.zeros(int(stay.sum()), np.int64), gone[:, 3])).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "span", "doc", "alt", "at", "n"])

    return map_pieces(rows, "text", step, _SPANS, PIECE_BYTES)


def _stream_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted span rows to removed bytes (kind 0: at, n, and their source) and spans to look at (kind 1: first window, windows, place of the gram)."""
    held: np.ndarray | None = None  # the first span of the last gram, while it is that gram's only one
    last: np.ndarray | None = None  # the last row, as (gram, span, doc, alt, at) of the first of its span
    for batch in batches:
        cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "span", "doc", "alt", "at", "n")], axis=1)
        local, cols = cols[cols[:, 1] == -1], cols[cols[:, 1] != -1]
        out = [np.column_stack((np.zeros(len(local), np.int64), local[:, 2:6], np.zeros((len(local), 3), np.int64), np.full(len(local), -1)))]
        if len(cols):
            before = np.vstack((last if last is not None else np.zeros((1, 6), np.int64), cols))
            has = np.ones(len(cols), bool)
            has[0] = last is not None
            same_gram = has & (cols[:, 0] == before[:-1, 0])
            same_span = same_gram & (cols[:, 1] == before[:-1, 1])
            head = np.maximum.accumulate(np.where(same_span, 0, np.arange(1, len(cols) + 1)))
            first = before[head]  # row of the first of each one's span; 0 is from earlier batches
            gone = same_span & (cols[:, 2:5] != first[:, 2:5]).any(axis=1)
            windows, inner = cols[:, 1] >> 7 & 127, cols[:, 1] & 127
            out.append(np.column_stack((np.zeros(int(gone.sum()), np.int64), cols[gone][:, 2:5], windows[gone] - 1 + WIDTH, inner[gone], first[gone][:, 2:5])))
            fresh = np.flatnonzero(~same_span)
            if len(fresh):
                firsts = cols[fresh]
                if held is not None:
                    firsts = np.vstack((held, firsts))
                several = np.zeros(len(firsts), bool)
                pair = firsts[1:, 0] == firsts[:-1, 0]
                several[1:] |= pair
                several[:-1] |= pair
                if held is None and same_gram[fresh[0]]:
                    several[0] = True  # its gram's earlier spans have been emitted
                ask = several.copy()
                # The last span may be followed by others of its gram: it waits unless it is known to have company.
                wait = not several[-1]
                picked = firsts[ask]
                out.append(np.column_stack((np.ones(len(picked), np.int64), picked[:, 2:5], picked[:, 1] >> 7 & 127, picked[:, 1] & 127, np.zeros((len(picked), 2), np.int64), np.full(len(picked), -1))))
                held = firsts[-1:] if wait else None
            last = first[-1:].copy()
            last[:, :2] = cols[-1:, :2]
        rows = np.vstack(out)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(t)) for i, t in enumerate((np.int32, np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int32))], ["kind", "doc", "alt", "at", "n", "inner", "sdoc", "salt", "sat"])


def claims_of(text: bytes, found: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(source doc, source alt, place there, bytes) of the runs (at, n, sdoc, salt, sat) of one text: what overlaps at one distance is one run, cut at the source's segments."""
    by_source: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for at, n, sdoc, salt, sat in found:
        by_source.setdefault((sdoc, salt, sat - at), []).append((at, at + n))
    for (sdoc, salt, ahead), runs in by_source.items():
        for a, b in merged(runs):
            while a < b:
                to = min(b, a + SEGMENT - (a + ahead) % SEGMENT)
                yield sdoc, salt, a + ahead, text[a:to]
                a = to


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their spans to claims (kind 0) and to contexts by bucket (kind 1)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        kinds, buckets, docs, alts, ats, parts = [], [], [], [], [], []
        for doc, alt, packed, asked in zip(batch.column("doc").to_pylist(), batch.column("alt").to_pylist(), batch.column("packed").to_pylist(), batch.column("asked").to_pylist()):
            text = unpack(packed)
            for row in claims_of(text, [(x["at"], x["n"], x["sdoc"], x["salt"], x["sat"]) for x in asked if x["kind"] == 0]):
                for c, v in zip((kinds, buckets, docs, alts, ats, parts), (0, 0, *row)):
                    c.append(v)
            for span in {(x["at"], x["n"], x["inner"]) for x in asked if x["kind"] == 1}:
                at, n, inner = span
                gram = at + inner
                split = min(max(inner - HALF, 0), n)  # windows from here on hold the bytes after the gram, those before it the bytes before
                for a, b, key in ((at, at + split, text[gram - HALF - 1 : gram + GRAM] if split else b""), (at + split, at + n, text[gram : gram + WIDTH - HALF])):
                    if b > a:
                        kinds.append(1)
                        buckets.append(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True))
                        docs.append(doc)
                        alts.append(alt)
                        ats.append(a)
                        parts.append(text[a : b - 1 + WIDTH])
        if buckets:
            cols = zip((kinds, buckets, docs, alts, ats, parts), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["kind", "bucket", "doc", "alt", "at", "bytes"])


def _false_claims(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims with the source's text, to those that do not hold."""
    unpack = zstandard.ZstdDecompressor().decompress
    last, text = None, b""
    for batch in batches:
        docs, alts = batch.column("doc").to_pylist(), batch.column("alt").to_pylist()
        bad, sizes = [], []
        for i, (key, at, said) in enumerate(zip(zip(docs, alts), batch.column("at").to_pylist(), batch.column("bytes").to_pylist())):
            if key != last:
                last, text = key, unpack(batch.column("packed")[i].as_py())
            if text[at : at + len(said)] != said:
                bad.append(i)
                sizes.append(len(said))
        if bad:
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(bad)) for c in ("doc", "alt", "at")), pa.array(sizes, pa.int32())], ["doc", "alt", "at", "n"])


class _Blocks:
    """Collects sorted contexts into blocks of whole buckets."""

    def __init__(self):
        self.bucket = None
        self.now: list[tuple[int, int, int, bytes]] = []  # of this bucket
        self.block: list[tuple[int, int, int, bytes]] = []
        self.names: list[int] = []
        self.size = 0

    def add(self, bucket: int, row: tuple[int, int, int, bytes]) -> Iterator[pa.RecordBatch]:
        if bucket != self.bucket:
            yield from self.close_bucket()
            self.bucket = bucket
        if not self.now or self.now[-1][:3] != row[:3]:  # else a repeated row's
            self.now.append(row)

    def close_bucket(self) -> Iterator[pa.RecordBatch]:
        if len(self.now) > 1:
            self.block += self.now
            self.names += [len(self.names)] * len(self.now)
            self.size += sum(len(r[3]) for r in self.now)
        self.now = []
        if self.size >= BLOCK_BYTES:
            yield from self.close_block()

    def close_block(self) -> Iterator[pa.RecordBatch]:
        rows, names = self.block, self.names
        self.block, self.names, self.size = [], [], 0
        if not rows:
            return
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        bounds = np.cumsum([0, *(len(r[3]) for r in rows)])
        gone = repeated_windows(text, bounds, np.array(names), WIDTH)
        counts = np.diff(bounds) - WIDTH + 1
        owner = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(gone)) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = np.flatnonzero(gone)
        if not len(hit):
            return
        opens = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (np.diff(owner[hit]) != 0)))
        sizes = np.diff(np.append(opens, len(hit)))
        who, at = owner[hit[opens]], place[hit[opens]]
        zero = np.zeros(len(who), np.int64)
        yield _found(zero, [rows[i][0] for i in who], [rows[i][1] for i in who], np.array([rows[i][2] for i in who]) + at, sizes - 1 + WIDTH, zero, zero)


def _hash_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of contexts as 128-bit BLAKE2b digests (kind 2)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            texts = batch.column("bytes").to_pylist()
            counts = np.array([len(t) for t in texts], np.int64) - WIDTH + 1
            owner = np.repeat(np.arange(batch.num_rows), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            digests = b"".join(hashlib.blake2b(t[i : i + WIDTH], digest_size=16).digest() for t in texts for i in range(len(t) - WIDTH + 1))
            h = np.frombuffer(digests, np.int64).reshape(-1, 2)
            doc, alt, at = (batch.column(c).to_numpy()[owner] for c in ("doc", "alt", "at"))
            yield _found(np.full(len(owner), 2), doc, alt, at + place, np.full(len(owner), WIDTH), h[:, 0], h[:, 1])


def _found(kind, doc, alt, at, n, h1, h2) -> pa.RecordBatch:
    types = (np.int32, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, t)) for c, t in zip((kind, doc, alt, at, n, h1, h2), types)], ["kind", "doc", "alt", "at", "n", "h1", "h2"])


def _sort_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = _Blocks()
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc", "alt", "at", "bytes"))):
            yield from blocks.add(bucket, tuple(row))
    yield from blocks.close_bucket()
    yield from blocks.close_block()


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for packed, gone in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist()):
            text = unpack(packed)
            found = merged((x["at"], x["at"] + x["n"]) for x in gone or ())
            digest, last = hashlib.sha256(), 0
            for a, b in found:
                digest.update(text[last:a])
                last = b
            digest.update(text[last:])
            for c, v in zip(out, (len(text), sum(b - a for a, b in found), len(found), digest.hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, most: int = MAX_BUCKET, bits: int = SPAN_BITS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Fewer ``bits`` of the spans' hashes (tests) give the same rows by more work."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc"), text.alias("text"))
    hashed = rows.select("doc", F.xxhash64("text").alias("h"))
    shared_ids = hashed.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count()
    rows = rows.withColumn("alt", F.xxhash64("text") if shared_ids else F.lit(0).cast("long"))

    order = ["gram", "span", "doc", "alt", "at"]
    streamed = span_rows(rows.select("doc", "alt", "text"), bits).repartition("gram").sortWithinPartitions(*order).mapInArrow(_stream_spans, _RUNS)
    streamed.write.option("compression", "zstd").parquet(f"{folder}/spans")
    streamed = spark.read.parquet(f"{folder}/spans")

    def pack(piece: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        data, bounds = utf8(piece.column("text"))
        whole = data.tobytes()
        packed = [squeeze(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "doc", "alt")), pa.array(packed, pa.binary())], ["doc_id", "doc", "alt", "packed"])

    texts = map_pieces(rows, "text", pack, "doc_id long, doc long, alt long, packed binary")
    key = ["doc", "alt"]

    def cut_out(spans: DataFrame, name: str) -> DataFrame:
        asked = spans.groupBy(*key).agg(F.collect_list(F.struct("kind", "at", "n", "inner", "sdoc", "salt", "sat")).alias("asked"))
        texts.join(asked, key).select(*key, "packed", "asked").mapInArrow(_cut, _CUT).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    cut = cut_out(streamed.where("kind = 1 or sat >= 0"), "cut")
    claims = cut.where("kind = 0").select(*key, "at", "bytes").distinct()
    held = claims.join(texts.select(*key, "packed").dropDuplicates(key), key).select(*key, "at", "bytes", "packed")
    held.mapInArrow(_false_claims, "doc long, alt long, at int, n int").write.parquet(f"{folder}/false")
    false = spark.read.schema("doc long, alt long, at int, n int").parquet(f"{folder}/false")
    contexts, sure = cut.where("kind = 1"), streamed.where("kind = 0")
    if not false.isEmpty():
        c = {name: F.col(f"s.{name}") for name in ("sdoc", "salt", "sat", "n")}
        touches = [c["sdoc"] == F.col("f.doc"), c["salt"] == F.col("f.alt"), c["sat"] < F.col("f.at") + F.col("f.n"), c["sat"] + c["n"] > F.col("f.at")]
        unsure = checkpointed(sure.alias("s").join(false.alias("f"), touches, "left_semi"))
        sure = sure.alias("s").join(false.alias("f"), touches, "left_anti")
        windows = (F.col("n") - WIDTH + 1).alias("n")
        nowhere = [F.lit(0).cast("long").alias("sdoc"), F.lit(0).cast("long").alias("salt"), F.lit(-1).alias("sat")]
        sources = unsure.select(F.lit(1).alias("kind"), F.col("sdoc").alias("doc"), F.col("salt").alias("alt"), F.col("sat").alias("at"), windows, "inner", *nowhere).distinct()
        again = unsure.select(F.lit(1).alias("kind"), *key, "at", windows, "inner", *nowhere)
        contexts = contexts.unionByName(cut_out(again.unionByName(sources), "cut_again").where("kind = 1"))
    contexts = contexts.drop("kind")
    hot = small(checkpointed(contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("bucket")))
    dealt = contexts.join(hot, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket", "doc", "alt", "at").mapInArrow(_sort_blocks, _FOUND)
    hashed = contexts.join(hot, "bucket", "left_semi").mapInArrow(_hash_windows, _FOUND)
    dealt.unionByName(hashed).write.option("compression", "zstd").parquet(f"{folder}/windows")
    found = spark.read.parquet(f"{folder}/windows")

    gone = sure.select(*key, "at", "n").unionByName(found.where("kind = 0").select(*key, "at", "n"))
    wide = found.where("kind = 2")
    if wide.limit(1).count():
        earliest = wide.groupBy("h1", "h2").agg(F.min(F.struct("doc", "alt", "at")).alias("e"))
        later = wide.join(earliest, ["h1", "h2"]).where(F.struct("doc", "alt", "at") > F.col("e"))
        gone = gone.unionByName(later.select(*key, "at", "n"))
    gone = checkpointed(gone.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("gone")))
    dropped(spark, folder)
    return texts.join(gone, key, "left").select("doc_id", "packed", "gone").mapInArrow(_keep, SCHEMA)

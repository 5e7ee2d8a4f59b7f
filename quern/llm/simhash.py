"""SimHash near-dedup with exact components of all links within a radius of 2 bits.

1. Fingerprints: XXH64 of every 3-word shingle, one bit per position by majority; map-only.
2. Equal fingerprints collapse at once: later steps see each fingerprint once, however many copies it has.
3. Candidates: 64 bits are cut into 4 bands. Two fingerprints within 2 bits agree on at least 2 whole bands, so every
   link lies in one of 6 groups keyed by 2 bands (32 bits). No link is lost.
4. In a group, fingerprints are compared bit-sliced: one plane per bit position, 64 fingerprints to a machine word;
   carry-save counters (ones, twos, more) add a differing bit of 64 fingerprints at once, and a block of them is
   abandoned when all its distances exceed the radius. Each fingerprint yields one edge to its component in the group,
   never all pairs.
5. A group of over ``MAX_GROUP`` fingerprints is not gathered but cut once more in the same way: of the 4 bytes its members need not share, two fingerprints
   within 2 bits agree on at least 2, so every link lies in one of 6 subgroups. Members of a subgroup share 48 bits and are distinct, so there are
   at most 65,536 of them (512 KB), however many documents there are; they are compared bit-sliced like any other.
6. Components: alternating large-star and small-star steps over (fingerprint, fingerprint) edges in Spark, checkpointed, until nothing changes.
7. Fingerprints of a large part of all rows (copies, empty texts) are joined back by broadcast (at most ``common.HOT_KEYS`` of them), the others by shuffle.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; fewer than 3
words are one shingle; a null doc_id takes part but is never a component's name while another is there; repeated rows
come out as often as they go in; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_hot, map_pieces, utf8

SEED, SHINGLE, RADIUS, BITS = 42, 3, 2, 64
#: Text that is split into words at once.
PART_BYTES, _GAP = 1 << 20, re.compile(rb"[ \x09-\x0D]")
BAND = 16
BAND_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: Distinct fingerprints of a group that one task compares; larger groups are cut into subgroups.
MAX_GROUP = 4096

_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint_of(text: bytes) -> int:
    """The majority of the shingles' bits; a long text is taken in parts of some PART_BYTES that end between words."""
    counts, n, carry, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(text):
        gap = _GAP.search(text, at + PART_BYTES) if at + PART_BYTES < len(text) else None
        end = gap.start() if gap else len(text)
        words = carry + text[at:end].lower().split()  # of bytes: lowers A-Z only, splits at space and \x09-\x0D only
        at = end
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = hashes_of(joined[s:e] for s, e in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()))
            counts += bit_counts(hashes)
            n += len(hashes)
        carry = words[-SHINGLE + 1 :]
    if not n and carry:
        counts, n = bit_counts(hashes_of([b" ".join(carry)])), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def hashes_of(shingles: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    n = len(hashes)
    if n < 256:
        return np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    columns = np.ascontiguousarray(hashes.view(np.uint8).reshape(n, 8).T)
    return np.concatenate([np.bincount(c, minlength=256) @ _BIT_TABLE for c in columns])


def fingerprint_column(text: pa.Array) -> pa.Array:
    data, bounds = utf8(text)
    whole = data.tobytes()
    prints = [fingerprint_of(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return pa.array(np.array(prints, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, key, fp (64 bits, as a signed long) for every row; ``key`` is any long of the row."""

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), fingerprint_column(piece.column("text"))], ["doc_id", "key", "fp"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0).cast("long") if key is None else key).alias("key"), "text")
    return map_pieces(read, "text", step, "doc_id long, key long, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words) planes; bit j of word w of plane b is bit b of fingerprint 64 * w + j."""
    n = len(prints)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(planes: np.ndarray, one: int, alive: np.ndarray, chunk: int = 8) -> np.ndarray:
    """Words whose set bits are the fingerprints within 2 bits of ``one``; ``alive`` masks those still looked for.

    Differing bits are added by a carry-save step: ones, twos and a sticky overflow. Words in which every fingerprint
    has overflowed are left out of all later planes.
    """
    out = np.zeros(planes.shape[1], np.uint64)
    live = np.flatnonzero(alive)
    ones, twos = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
    open_ = alive[live]
    for b in range(0, BITS, chunk):
        for i in range(b, b + chunk):
            differs = planes[i, live]
            if one >> i & 1:
                differs = ~differs
            carry = ones & differs
            ones = ones ^ differs
            open_ = open_ & ~(twos & (carry | ones))  # 2 + 1, or a second carry
            twos = twos | carry
        keep = open_ != 0
        if not keep.all():
            live, ones, twos, open_ = live[keep], ones[keep], twos[keep], open_[keep]
            if not len(live):
                return out
    out[live] = open_
    return out


def group_edges(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, first of its component) for every member of one group that has a link to an earlier-found one."""
    n = len(prints)
    if n == 2:
        if int(prints[0] ^ prints[1]).bit_count() <= RADIUS:
            return prints[1:], prints[:1]
        return prints[:0], prints[:0]
    planes = bit_planes(prints)
    alive = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view(np.uint64).copy()
    members, roots = [], []
    for start in range(n):
        if not int(alive[start >> 6]) >> (start & 63) & 1:
            continue
        alive[start >> 6] &= ~np.uint64(1 << (start & 63))
        queue = [start]
        while queue:
            near = within_radius(planes, int(prints[queue.pop()]), alive)
            if near.any():
                alive &= ~near
                new = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
                members.append(new)
                roots.append(np.full(len(new), start))
                queue.extend(new.tolist())
    if not members:
        return prints[:0], prints[:0]
    return prints[np.concatenate(members)], prints[np.concatenate(roots)]


def _compare_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, key, members) of bounded lists of distinct fingerprints to edges (a, b)."""
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            got = group_edges(np.sort(members.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            if len(got[0]):
                a.append(got[0])
                b.append(got[1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def link_edges(distinct: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Edges (a, b) whose components are those of all links between distinct fingerprints."""
    fp = F.col("fp")
    band = lambda i: F.shiftrightunsigned(fp, BAND * i).bitwiseAND(F.lit((1 << BAND) - 1))
    both = lambda i, j: F.shiftleft(band(i), BAND).bitwiseOR(band(j))
    rest = [[x for x in range(4) if x not in pair] for pair in BAND_PAIRS]
    keys = F.array(*[F.struct(F.lit(n).alias("pair"), both(*pair).alias("key"), both(*rest[n]).alias("rest")) for n, pair in enumerate(BAND_PAIRS)])
    keyed = distinct.select("fp", F.inline(keys))
    sized = keyed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    in_groups = checkpointed(keyed.join(sized, ["pair", "key"]))
    small = in_groups.where(F.col("n") <= most).groupBy("pair", "key").agg(F.collect_list("fp").alias("members")).select("members")
    byte = lambda i: F.shiftrightunsigned("rest", 8 * i).bitwiseAND(F.lit(255))
    subkeys = F.array(*[F.struct(F.lit(n).alias("sub"), F.shiftleft(byte(i), 8).bitwiseOR(byte(j)).alias("subkey")) for n, (i, j) in enumerate(BAND_PAIRS)])
    large = in_groups.where(F.col("n") > most).select("pair", "key", "fp", F.inline(subkeys)).groupBy("pair", "key", "sub", "subkey").agg(F.collect_list("fp").alias("members"))
    return small.unionByName(large.where(F.size("members") > 1).select("members")).mapInArrow(_compare_groups, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable. Alternating star steps."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        # large star: every larger neighbour of a node moves to the smallest of the node and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and the node, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        edges = checkpointed(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        last = tuple(sums)


def near_duplicates(docs: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    prints = checkpointed(fingerprints(docs))
    return join_hot(prints, classes(prints, most), ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(prints: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """fp, copies (rows of it), root, component_id for every distinct fingerprint of (doc_id, fp) rows; written down."""
    smallest = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")))
    nodes = components(link_edges(smallest.select("fp"), most))
    rooted = smallest.join(nodes, smallest.fp == nodes.node, "left").select("fp", "copies", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return checkpointed(rooted.select("fp", "copies", "root").join(named, "root"))


def deduplicated(docs: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of equal ones, the first by text hash). All columns stay.

    What is kept is named by doc_id and text hash, so the texts' second pass stays in the JVM.
    """
    names = docs.columns
    mark = "kept_text"
    while mark in names:
        mark += "_"
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    prints = checkpointed(fingerprints(docs, key))
    by_root = join_hot(prints, classes(prints, most), ["fp"], "copies").groupBy("root")
    kept = by_root.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("k")).select("k.doc_id", "k.key")
    # Null ids made plain columns, so that the join and the ranking after it are dealt out by the same keys: texts move once.
    by = [mark, f"{mark}_id", f"{mark}_none"]
    plain = {by[1]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), by[2]: F.col("doc_id").isNull()}
    wanted = kept.select(F.col("key").alias(mark), *[c.alias(n) for n, c in plain.items()])
    rows = docs.withColumns({mark: key, **plain}).join(wanted, by, "left_semi")
    rank = f"{mark}_rank"
    first = Window.partitionBy(*by).orderBy("text")
    return rows.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*names)

"""Prefix trie of conversations: shared beginnings, who has them, and what storing each once saves.

1. Turns are numbered within their conversation, and a turn's label is two 64-bit hashes of role and text. Each conversation's prefixes get two rolling
   hashes (128 bits name a node), streamed in order.
2. A node's weight is the number of rows below it, itself included. Nodes of over ``LIMIT`` are the heavy upper levels, a connected top of the trie; what hangs below is
   cut into prefix shards, each a light subtree of LIMIT rows at most, copies included.
3. A task builds the shards it holds, block by block, as one level-order trie: a LOUDS bitvector (each node's children as ones, then a zero) and arrays of labels and
   lengths. Parents and degrees are read off the bits; leaves and savings are rolled up in reverse level order with ``add.at``.
4. Heavy nodes are merged apart, by grouped sums: a shard's total, or a heavy node's own part, belongs to the path of its smallest conversation; sums from the far end of that path
   give every heavy node on it its share. No task sees more of a heavy node than partial sums.
5. The list of conversations that end in a heavy node is sorted by range, packed into chunks, and hashed as a stream.

Defined cases: rows without a conv_id are left out; null role or text is empty; turns go by number (null first), then role, then text; repeated rows are turns of their own;
other columns are ignored, whatever their names; an empty table gives no nodes. One conversation's turns are numbered in one task, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, join_hot

#: Rows (conversations times depths) of a prefix shard at most, and those that a task builds at once.
LIMIT, BLOCK_ROWS = 2048, 1 << 16
#: Conversations of one chunk of an end list.
CHUNK = 4096
_SEQUENCES = "conv_id long, total long, depth long, size long, h1 long, h2 long, p1 long, p2 long"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, p1 long, p2 long"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE, PARENT = ["h1", "h2"], ["p1", "p2"]


@dataclass
class Louds:
    """A forest in level order under one super-root. Bit by bit, from the super-root on: a one for each child, then a zero."""

    bits: np.ndarray
    levels: np.ndarray  # first node of each level, and the number of nodes

    @classmethod
    def of_degrees(cls, degrees: np.ndarray, levels: np.ndarray) -> Louds:
        """``degrees`` of the super-root and then of every node."""
        bits = np.ones(int(degrees.sum()) + len(degrees), bool)
        bits[np.cumsum(degrees) + np.arange(len(degrees))] = False
        return cls(bits, levels)

    def degrees(self) -> np.ndarray:
        """Children of each node: the ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for the super-root: zeros before the node's one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the last level to the first."""
        total, parents = own.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1].tolist(), self.levels[:0:-1].tolist()):
            np.add.at(total, parents[a:b], total[a:b])
        return total


def level_order(shard: np.ndarray, level: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """Trie of rows that are sorted by shard, conversation and level: LOUDS, each row's node, each node's first row."""
    node = np.zeros(len(level), np.int64)
    by_level = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[by_level], prepend=-1, append=np.iinfo(np.int64).max))
    levels, firsts, parents, n = [0], [], [], 0
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        rows = by_level[a:b]
        above = shard[rows] if not a else node[rows - 1]
        order = np.lexsort((h2[rows], h1[rows], above))
        rows, above = rows[order], above[order]
        fresh = np.append(True, (above[1:] != above[:-1]) | (h1[rows][1:] != h1[rows][:-1]) | (h2[rows][1:] != h2[rows][:-1]))
        node[rows] = n + np.cumsum(fresh) - 1
        firsts.append(rows[fresh])
        parents.append(above[fresh] + 1 if a else np.zeros(int(fresh.sum()), np.int64))
        n += len(firsts[-1])
        levels.append(n)
    degrees = np.bincount(np.concatenate(parents), minlength=n + 1)
    return Louds.of_degrees(degrees, np.array(levels)), node, np.concatenate(firsts)


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield {c: batch.column(c).to_numpy() for c in batch.schema.names}


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and depth, to names of their prefixes and of what is before."""
    kept: tuple[int, np.uint64, np.uint64, np.uint64, np.uint64] | None = None
    for rows in _columns(batches):
        conv, depth = rows["conv_id"], rows["depth"]
        a, b = rows["a"].view(np.uint64), rows["b"].view(np.uint64)
        opens = depth == 0
        head = np.maximum.accumulate(np.where(opens, np.arange(len(conv)), -1))
        names = []
        for i, (one, two, base) in enumerate(((a, b, tc.BASE), (b, a, 0xD1342543DE82EF95))):
            value = np.where(opens, np.uint64(0), tc.mix(tc.mix(one) * np.uint64(0x9FB21C651E98DF25) + two) * tc.power_at(base, depth))
            total = np.cumsum(value, dtype=np.uint64)
            chain = total - np.where(head >= 0, total[head], np.uint64(0)) + np.where(head >= 0, np.uint64(0), np.uint64(kept[1 + i] if kept else 0))
            names.append((chain, np.where(opens, np.uint64(0), tc.mix(chain))))
        (c1, h1), (c2, h2) = names
        before = [np.where(opens, np.uint64(0), np.append(np.uint64(last), h[:-1])) for h, last in ((h1, kept[3] if kept else 0), (h2, kept[4] if kept else 0))]
        kept = (int(conv[-1]), c1[-1], c2[-1], h1[-1], h2[-1])
        cols = [conv, rows["total"], depth, rows["size"], *(x.view(np.int64) for x in (h1, h2, *before))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in _SEQUENCES.split(", ")])


def _trie(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Whole shards, sorted by shard, conversation and depth, to nodes. Only a shard's top lacks its parent's conversation."""
    conv, depth = rows["conv_id"], rows["depth"]
    new_shard = np.append(True, (rows["s1"][1:] != rows["s1"][:-1]) | (rows["s2"][1:] != rows["s2"][:-1]))
    head = np.maximum.accumulate(np.where(np.append(True, conv[1:] != conv[:-1]) | new_shard, np.arange(len(conv)), 0))
    louds, node, first = level_order(np.cumsum(new_shard), depth - depth[head], rows["h1"], rows["h2"])
    parents, degrees, n_convs = louds.parents(), louds.degrees(), np.bincount(node)
    ends = np.full(len(first), hashlib.sha256().hexdigest(), object)
    last = np.flatnonzero(depth == rows["total"])
    last = last[np.lexsort((conv[last], node[last]))]
    cuts = np.flatnonzero(np.diff(node[last], prepend=-1, append=-1))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        ends[node[last[a]]] = hashlib.sha256(",".join(map(str, conv[last[a:b]].tolist())).encode()).hexdigest()
    top = parents < 0
    parent_conv = pa.array(conv[first][parents], mask=top)
    cols = [conv[first], depth[first], parent_conv, n_convs, degrees, louds.rolled_up((degrees == 0).astype(np.int64)), louds.rolled_up((n_convs - 1) * rows["size"][first]), ends, top, rows["p1"][first], rows["p2"][first]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [c.split()[0] for c in _NODES.split(", ")])


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows of a task into blocks of whole shards."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for rows in _columns(batches):
        held.append(rows)
        size += len(rows["conv_id"])
        if size < BLOCK_ROWS:
            continue
        whole = {c: np.concatenate([x[c] for x in held]) for c in rows}
        cut = int(np.flatnonzero((whole["s1"] != whole["s1"][-1]) | (whole["s2"] != whole["s2"][-1])).max(initial=-1)) + 1
        if cut:
            yield _trie({c: v[:cut] for c, v in whole.items()})
        held, size = [{c: v[cut:] for c, v in whole.items()}], size - cut
    if held:
        yield _trie({c: np.concatenate([x[c] for x in held]) for c in held[0]})


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, conversation) rows in order, to the first conversation and the joined ids of up to CHUNK of a node."""
    for rows in _columns(batches):
        new = np.append(True, (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]))
        place = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        cuts = np.flatnonzero(place % CHUNK == 0)
        ids = rows["conv_id"].tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)])]
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][cuts]) for c in ("h1", "h2", "conv_id")), pa.array(texts)], ["h1", "h2", "low", "ids"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, to the digest of each node's whole list."""
    key, digest = None, hashlib.sha256()

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], ["h1", "h2", "ends"])

    for batch in batches:
        for h1, h2, ids in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("ids").to_pylist()):
            if (h1, h2) != key:
                if key:
                    yield closed()
                key, digest = (h1, h2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if key:
        yield closed()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), label (a, b) and size in code points of every turn; written, as it is used more than once."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    rows = rows.select("conv_id", F.row_number().over(order).cast("long").alias("i"), F.xxhash64("role", "text").alias("a"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("b"), F.length("text").cast("long").alias("size"))
    return checkpointed(rows)


def with_roots(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """Sequence rows of ``turns`` (conv_id, depth, a, b, size) and ``totals`` (conv_id, total: its last depth), with a root row each."""
    root = totals.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "size")), "total")
    return turns.join(totals.select("conv_id", "total"), "conv_id").select(*root.columns).unionByName(root)


def sequences(conversations: DataFrame) -> DataFrame:
    """The conversations as they are."""
    turns = numbered(conversations)
    return with_roots(turns.withColumnRenamed("i", "depth"), turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")))


def grafted(conversations: DataFrame, block: int = 100, modulus: int = 6) -> DataFrame:
    """Each conversation rebuilt: its first h turns (h: CRC-32 of its id modulo ``modulus``) give way to those of the first conversation of its block of ids; if there is none, they just go."""
    turns = numbered(conversations)
    base = F.col("conv_id") - F.col("conv_id") % block
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % modulus).alias("h"))
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("i") < modulus)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "size"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,a:bigint,b:bigint,size:bigint>>")), F.lit(1), F.col("h").cast("int")))
    taken = F.size("head").cast("long")
    convs = checkpointed(convs.select("conv_id", "h", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    first = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.i").alias("depth"), "x.a", "x.b", "x.size")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("depth"), "a", "b", "size")
    return with_roots(first.unionByName(rest), convs)


def prefix_trie(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a node of the sequences in ``rows`` (:func:`sequences` or :func:`grafted`)."""
    seq = checkpointed(rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_chains, _SEQUENCES))
    nodes = seq.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("total") - F.col("depth") + 1).alias("weight"), F.min("conv_id").alias("first"), *(F.max(c).alias(c) for c in ("depth", "size", *PARENT))
    )
    heavy = checkpointed(nodes.where(F.col("weight") > limit).drop("weight"))
    path = checkpointed(join_hot(seq.select("conv_id", "depth", "total", *NODE), heavy.select(*NODE, "n"), NODE, "n"))

    cuts = path.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cut"))
    light = seq.join(cuts, "conv_id", "left").where(F.col("depth") >= F.coalesce("cut", F.lit(0)))
    of_conv = Window.partitionBy("conv_id").orderBy("depth")
    light = light.select(*seq.columns, F.first("h1").over(of_conv).alias("s1"), F.first("h2").over(of_conv).alias("s2"))
    built = checkpointed(light.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "conv_id", "depth").mapInArrow(_shards, _NODES))

    tops = built.where("top").drop("parent_conv_id")
    names = heavy.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("first").alias("parent_conv_id"), "n")
    whole = tops.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = built.where("not top").select(*OUT).unionByName(whole.select(*OUT)).unionByName(join_hot(tops.where("depth > 0"), names, PARENT, "n").select(*OUT))

    below = tops.select(*PARENT).unionByName(heavy.where("depth > 0").select(*PARENT)).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"p1": "h1", "p2": "h2"})
    own = checkpointed(heavy.join(below, NODE, "left").na.fill(0, ["n_children"]))
    parts = tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(
        own.select(F.col("first").alias("conv_id"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
    )
    walked = path.join(parts.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "depth", *NODE)
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    zero = F.lit(0).cast("long")
    both = walked.withColumns({"leaves": zero, "saved": zero}).unionByName(parts.withColumns({"h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long")}))
    shares = both.select(*NODE, F.sum("leaves").over(from_end).alias("leaves"), F.sum("saved").over(from_end).alias("saved")).where("h1 is not null")
    sums = shares.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = path.where("depth = total").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_chunks, "h1 long, h2 long, low long, ids string")
    ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(_hashed, "h1 long, h2 long, ends string")
    upper = own.join(sums, NODE).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)))
    upper = upper.withColumnsRenamed({"first": "conv_id", "n": "n_convs"})
    root = upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return out.unionByName(root.select(*OUT)).unionByName(join_hot(upper.where("depth > 0"), names, PARENT, "n").select(*OUT))

"""Approximate nearest neighbours (largest inner product): a forest of random-projection trees.

Fit: each tree has orthonormal random directions, one a level, and splits a node at the median of at most ``SAMPLE_FLOATS`` numbers'
worth of sampled vectors (those of the smallest hashes of their ids); where the sample has run out, at the level's median. Every vector is routed to a leaf of every tree.

Search: all trees share one priority queue of nodes, ordered by the squared distance from the query to the node's
cell; the cheapest ``probes`` leaves are taken, from whichever trees. A child costs no less than its parent and one
child costs the same, so keeping that many nodes a level pops the same leaves as one queue would. Then exact
reranking: every vector of these leaves is scored once in double precision.

How many leaves: the fewest (in steps of a tenth) with which ``RECALL`` of the true neighbours of ``CALIBRATION`` queries lie in a leaf that is taken. Their true
neighbours are found by one exact pass of these few queries over all vectors. So the work follows the data: clustered vectors need
a few leaves a query, vectors that point evenly into all of 64 dimensions need most of a small table.

Layout: each vector is sent once, with its leaf of every tree, to the block of its cell in the first tree (blocks are bounded in bytes; a
fuller one is split). A table of (cell, block) says where the vectors of each upper cell of every tree are; a query goes to the blocks of its leaves' cells, with
its leaves as a list or, where they are many, a bit for each leaf.
Equal vectors are one entry with their K + 1 smallest ids, which is exact, and equal queries are searched once.

Defined cases: a vector that is null, zero, or holds a null, infinite or NaN component takes no part, nor does one of another length
than the most common; repeated rows (same id and vector) count once; ties go to the smaller vec_id; fewer candidates
than K give all that the leaves hold; a null vec_id takes no part; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

K, TREES, LEAF_ROWS = 20, 8, 64
#: Share of the sampled queries' true neighbours that the taken leaves hold, and the number of these queries.
RECALL, CALIBRATION = 0.95, 64
#: Vectors of one block, as doubles; a block over the second is split.
BLOCK_BYTES, MAX_BLOCK_BYTES = 4 << 20, 16 << 20
SAMPLE_ROWS, SAMPLE_FLOATS = 20_000, 2_000_000
QUERY_BATCH, SLACK, SEED = 1024, 4, 23
#: Levels of the table's cells below those of the blocks.
FINER = 1
_FOUND = "h1 long, h2 long, score double, ids array<long>"


class Forest:
    """Directions (trees, depth, dim) and, for each tree and level, one threshold a node; a single one where the sample has run out."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.trees, self.depth = trees, depth
        rotation = lambda: np.linalg.qr(rng.normal(size=(dim, dim)))[0].T
        self.directions = np.stack([np.concatenate([rotation() for _ in range(-(-depth // dim))] or [np.zeros((0, dim))])[:depth] for _ in range(trees)])
        self.thresholds: list[list[np.ndarray]] = []
        for t in range(trees):
            along, node, levels = sample @ self.directions[t].T, np.zeros(len(sample), np.int64), []
            for level in range(self.depth):
                middle = float(np.median(along[:, level])) if len(sample) else 0.0
                if 4 << level > len(sample):
                    levels.append(np.array([middle]))
                    continue
                cut = np.full(1 << level, middle)
                order = np.argsort(node, kind="stable")
                edges = np.flatnonzero(np.diff(node[order])) + 1
                for members in np.split(order, edges):
                    if len(members) >= 4:  # else the median of the whole level
                        cut[node[members[0]]] = np.median(along[members, level])
                levels.append(cut)
                node = node * 2 + (along[:, level] > cut[node])
            self.thresholds.append(levels)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each vector in each tree."""
        out = np.zeros((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            along = x @ self.directions[t].T
            for level, cut in enumerate(self.thresholds[t]):
                out[t] = out[t] * 2 + (along[:, level] > cut[np.minimum(out[t], len(cut) - 1)])
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): tree * 2**depth + leaf."""
        return (self.leaves(x) + (np.arange(self.trees) << self.depth)[:, None]).T

    def nearest_leaves(self, q: np.ndarray, probes: int) -> np.ndarray:
        """(rows, at most probes) of tree * 2**depth + leaf: the first leaves that the shared queue pops."""
        n = len(q)
        along = np.einsum("nd,tld->ntl", q, self.directions)
        tree = np.tile(np.arange(self.trees), (n, 1))
        node, cost = np.zeros((n, self.trees), np.int64), np.zeros((n, self.trees))
        rows = np.arange(n)[:, None]
        for level in range(self.depth):
            cuts = np.stack([levels[level] for levels in self.thresholds])
            gap = along[rows, tree, level] - cuts[tree, np.minimum(node, cuts.shape[1] - 1)]
            cost = np.concatenate((cost + np.maximum(gap, 0) ** 2, cost + np.maximum(-gap, 0) ** 2), axis=1)
            node, tree = np.concatenate((node * 2, node * 2 + 1), axis=1), np.concatenate((tree, tree), axis=1)
            if cost.shape[1] > probes:
                keep = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                cost, node, tree = cost[rows, keep], node[rows, keep], tree[rows, keep]
        if cost.shape[1] > probes:
            keep = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            node, tree = node[rows, keep], tree[rows, keep]
        return (tree << self.depth) + node

    def probes_for(self, q: np.ndarray, owner: np.ndarray, neighbours: np.ndarray, recall: float) -> int:
        """The fewest leaves, in steps of a tenth, of which ``recall`` of the neighbours (each of query ``owner``) lie in one."""
        codes, probes, every = self.codes(neighbours), self.trees, self.trees << self.depth
        while probes < every and len(codes):
            popped = self.nearest_leaves(q, probes)
            held = np.concatenate([np.isin(codes[owner == i], popped[i]).any(axis=1) for i in range(len(q))])
            if held.mean() >= recall:
                break
            probes = min(every, probes + max(1, probes // 10))
        return probes


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (floats as they are, anything else as doubles) of the vectors that take part, length not yet looked at."""
    v = F.col("vec")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    return out.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))


def true_neighbours(entries: DataFrame, q: np.ndarray, own: list[int], k: int) -> DataFrame:
    """query (its place), score, vec: the k best entries of a few queries by one pass over all; an entry of the query's own id alone is none."""
    shared = entries.sparkSession.sparkContext.broadcast((q, own))
    kind = entries.schema["vec"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        held: list[list] = [[] for _ in own]
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_BATCH):
                batch = whole.slice(start, QUERY_BATCH)
                x, ids = _matrix(batch.column("vec")), batch.column("ids")
                ref, alone = batch.column("ref").to_numpy(), np.diff(ids.offsets.to_numpy()) == 1
                scores = q @ x.T
                for i, mine in enumerate(own):
                    s = np.where(alone & (ref == mine), -np.inf, scores[i])
                    best = np.argsort(-s, kind="stable")[:k]
                    held[i] = sorted(held[i] + [(-float(s[j]), int(ref[j]), x[j]) for j in best.tolist() if s[j] > -np.inf], key=lambda r: r[:2])[:k]
        flat = [(i, -s, v) for i, rows in enumerate(held) for s, _, v in rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat]), pa.array([r[2].tolist() for r in flat], pa.list_(pa.float64())).cast(pa.list_(pa.float32() if kind == "array<float>" else pa.float64()))], ["query", "score", "vec"])

    best = Window.partitionBy("query").orderBy(F.desc("score"))
    found = entries.select("vec", "ref", "ids").mapInArrow(run, f"query int, score double, vec {kind}")
    return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).select("query", "vec")


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K, recall: float = RECALL, probes: int | None = None, scored: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on vec_id; ``probes`` sets the number of leaves a query; ``scored`` adds up the entries that are scored."""
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = usable(vectors)
    common = fine.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return none
    dim = common.dim
    # Two independent hashes name a vector, so that equal queries meet without carrying it.
    fine = checkpointed(fine.where(F.size("vec") == dim).dropDuplicates(["vec_id", "vec"]).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    by_vec = Window.partitionBy("vec").orderBy("vec_id")
    entries = fine.withColumn("at", F.row_number().over(by_vec)).where(F.col("at") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = checkpointed(entries.withColumn("ref", F.element_at("ids", 1)))
    asking = fine.where(is_query)
    few = asking.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toArrow()
    if not few.num_rows:
        return none
    n = entries.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF_ROWS)))
    take = min(SAMPLE_ROWS, max(1, SAMPLE_FLOATS // dim))
    sample = entries.orderBy(F.xxhash64("ref"), "ref").limit(take).select("vec").toArrow()
    forest = Forest(_matrix(sample.column("vec").combine_chunks()), depth)
    if probes is None:
        q = _matrix(few.column("vec").combine_chunks())
        near = true_neighbours(entries, q, few.column("vec_id").to_pylist(), k).toArrow()
        probes = forest.probes_for(q, near.column("query").to_numpy(), _matrix(near.column("vec").combine_chunks()), recall)
    bits = min(depth, max(0, math.ceil(math.log2(max(1, n * dim * 8 / BLOCK_BYTES)))))
    room = max(1, MAX_BLOCK_BYTES // (dim * 8))
    kind = fine.schema["vec"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(forest)
    below = depth - min(depth, bits + FINER)
    part_of = lambda codes: codes[:, 0] >> (depth - bits)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_BATCH):
                batch = whole.slice(start, QUERY_BATCH)
                codes = shared.value.codes(_matrix(batch.column("vec")))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), TREES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part_of(codes)), *(batch.column(c) for c in ("ref", "vec", "ids")), lists], ["part", "ref", "vec", "ids", "codes"])

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            codes = shared.value.codes(_matrix(whole.column("vec")))
            pairs = np.unique(np.stack((codes.ravel() >> below, np.repeat(part_of(codes), TREES)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["cell", "part"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                popped = shared.value.nearest_leaves(_matrix(batch.column("vec")), probes)
                cells = pa.array([np.unique(row >> below) for row in popped], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "vec")), cells, pa.array([packed(row, TREES << depth) for row in popped], pa.binary())], ["h1", "h2", "vec", "cells", "leaves"])

    key = ["h1", "h2"]
    placed = entries.mapInArrow(route, f"part long, ref long, vec {kind}, ids array<long>, codes array<long>")
    where = entries.select("vec").mapInArrow(places, "cell long, part long").groupBy("cell").agg(F.collect_set("part").alias("parts"))
    sizes = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("subs"))
    once = checkpointed(asking.groupBy(*key).agg(F.first("vec").alias("vec")).mapInArrow(ask, f"h1 long, h2 long, vec {kind}, cells array<long>, leaves binary"))
    visits = once.select(*key, F.explode("cells").alias("cell")).join(where, "cell").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts")).select(*key, F.explode("parts").alias("part"))
    sent = visits.join(sizes, "part").join(once.drop("cells"), key)
    rows = placed.join(sizes, "part").select("part", F.pmod(F.xxhash64("ref"), F.col("subs")).cast("int").alias("sub"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.col("ref").alias("h2"), "vec", "ids", "codes", F.lit(None).cast("binary").alias("leaves"))
    sent = sent.select("part", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(1).alias("kind"), *key, "vec", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("codes"), "leaves")
    together = rows.unionByName(sent).repartition("part", "sub").sortWithinPartitions("part", "sub", "kind")
    found = together.mapInArrow(lambda batches: _rerank(batches, k, scored), _FOUND)
    each = found.select(*key, "score", F.explode("ids").alias("vec_id")).groupBy(*key, "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    # A query leaves out its own id alone, so k + 1 are enough for all that share a vector.
    first = each.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best"))
    answers = asking.select(F.col("vec_id").alias("query_id"), *key).join(first, key)
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "one")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")


def packed(leaves: np.ndarray, every: int) -> bytes:
    """A byte that tells the form, then the sorted leaves or, where that is shorter, a bit for each leaf there is."""
    if len(leaves) * 64 < every:
        return b"l" + np.sort(leaves).astype(np.int64).tobytes()
    bits = np.zeros(every, bool)
    bits[leaves] = True
    return b"b" + np.packbits(bits).tobytes()


class _Block:
    """The vectors of one block and, for every leaf, the rows that lie in it."""

    def __init__(self, ref: np.ndarray, x: np.ndarray, ids: pa.Array, codes: np.ndarray):
        self.ref, self.x, self.ids, self.codes = ref, x, ids, codes
        order = np.argsort(codes.ravel(), kind="stable")
        self.rows, flat = order // codes.shape[1], codes.ravel()[order]
        self.names, first = np.unique(flat, return_index=True)
        self.first = np.append(first, len(flat))

    def candidates(self, leaves: bytes) -> np.ndarray:
        """Rows in any of the packed leaves, each once."""
        if leaves[:1] == b"b":
            return np.flatnonzero(np.unpackbits(np.frombuffer(leaves, np.uint8, offset=1)).view(bool)[self.codes].any(axis=1))
        wanted = np.frombuffer(leaves, np.int64, offset=1)
        at = np.searchsorted(self.names, wanted)
        at = at[self.names[np.minimum(at, len(self.names) - 1)] == wanted]
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.rows[a:b] for a, b in zip(self.first[at].tolist(), self.first[at + 1].tolist()))]))

    def best(self, q: np.ndarray, leaves: bytes, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the best entries, their scores in a fixed order of summation, and how many were scored."""
        own = self.candidates(leaves)
        near, room = self.x[own] @ q, k + 1 + SLACK
        if len(own) > room:
            least = np.partition(near, len(near) - room)[len(near) - room]
            pick = np.flatnonzero(near >= least)
            if len(pick) > room:  # ties at the edge: the smallest ids stay
                pick = pick[np.lexsort((self.ref[own[pick]], -near[pick]))[:room]]
        else:
            pick = np.arange(len(own))
        rows = own[pick]
        return rows, (q[None, :] * self.x[rows]).sum(axis=1), len(own)


def _rerank(batches: Iterable[pa.RecordBatch], k: int, scored: Accumulator | None) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each block's vectors before its queries, to each query's best entries."""
    key, held, block = None, [], None
    for whole in batches:
        names = whole.column("part").to_numpy(), whole.column("sub").to_numpy(), whole.column("kind").to_numpy()
        change = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), whole.num_rows]):
            if a == b:
                continue
            run = whole.slice(a, b - a)
            now = (names[0][a], names[1][a])
            if now != key:
                key, held, block = now, [], None
            if names[2][a] == 0:
                held.append(run)
                continue
            if block is None and held:
                t = pa.Table.from_batches(held).combine_chunks()
                column = lambda c: t.column(c).combine_chunks()  # noqa: B023, E731
                block = _Block(column("h2").to_numpy(), _matrix(column("vec")), column("ids"), column("codes").flatten().to_numpy().reshape(t.num_rows, -1))
                held = []
            if block is None:
                continue
            found = [block.best(q, leaves, k) for q, leaves in zip(_matrix(run.column("vec")), run.column("leaves").to_pylist())]
            if scored is not None:
                scored.add(sum(f[2] for f in found))
            who = pa.array(np.repeat(np.arange(run.num_rows), [len(f[0]) for f in found]))
            at, scores = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([run.column("h1").take(who), run.column("h2").take(who), pa.array(scores), block.ids.take(pa.array(at))], ["h1", "h2", "score", "ids"])

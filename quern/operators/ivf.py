"""Approximate nearest neighbours: an inverted file of cells with product-quantised codes, exact distances for what it finds.

Cells are the k-means centres of a bounded sample. What a vector differs from its cell's centre by is cut into PARTS pieces, each named by the nearest of 256 typical pieces, so a code
is PARTS bytes. A query looks into the cells whose centres suit it best; as many as held ``RECALL`` of the true neighbours of some sampled queries. There a matrix product with the decoded vectors picks
REFINE x k candidates a query, whose exact distances decide. Every vector is coded; the sample bounds only what is fitted.

A cell of many vectors (copies) is dealt out in blocks of BLOCK codes, each a task's group, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from quern.functions.vectors import DISTANCES
from quern.operators.knn import nearest
from quern.settings import DEFAULTS, positive
from quern.sources.tables import settled, small

#: Vectors that are fitted at most, cells at most, bytes of a code, values of one of them, rounds of fitting.
SAMPLE, MAX_CELLS, PARTS, VALUES, ROUNDS = 20_000, 4096, 16, 256, 8
#: Codes of a block; candidates times k whose exact distance is taken, and at least so many; queries that are multiplied at once.
BLOCK, REFINE, LEAST, AT_ONCE = 1 << 16, 40, 200, 64
#: Share of true neighbours that the cells looked into have to hold, and the queries that this is measured with.
RECALL, PROBED = 0.97, 100
SEED = 7


@dataclass
class Quantiser:
    """centres: (cells, size); pieces: (parts, VALUES, size / parts); unit: vectors are brought to length 1."""

    centres: np.ndarray
    pieces: np.ndarray
    unit: bool

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        if self.unit:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return x.astype(np.float32)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _closest(x, self.centres)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = _cut(x - self.centres[cell], len(self.pieces))
        return np.stack([_closest(rest[:, i], self.pieces[i]) for i in range(len(self.pieces))], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: int) -> np.ndarray:
        found = np.concatenate([self.pieces[i][codes[:, i]] for i in range(len(self.pieces))], axis=1)
        return found[:, : self.centres.shape[1]] + self.centres[cell]

    def order(self, q: np.ndarray, metric: str) -> np.ndarray:
        """Cells of each query, the most promising first."""
        dots = q @ self.centres.T
        return np.argsort(-dots if metric != "l2sq" else (self.centres**2).sum(1)[None, :] - 2 * dots, axis=1, kind="stable")


@dataclass
class IvfIndex:
    """codes: cell, block, vec_id, code; written down. probes: cells that a query looks into."""

    quantiser: Quantiser
    codes: DataFrame
    blocks: DataFrame  # cell, blocks
    metric: str
    probes: int


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([np.argmax(x[a : a + step] @ centres.T - half, axis=1) for a in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width), padded with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _typical(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n centres of the rows, by Lloyd's rounds."""
    centres = x[rng.choice(len(x), n, replace=len(x) < n)].copy()
    for _ in range(ROUNDS):
        mine = _closest(x, centres)
        total, count = np.zeros_like(centres), np.bincount(mine, minlength=n)
        np.add.at(total, mine, x)
        some = count > 0
        centres[some] = total[some] / count[some, None]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long), embedding (doubles) of the rows that hold a whole vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(vectors: DataFrame, metric: str = "ip", sample: int = SAMPLE, cells: int | None = None) -> Quantiser | None:
    """A quantiser of the vectors of the most common length, from ``sample`` of them by hash of their ids; None without vectors."""
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {sorted(DISTANCES)}, not {metric!r}")
    length = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return None
    some = vectors.where(F.size("embedding") == length.d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("embedding").combine_chunks()
    made = Quantiser(np.zeros((1, length.d), np.float32), np.zeros((PARTS, VALUES, 1), np.float32), metric == "cosine")
    x = made.prepared(_matrix(some))
    cells = cells or int(min(MAX_CELLS, max(1, length.n**0.5), max(1, len(x) // 8)))
    spark = vectors.sparkSession
    if cells > 1:
        frame = spark.createDataFrame(pa.table({"x": pa.array(list(x.astype(np.float64)))})).select(array_to_vector("x").alias("features"))
        made.centres = np.array(KMeans(k=cells, seed=SEED, maxIter=ROUNDS).fit(frame).clusterCenters(), np.float32)
    else:
        made.centres = x.mean(axis=0, keepdims=True)
    rng = np.random.default_rng(SEED)
    rest = _cut(x - made.centres[made.cells(x)], PARTS)
    made.pieces = np.stack([_typical(rest[:, i], VALUES, rng) for i in range(PARTS)])
    return made


def build(vectors: DataFrame, queries: DataFrame | None = None, metric: str = "ip", k: int | None = None, sample: int = SAMPLE, cells: int | None = None) -> IvfIndex | None:
    """Index of (vec_id, embedding). ``probes`` is measured with PROBED of ``queries`` (query_id, query_vec), or of the vectors themselves."""
    k = int(positive("k", k, DEFAULTS.top_k))
    rows = usable(vectors)
    made = fit(rows, metric, sample, cells)
    if made is None:
        return None
    size = made.centres.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(made)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), size))
            x = q.prepared(_matrix(batch.column("embedding")))
            if len(x):
                cell = q.cells(x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(list(map(bytes, q.codes(x, cell))), pa.binary())], ["vec_id", "cell", "code"])

    coded = settled(rows.mapInArrow(code, "vec_id long, cell int, code binary"))
    blocks = settled(coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))  # a row a cell
    dealt = coded.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = (rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")) if queries is None else queries).orderBy(F.xxhash64("query_id"), "query_id").limit(PROBED)
    return IvfIndex(made, dealt.select("cell", "block", "vec_id", "code"), blocks, metric, _probes(made, rows, coded, asked, metric, k))


def _probes(made: Quantiser, rows: DataFrame, coded: DataFrame, asked: DataFrame, metric: str, k: int) -> int:
    """Cells that hold RECALL of the true neighbours of ``asked``."""
    asked = settled(asked)
    true = nearest(rows, asked, k, metric).select("query_id", "vec_id").join(coded.select("vec_id", "cell"), "vec_id").select("query_id", "cell").toArrow()
    own = asked.where(F.size("query_vec") == made.centres.shape[1]).toArrow()
    if not own.num_rows or not true.num_rows:
        return len(made.centres)
    order = made.order(made.prepared(_matrix(own.column("query_vec").combine_chunks().cast(pa.list_(pa.float64())))), metric)
    place = {q: np.argsort(o) for q, o in zip(own.column("query_id").to_pylist(), order)}
    ranks = np.sort([place[q][c] for q, c in zip(true.column("query_id").to_pylist(), true.column("cell").to_pylist()) if q in place])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1


def search(index: IvfIndex, vectors: DataFrame, queries: DataFrame, k: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest found of ``vectors`` (vec_id, embedding), by exact distance, ties to the smaller id. Queries of another length find nothing."""
    k = int(positive("k", k, DEFAULTS.top_k))
    made, metric, probes, more = index.quantiser, index.metric, index.probes, max(LEAST, REFINE * k)
    size, kind = made.centres.shape[1], queries.schema["query_id"].dataType
    whole = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).where((F.size("query_vec") == size) & F.forall("query_vec", lambda x: x.isNotNull()))
    shared = queries.sparkSession.sparkContext.broadcast(made)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                cells = q.order(q.prepared(_matrix(part.column("query_vec"))), metric)[:, :probes]
                who = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), part.column("query_id").take(who), part.column("query_vec").take(who)], ["cell", "query_id", "query_vec"])

    asked = whole.mapInArrow(look, StructType([StructField("cell", IntegerType()), whole.schema["query_id"], whole.schema["query_vec"]])).join(F.broadcast(index.blocks), "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("binary").alias("code"), "query_id", "query_vec")
    held = index.codes.select("cell", "block", F.lit(0).alias("kind"), "vec_id", "code", F.lit(None).cast(kind).alias("query_id"), F.lit(None).cast("array<double>").alias("query_vec"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        now, ids, codes, near = None, [], [], None
        for batch in batches:
            cell, block, of = (batch.column(c).to_numpy() for c in ("cell", "block", "kind"))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (of[1:] != of[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if (cell[a], block[a]) != now:
                    now, ids, codes, near = (cell[a], block[a]), [], [], None
                part = batch.slice(a, b - a)
                if not of[a]:
                    ids.append(part.column("vec_id").to_numpy())
                    codes.append(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(b - a, -1))
                    continue
                if near is None and ids:
                    ids, near = [np.concatenate(ids)], q.decoded(np.concatenate(codes), int(cell[a]))
                for some in (part.slice(i, AT_ONCE) for i in range(0, part.num_rows if near is not None else 0, AT_ONCE)):
                    score = q.prepared(_matrix(some.column("query_vec"))) @ near.T
                    if metric == "l2sq":
                        score -= (near**2).sum(1)[None, :] / 2
                    m = min(more, near.shape[0])
                    pick = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(np.repeat(np.arange(some.num_rows), m))), pa.array(ids[0][pick.ravel()]), pa.array(np.take_along_axis(score, pick, 1).ravel())], ["query_id", "vec_id", "close"])

    schema = StructType([StructField("query_id", kind), StructField("vec_id", LongType()), StructField("close", FloatType())])
    found = held.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(compare, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("close"), "vec_id")
    found = settled(found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= more).select("query_id", "vec_id"))
    exact = found.join(usable(vectors).join(small(found.select("vec_id").distinct()), "vec_id", "left_semi"), "vec_id").join(whole, "query_id")
    exact = exact.select("query_id", "vec_id", F.round(DISTANCES[metric](F.col("query_vec"), F.col("embedding")), digits).cast(DoubleType()).alias("distance")).distinct()
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return exact.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

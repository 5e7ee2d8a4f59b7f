"""Exact nearest neighbours of a set of query vectors, and diversity-aware selection.

Up to ``QUERY_BLOCK`` queries are broadcast as one matrix: a task multiplies slices of its part of the corpus with it and holds only the k best a
query (and ranking group). More queries than that meet the corpus in a shuffle: vectors are dealt into parts of about ``PART_BYTES``,
each part is one task's matrix, and all queries stream past it in blocks. Either way vectors are scanned once, nothing is collected but
the one bounded block, and what goes on is queries x tasks x k rows; a final row_number merges them.

Only ids, vectors and other numbers are read for that: texts and other columns of any width are read afterwards, by a join with the rows that were found. Ids alone are read first, to know whether one has
several rows; only then are wide columns hashed, to tell these apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, MapType, StringType, StructField, StructType

from quern.functions.vectors import DISTANCES
from quern.settings import DEFAULTS, positive
from quern.sources.tables import settled, small

QUERY_BLOCK = 2000
#: Of the vectors that one task holds while queries stream past it.
PART_BYTES = 32 << 20
#: Distances that a task computes at once, and candidates beyond k that it scores again one by one.
CELLS, SLACK = 1 << 21, 4
DIGITS = 6


def nearest(corpus: DataFrame, queries: DataFrame, k: int | None = None, metric: str = "l2sq", within: list[str] | None = None, where: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """query_id, the corpus' columns but ``embedding``, distance, score (1 - distance) and rank.

    ``corpus`` has ``vec_id`` and ``embedding``, ``queries`` has ``query_id`` and ``query_vec``. ``where`` filters before the k are taken; ``within`` names columns
    that each have a ranking of their own (a collection). Ties, after rounding, go to the smaller vec_id. Vectors that are null, hold a null or
    have another length than the queries' take no part.
    """
    k = int(positive("k", k, DEFAULTS.top_k))
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {sorted(DISTANCES)}, not {metric!r}")
    within = within or []
    corpus = corpus if where is None else corpus.where(where)
    columns = [c for c in corpus.columns if c != "embedding"]
    wide = [c for c in columns if c not in ("vec_id", *within) and isinstance(corpus.schema[c].dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    marked = corpus.withColumn("vec_id", F.col("vec_id").cast("long"))
    key = ["vec_id"]
    if wide and marked.select("vec_id").groupBy("vec_id").count().where("count > 1").limit(1).count():  # one id, several rows: told apart by their hash
        marked = marked.withColumn("_row", F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(corpus.schema[c].dataType, MapType) else F.col(c) for c in wide]))
        key = ["vec_id", "_row"]
    kept = [c for c in marked.columns if c not in wide and c != "embedding"]
    vectors = marked.select(*kept, F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    asked = asked.where(F.col("query_vec").isNotNull() & ~F.exists("query_vec", lambda x: x.isNull()))
    schema = StructType([queries.schema["query_id"], *[vectors.schema[c] for c in kept], StructField("distance", DoubleType())])
    block = asked.limit(QUERY_BLOCK + 1).toArrow()
    if block.num_rows <= QUERY_BLOCK:
        shared = vectors.sparkSession.sparkContext.broadcast(_Queries(block.column("query_id").combine_chunks(), block.column("query_vec").combine_chunks()))
        found = vectors.mapInArrow(lambda batches: _task_best(batches, shared.value, kept, within, k, metric, digits), schema)
    else:
        found = _dealt(vectors, asked, kept, within, k, metric, digits, schema)
    best = Window.partitionBy("query_id", *within).orderBy("distance", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if wide:
        found = settled(found)
        rows = marked.select(*key, *wide).join(small(found.select(*key).distinct()), key, "left_semi").dropDuplicates(key)
        found = found.join(rows, key)
    return found.select("query_id", *columns, "distance", "rank", F.round(F.lit(1.0) - F.col("distance"), digits).alias("score"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows), by one matrix product."""
    dots = q @ x.T
    if metric == "l2sq":
        return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * dots
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            dots = dots / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :])
        return 1 - np.where(np.isfinite(dots), dots, -np.inf)
    return 1 - dots


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of pairs of rows, summed in a fixed order."""
    if metric == "l2sq":
        return ((q - x) ** 2).sum(1)
    dots = (q * x).sum(1)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            dots = dots / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))
    return 1 - dots


class _Queries:
    """Query ids and, by length of their vectors, (places, matrix)."""

    def __init__(self, ids: pa.Array, vecs: pa.Array):
        lengths = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
        self.ids, self.by_length = ids, {int(n): (np.flatnonzero(lengths == n), _matrix(vecs.filter(pa.array(lengths == n)))) for n in np.unique(lengths)}


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """One number for each combination of values."""
    out = np.zeros(n, np.int64)
    for c in columns:
        out = out * (n + 2) + c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
    return out


def _pairs(batch: pa.RecordBatch, asked: _Queries, within: list[str], k: int, metric: str, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, distance) of what may be among a query's best in this batch."""
    sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    vec_id = batch.column("vec_id").to_numpy(zero_copy_only=False)
    groups = _codes([batch.column(c) for c in within], batch.num_rows)
    for length, (who, q) in asked.by_length.items():
        for group in np.unique(groups):
            rows = np.flatnonzero((sizes == length) & (groups == group))
            step = max(1, CELLS // max(1, len(q)))
            for start in range(0, len(rows), step):
                own = rows[start : start + step]
                x = _matrix(batch.column("embedding").take(pa.array(own)))
                near = _distances(metric, q, x)
                m = min(k + SLACK, len(own))
                pick = np.argpartition(near, m - 1, axis=1)[:, :m]
                edge = np.take_along_axis(near, pick, 1).max(axis=1)
                crowded = np.flatnonzero((near <= edge[:, None] + 10.0**-digits).sum(axis=1) > m)
                for r in crowded.tolist():  # ties at the edge, once rounded: the smaller ids
                    pick[r] = np.lexsort((vec_id[own], np.round(near[r], digits)))[:m]
                row, col = np.repeat(np.arange(len(q)), m), pick.ravel()
                yield who[row], own[col], np.round(_exact(metric, q[row], x[col]), digits) + 0.0


class _Best:
    """The k best rows a query (and ranking group) so far."""

    def __init__(self, asked: _Queries, kept: list[str], within: list[str], k: int):
        self.asked, self.kept, self.within, self.k, self.held = asked, kept, within, k, None

    def add(self, batch: pa.RecordBatch, metric: str, digits: int) -> None:
        for who, rows, near in _pairs(batch, self.asked, self.within, self.k, metric, digits):
            some = np.isfinite(near)
            who, rows, near = who[some], rows[some], near[some]
            fresh = pa.table({**{f"c{i}": batch.column(c).take(pa.array(rows)) for i, c in enumerate(self.kept)}, "who": pa.array(who), "near": pa.array(near)})
            held = fresh if self.held is None else pa.concat_tables([self.held, fresh])
            who, near, vec_id = held.column("who").to_numpy(), held.column("near").to_numpy(), held.column(f"c{self.kept.index('vec_id')}").to_numpy()
            groups = _codes([held.column(f"c{self.kept.index(c)}").combine_chunks() for c in self.within], held.num_rows)
            order = np.lexsort((vec_id, near, groups, who))
            new = np.append(True, (who[order][1:] != who[order][:-1]) | (groups[order][1:] != groups[order][:-1])) if len(order) else np.zeros(0, bool)
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
            self.held = held.take(pa.array(order[place < self.k]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None and self.held.num_rows:
            cols = [self.asked.ids.take(self.held.column("who").combine_chunks()), *(self.held.column(f"c{i}").combine_chunks() for i in range(len(self.kept))), self.held.column("near").combine_chunks()]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", *self.kept, "distance"])


def _task_best(batches: Iterable[pa.RecordBatch], asked: _Queries, kept: list[str], within: list[str], k: int, metric: str, digits: int) -> Iterator[pa.RecordBatch]:
    best = _Best(asked, kept, within, k)
    for batch in batches:
        best.add(batch, metric, digits)
    yield from best.rows()


def _dealt(vectors: DataFrame, asked: DataFrame, kept: list[str], within: list[str], k: int, metric: str, digits: int, schema: StructType) -> DataFrame:
    """The same rows by a shuffle: each part's vectors first, then every query. Repeated ids are spread by the scan's own parts."""
    size = vectors.agg(F.sum(F.size("embedding") * F.lit(8)).alias("bytes")).first().bytes or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    part = F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(parts)).cast("int")
    empty = [F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in kept]
    rows = vectors.select(part.alias("_part"), F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), *kept, "embedding")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(1).alias("_kind"), "query_id", *empty, F.col("query_vec").alias("embedding"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for whole in batches:
            part, kind = whole.column("_part").to_numpy(), whole.column("_kind").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                if a == b:
                    continue
                if part[a] != now:
                    now, held = part[a], []
                if kind[a] == 0:
                    held.append(whole.slice(a, b - a))
                    continue
                for start in range(a, b, QUERY_BLOCK):
                    block = whole.slice(start, min(QUERY_BLOCK, b - start))
                    yield from _task_best(held, _Queries(block.column("query_id"), block.column("embedding")), kept, within, k, metric, digits)

    return rows.unionByName(every).repartition(parts, "_part").sortWithinPartitions("_part", "_kind").mapInArrow(run, schema)


def over_threshold(found: DataFrame, least: float | None = None) -> DataFrame:
    """Of ranked rows those of score ``least`` or more; a filter after the k were taken."""
    return found.where(F.col("score") >= (DEFAULTS.min_relevance if least is None else least))


def max_marginal_relevance(corpus: DataFrame, queries: DataFrame, k: int | None = None, fetch_k: int = 20, weight: float = 0.5) -> DataFrame:
    """query_id, vec_id, rank: greedy choice among the ``fetch_k`` nearest of what is near the query and unlike what was chosen.

    The choice is sequential; each query's ``fetch_k`` rows are one small group.
    """
    k = int(positive("k", k, DEFAULTS.top_k))
    near = nearest(corpus.withColumn("vec", F.col("embedding")), queries, fetch_k, "l2sq").join(queries, "query_id").select("query_id", "vec_id", "rank", "vec", "query_vec")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        vectors = unit(np.stack(rows.vec.to_list()).astype(float))
        to_query = np.round(vectors @ unit(np.stack(rows.query_vec.to_list()[:1]).astype(float))[0], DIGITS + 6)
        chosen: list[int] = []
        while len(chosen) < min(k, len(rows)):
            alike = np.max(vectors @ vectors[chosen].T, axis=1) if chosen else np.zeros(len(rows))
            gain = np.round(weight * to_query - (1 - weight) * alike if chosen else to_query, DIGITS + 6)
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
        return pd.DataFrame({"query_id": rows.query_id.iloc[chosen], "vec_id": rows.vec_id.iloc[chosen], "rank": range(1, len(chosen) + 1)})

    return near.groupBy("query_id").applyInPandas(choose, "query_id long, vec_id long, rank int")

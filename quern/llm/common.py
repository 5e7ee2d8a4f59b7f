"""Session helpers and Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import checkpoint_folder, spread

#: Bytes of text that one vectorised step works on; its temporary arrays take some 80 times as much.
PIECE_BYTES = 1 << 20


def ensure_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder in ``spark.checkpoint.dir``; a local session without it gets a folder of its own, any other an error."""
    checkpoint_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that lost executors cost no lineage."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under the checkpoint folder; executors and driver all see it."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`shared_folder` named, whose tables nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that :func:`join_hot` broadcasts at most, and the rows that any of them has more than.
HOT_KEYS, HOT_LEAST = 10_000, 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Inner join of many rows with one row a key, of which some may stand for a large part of ``left``.

    ``right``'s column ``rows`` says how many rows of ``left`` have the key. Keys with over 1/HOT_KEYS of all rows are at most HOT_KEYS, so they are broadcast, whatever the size
    of the data; the others are shuffled. Both sides are read more than once: pass written tables.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).first().n
    least = max(HOT_LEAST, total // HOT_KEYS)
    hot, cold = right.where(F.col(rows) > least).drop(rows), right.where(F.col(rows) <= least).drop(rows)
    if hot.isEmpty():
        return left.join(cold, on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rest.unionByName(left.join(F.broadcast(hot), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_pieces(df: DataFrame, text: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = PIECE_BYTES) -> DataFrame:
    """``df`` with ``step`` applied to slices of bounded size; no shuffle, no state from slice to slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, most):
                out = step(piece)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of the given sizes."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)

"""Readers of the test tables and of page and PDF-like sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it is known to have no more rows than this.
MAX_BROADCAST_ROWS = 50_000

PAGES = "source_file string, page int, content string"


#: Tables of up to so many bytes may lie in too few pieces for the cores; a core gets this much at least.
SPREAD_MOST, SPREAD_LEAST = 1 << 30, 1 << 19


def spread(rows: DataFrame) -> DataFrame:
    """A scan that lies in fewer pieces than there are cores (one small file) dealt out evenly; any other as it is.

    Only small tables are moved: a large one has pieces enough, and is never shuffled here.
    """
    plan = rows._jdf.queryExecution()
    size, cores = int(str(plan.optimizedPlan().stats().sizeInBytes())), rows.sparkSession.sparkContext.defaultParallelism
    wanted = min(cores, size // SPREAD_LEAST)
    return rows.repartition(wanted) if size <= SPREAD_MOST and plan.toRdd().getNumPartitions() < wanted else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a local session without one gets a folder of its own, any other an error, as its executors would not see it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once however often it is used, and safe from lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as Parquet in the shared folder: as :func:`settled`, but compressed, and read by column and by ranges of values."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task aggregates, on average, where :func:`tasks_for` says how many tasks there are.
ROWS_A_TASK = 1_000_000


def tasks_for(rows: DataFrame, count: Column) -> int:
    """So many that each gets ROWS_A_TASK of ``count``, an aggregate of ``rows`` that foresees what is to come, and no fewer than any other shuffle has."""
    wanted = -(-int(rows.agg(F.coalesce(count, F.lit(0))).first()[0]) // ROWS_A_TASK)
    return max(wanted, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_pages(spark: SparkSession, path: str, split: Callable[[bytes], list[str]]) -> DataFrame:
    """One row a page of every file under ``path``; ``split`` turns a file's bytes into the texts of its pages.

    There is no PDF parser among Spark's own sources: pass one (for plain text ``lambda b: b.decode().split("\\f")``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path.rsplit("/", 1)[-1], n, text) for path, content in zip(batch.path, batch.content) for n, text in enumerate(split(bytes(content)))]
            yield pd.DataFrame(rows, columns=["source_file", "page", "content"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, PAGES)


def read_collections(spark: SparkSession, paths: dict[str, str | None], split: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of several collections; a collection whose path is None or absent has no rows."""
    out = spark.createDataFrame([], PAGES).withColumn("collection", F.lit(""))
    for collection, path in paths.items():
        if path is not None and _exists(spark, path):
            out = out.unionByName(read_pages(spark, path, split).withColumn("collection", F.lit(collection)))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

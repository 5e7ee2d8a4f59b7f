"""A chunk store: a folder of Parquet for each collection, written in versions so that a job that dies leaves the last good one.

A change writes its own collection only. The version before stays for whoever still reads it; older ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.settings import DEFAULTS, Settings
from quern.sources.tables import settled, small

CHUNKS = "chunk_id string, collection string, source_file string, page int, chunk_index int, content string"
KINDS = ("disease", "scheme")


class ChunkStore:
    def __init__(self, spark: SparkSession, base: str, settings: Settings = DEFAULTS):
        self.spark, self.base, self.settings = spark, base.rstrip("/"), settings

    def name(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"collection must be one of {KINDS}, not {kind!r}")
        return self.settings.disease_collection if kind == "disease" else self.settings.scheme_collection

    def _fs(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(str(s.getPath().getName()) for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def _versions(self, collection: str) -> list[int]:
        """Versions of a collection that were written to their end."""
        fs, where = self._fs(f"{self.base}/{collection}")
        return sorted(int(n[1:]) for n in self._folders(f"{self.base}/{collection}") if n[:1] == "v" and n[1:].isdigit() and fs.exists(where.suffix(f"/{n}/_SUCCESS")))

    def read(self, kind: str | None = None) -> DataFrame:
        """All chunks, or those of one collection, whose folder alone is read then."""
        names = self._folders(self.base) if kind is None else [self.name(kind)]
        last = [f"{self.base}/{n}/v{v[-1]}" for n in names if (v := self._versions(n))]
        return self.spark.read.schema(CHUNKS).parquet(*last) if last else self.spark.createDataFrame([], CHUNKS)

    def _write(self, rows: DataFrame, collection: str) -> None:
        done = self._versions(collection)
        rows.write.mode("overwrite").parquet(f"{self.base}/{collection}/v{(done or [0])[-1] + 1}")
        for old in done[:-1]:
            fs, where = self._fs(f"{self.base}/{collection}/v{old}")
            fs.delete(where, True)

    def add(self, chunks: DataFrame, kind: str) -> DataFrame:
        """Upsert by chunk_id; of new rows with one id the last (by chunk_index) stays. Returns the ids. A missing id is ``<kind>_<chunk_index>``."""
        given = F.coalesce("chunk_id", F.concat(F.lit(f"{kind}_"), F.col("chunk_index").cast("string")))
        self._write(upserted(self.read(kind), chunks.withColumns({"chunk_id": given, "collection": F.lit(self.name(kind))})), self.name(kind))
        return chunks.select(given.alias("chunk_id"))

    def drop(self, kind: str) -> None:
        """Drop one collection; anything but "disease" is the scheme one."""
        gone = self.name("disease" if kind == "disease" else "scheme")
        if self._versions(gone):
            self._write(self.spark.createDataFrame([], CHUNKS), gone)

    def stats(self) -> DataFrame:
        """collection, n for both collections, 0 where there is none."""
        return collection_stats(self.read(), [self.name(k) for k in KINDS])


class BucketedStore(ChunkStore):
    """The same store with each collection dealt into buckets by chunk_id: a change writes the buckets that it touches, and no other file is read or written.

    A bucket is replaced when the whole write is done; a job that dies before leaves all of them, and one that dies while they are moved leaves each bucket old or new, so that running the same
    upsert again ends in the same state. ``buckets`` counts for a new collection; one that is there keeps its own number.
    """

    def __init__(self, spark: SparkSession, base: str, settings: Settings = DEFAULTS, buckets: int = 64):
        super().__init__(spark, base, settings)
        if buckets < 1:
            raise ValueError("a collection has a bucket at least")
        self.buckets = buckets

    def _layout(self, collection: str) -> tuple[str, int] | None:
        """Folder and number of buckets of a collection that is there."""
        found = [n for n in self._folders(f"{self.base}/{collection}") if n.startswith("buckets-")]
        return (f"{self.base}/{collection}/{found[0]}", int(found[0].split("-")[1])) if found else None

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(CHUNKS + ", bucket int").option("basePath", folder).parquet(folder)

    def read(self, kind: str | None = None) -> DataFrame:
        names = self._folders(self.base) if kind is None else [self.name(kind)]
        out = self.spark.createDataFrame([], CHUNKS)
        for layout in filter(None, map(self._layout, names)):  # a folder a collection
            out = out.unionByName(self._rows(layout[0]).drop("bucket"))
        return out

    def add(self, chunks: DataFrame, kind: str) -> DataFrame:
        collection = self.name(kind)
        folder, n = self._layout(collection) or (f"{self.base}/{collection}/buckets-{self.buckets}", self.buckets)
        given = F.coalesce("chunk_id", F.concat(F.lit(f"{kind}_"), F.col("chunk_index").cast("string")))
        named = chunks.withColumns({"chunk_id": given, "collection": F.lit(collection)})
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        new = settled(upserted(self.spark.createDataFrame([], CHUNKS), named).withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int")))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # n at most
        if touched:
            rows = new
            if self._layout(collection):
                old = self._rows(folder).where(F.col("bucket").isin(touched))
                rows = old.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*columns, "bucket").unionByName(new.select(*columns, "bucket"))
            rows.repartition(min(n, len(touched)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
        return named.select("chunk_id")

    def drop(self, kind: str) -> None:
        gone = self.name("disease" if kind == "disease" else "scheme")
        fs, where = self._fs(f"{self.base}/{gone}")
        fs.delete(where, True)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows whose (collection, chunk_id) are not among the new, and the last of the new rows of each."""
    last = Window.partitionBy("collection", "chunk_id").orderBy(F.desc("chunk_index"), F.desc("content"))
    new = new.withColumn("_at", F.row_number().over(last)).where("_at = 1").select(*old.columns)
    return old.join(new.select("collection", "chunk_id"), ["collection", "chunk_id"], "left_anti").select(*old.columns).unionByName(new)


def collection_stats(chunks: DataFrame, names: list[str]) -> DataFrame:
    fixed = chunks.sparkSession.createDataFrame([(n,) for n in names], "collection string")
    counts = chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(counts, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


def save_lexical_index(docs: DataFrame, path: str) -> None:
    """BM25 statistics of (doc, content): postings and document frequencies as Parquet; nothing is unpickled when they are read."""
    from quern.operators.lexical import document_frequency, postings

    postings(docs, []).write.mode("overwrite").parquet(f"{path}/postings")
    document_frequency(docs).write.mode("overwrite").parquet(f"{path}/terms")


def load_lexical_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")


def search_lexical_index(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc, score, rank by BM25 from a saved index."""
    from quern.operators.lexical import bm25_weight, idf, query_terms

    held, terms = index
    asked = query_terms(queries)
    sizes = held.select("doc", "dl").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    scored = held.join(small(asked), "term").join(terms, "term").join(F.broadcast(sizes), F.lit(True))
    scored = scored.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("qtf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def save_tfidf(model: tuple[DataFrame, DataFrame], path: str) -> None:
    model[0].write.mode("overwrite").parquet(f"{path}/terms")
    model[1].write.mode("overwrite").parquet(f"{path}/weights")


def load_tfidf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/weights")

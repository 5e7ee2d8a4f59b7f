"""Caches as tables: embeddings by content key, responses by query hash with a time to live."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quern.functions.text import cache_key
from quern.settings import DEFAULTS
from quern.sources.tables import settled


def cache_stats(requests: DataFrame) -> DataFrame:
    """hits, misses, distinct_keys, hit_rate of (text) requests against a cache that starts empty and forgets nothing: one count a key."""
    keys = requests.select(cache_key(F.col("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("misses"))
    hits = F.col("total") - F.col("misses")
    return total.select(hits.alias("hits"), "misses", F.col("misses").alias("distinct_keys"), F.round(hits / F.greatest("total", F.lit(1)), 4).alias("hit_rate"))


#: Requests that one task replays after another.
CHUNK = 100_000


def lru_hits(requests: DataFrame, size: int = DEFAULTS.embedding_cache_size, chunk: int | None = None) -> DataFrame:
    """``requests`` (key, ord: 1, 2, ... without gaps, as :func:`quern.operators.bloom.arrivals` gives) with hit, against a cache that keeps the ``size`` keys used last.

    What the cache holds at any time are the ``size`` keys of the latest uses before it. So each chunk of requests is summed up as its own last ``size`` keys; a
    chunk's start is those of the chunks before, as far back as it takes to have ``size`` of them, and chunks are replayed at the same time.
    """
    chunk = chunk or CHUNK
    rows = settled(requests.withColumn("_chunk", F.floor((F.col("ord") - 1) / chunk)))
    recent = Window.partitionBy("_chunk").orderBy(F.desc("last"))
    last = rows.groupBy("_chunk", "key").agg(F.max("ord").alias("last")).withColumn("_at", F.row_number().over(recent)).where(F.col("_at") <= size).drop("_at")
    last = settled(last)
    # A chunk with ``size`` keys makes all before it forgotten: it opens a run of chunks that need no other.
    full = last.groupBy("_chunk").agg((F.count(F.lit(1)) >= size).cast("int").alias("full"))
    runs = full.withColumn("_run", F.sum("full").over(Window.orderBy("_chunk"))).select("_chunk", "_run")  # a row a chunk
    key_type = requests.schema["key"].dataType

    def starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        run = now = None
        for batch in batches:
            chunks, keys, ords = [], [], []
            for r, c, k, at in zip(*(batch.column(x).to_pylist() for x in ("_run", "_chunk", "key", "last"))):
                if r != run:
                    run, now, held = r, c, {}
                if c != now:  # the next chunk starts with what all before it leave
                    held = dict(sorted(held.items(), key=lambda x: -x[1])[:size])
                    chunks += [c] * len(held)
                    keys += held.keys()
                    ords += held.values()
                    now = c
                held[k] = at
            if chunks:
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(keys, batch.column("key").type), pa.array(ords, pa.int64())], ["_chunk", "key", "ord"])

    # The chunk that opens the next run starts with what the run before it leaves: each run is closed by a copy of that chunk's number.
    summed = last.join(runs, "_chunk")
    opening = runs.withColumn("_before", F.lag("_run").over(Window.orderBy("_chunk"))).where(F.col("_before") != F.col("_run")).select(F.col("_before").alias("_run"), "_chunk")
    closing = summed.join(opening.withColumnRenamed("_chunk", "_next"), "_run").groupBy("_run", "_next").agg(F.max("last").alias("last"), F.max_by("key", "last").alias("key")).select("_run", F.col("_next").alias("_chunk"), "key", "last")
    ordered = summed.select("_run", "_chunk", "key", "last").unionByName(closing.select("_run", "_chunk", "key", "last")).repartition("_run").sortWithinPartitions("_run", "_chunk", "last")
    start = ordered.mapInArrow(starts, StructType([StructField("_chunk", LongType()), StructField("key", key_type), StructField("ord", LongType())]))
    names = requests.columns
    empty = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in names if c not in ("key", "ord")]
    both = start.select("_chunk", F.lit(0).alias("_kind"), "key", "ord", *empty).unionByName(rows.withColumn("_kind", F.lit(1)).withColumn("ord", F.col("ord").cast("long")))

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        now = None
        for batch in batches:
            hits, asked = [], []
            for i, (c, kind, k) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("_chunk", "_kind", "key")))):
                if c != now:
                    now, held = c, OrderedDict()
                if kind:
                    hits.append(k in held)
                    asked.append(i)
                held[k] = None
                held.move_to_end(k)
                if len(held) > size:
                    held.popitem(last=False)
            rows = batch.take(pa.array(asked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(hits, pa.bool_())], [*names, "hit"])

    fields = [StructField(f.name, LongType()) if f.name == "ord" else f for f in requests.schema.fields]
    return both.repartition("_chunk").sortWithinPartitions("_chunk", "_kind", "ord").mapInArrow(replay, StructType([*fields, StructField("hit", BooleanType())]))


def lru_stats(requests: DataFrame, size: int = DEFAULTS.embedding_cache_size, chunk: int | None = None) -> DataFrame:
    """hits, misses, cached, hit_rate of (text, ord) requests against an embedding cache of ``size`` keys that starts empty."""
    hits = lru_hits(requests.select(cache_key(F.col("text")).alias("key"), "ord"), size, chunk)
    total = hits.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"), F.least(F.count_distinct("key"), F.lit(size)).alias("cached"))
    return total.withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 4))


def embed_cached(requests: DataFrame, cache: DataFrame, embed: Callable[[pd.Series], pd.Series], size: int = DEFAULTS.embedding_cache_size) -> tuple[DataFrame, DataFrame]:
    """(requests with vector and was_cached, the cache after them). ``cache`` is (key, vector[, used]); a missing key is embedded once, however often it is asked for.

    The cache keeps the ``size`` keys used last; ``used`` is the number of the batch, and keys of one batch that do not all fit stay by their order.
    """
    keyed = requests.withColumn("key", cache_key(F.col("text")))
    model = F.pandas_udf(embed, "array<double>")
    cache = settled(cache if "used" in cache.columns else cache.withColumn("used", F.lit(0).cast("long")))  # of bounded size, and read several times
    batch = (cache.agg(F.max("used")).first()[0] or 0) + 1
    asked = keyed.groupBy("key").agg(F.min("text").alias("text"))
    fresh = asked.join(cache.select("key"), "key", "left_anti").select("key", model("text").alias("vector"), F.lit(batch).cast("long").alias("used"), F.lit(False).alias("was_cached"))
    known = cache.join(asked.select("key", F.lit(True).alias("_asked")), "key", "left")
    known = known.select("key", "vector", F.when(F.col("_asked"), batch).otherwise(F.col("used")).cast("long").alias("used"), F.lit(True).alias("was_cached"))
    all_ = settled(known.unionByName(fresh))
    kept = all_.orderBy(F.desc("used"), "key").limit(size).select("key", "vector", "used")
    return keyed.join(all_.drop("used"), "key").drop("key"), kept


def warm(cache: DataFrame, texts: DataFrame, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    return embed_cached(texts.select("text"), cache, embed)[1]


def cleared(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def ttl_hits(requests: DataFrame, seconds: int = DEFAULTS.response_ttl_seconds) -> DataFrame:
    """``requests`` (key, ts) with hit: whether an entry younger than ``seconds`` was there; a hit does not prolong an entry, and a request without a time is none.

    Whether a request misses depends on the miss before it, so a key's requests are gone through in order. A gap of ``seconds`` or more always
    ends in a miss, so runs between such gaps are independent and are dealt out apart, which spreads a hot key. Such gaps lie between, never within, spans of ``seconds`` on the clock: the first and last request of each
    key and span, from a grouped aggregation, say where runs begin, and no task orders all requests of a key. Then rows stream past in order and only the last entry's expiry is held.
    """
    names, width = requests.columns, seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ordered = requests.withColumn("_at", at).withColumn("_span", F.col("_at") - F.pmod(F.col("_at"), F.lit(width)))
    spans = ordered.groupBy("key", "_span").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    before = Window.partitionBy("key").orderBy("_span")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(before) >= width).cast("int"), F.lit(1))
    runs = spans.withColumn("_opens", opens).select(F.col("key").alias("_key"), F.col("_span").alias("_of"), F.sum("_opens").over(before).alias("_run"))
    ordered = ordered.join(runs, F.col("key").eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_of"))).select(*names, "_at", "_run")
    ordered = ordered.repartition("key", "_run").sortWithinPartitions("key", "_run", "_at")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, 0
        for batch in batches:
            hits = []
            for key, run, at in zip(batch.column("key").to_pylist(), batch.column("_run").to_pylist(), batch.column("_at").to_pylist()):
                hit = at is not None and (key, run) == last and at < until
                if not hit and at is not None:
                    last, until = (key, run), at + seconds * 1_000_000
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hits, pa.bool_())], [*names, "hit"])

    return ordered.mapInArrow(walk, StructType([*requests.schema.fields, StructField("hit", BooleanType())]))

"""Streams of requests: first of a key within a time, a response cache with a time to live, and windowed counts."""

from __future__ import annotations

import bisect
import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.settings import DEFAULTS

#: The state store that stateful processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet folder, or of one file, with the schema of what is there now; ts is made a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    # a file source wants a folder or a pattern; this pattern fits the folder or the file itself
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def first_requests(stream: DataFrame, key: list[str], delay: str = "30 minutes") -> DataFrame:
    """The first request of each key within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def ttl_cache(stream: DataFrame, seconds: int = DEFAULTS.response_ttl_seconds, delay: str = "30 minutes") -> DataFrame:
    """key, ts, hit for each request (key string, ts). State is one expiry a key, dropped when event time has passed it."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        hits = []
        for ts in rows["ts"]:
            at = ts.value // 1000
            hits.append(until is not None and at < until)
            if not hits[-1]:
                until = at + seconds * 1_000_000
        state.update((until,))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(until // 1000, mark + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "hit": hits})

    keyed = stream.select("key", "ts").withWatermark("ts", delay)
    return keyed.groupBy("key").applyInPandasWithState(walk, "key string, ts timestamp, hit boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)


class _Entries(StatefulProcessor):
    """Some keys: the requests of each that wait for the watermark and when its entry ends (microseconds), and what their timer is set to (milliseconds), in one value, which is read and written once a batch."""

    def __init__(self, seconds: int, kind: str):
        self.life, self.kind = seconds * 1_000_000, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", f"keys array<{self.kind}>, until array<long>, waiting array<array<long>>, wake long")

    def _settle(self, fresh: dict, mark: int, rung: int | None = None) -> Iterator[Row]:
        """Judge, in order of time, what no request can come before any more; keep the rest, and wake when it or an entry is due. Spark deletes the timer that has rung."""
        *held, timer = self.entries.get() or ([], [], [], None)
        keys = {key: (until, waiting) for key, until, waiting in zip(*held)}
        left_keys, dues = [], []
        for key in {**keys, **fresh}:
            until, waiting = keys.get(key, (None, []))
            ats = sorted([*waiting, *fresh.get(key, [])])
            n = bisect.bisect_left(ats, (mark + 1) * 1000)
            for at in ats[:n]:
                hit = until is not None and at < until
                yield Row(key=key, at=at, hit=hit)
                if not hit:
                    until = at + self.life
            left = ats[n:]
            if until is not None and until // 1000 <= mark and not (left and left[0] < until):
                until = None  # nothing that may still come can hit it
            if left or until is not None:
                left_keys.append((key, until, left))
                dues += [*(at // 1000 for at in left[:1]), *([until // 1000] if until is not None else [])]
        wake = max(min(dues), mark + 1) if dues else None
        if wake != timer:
            if timer is not None and timer != rung:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if wake is None:
            self.entries.clear()
        else:
            self.entries.update((*map(list, zip(*left_keys)), wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh: dict = {}
        for r in rows:
            fresh.setdefault(r.key, []).append(r.at)
        yield from self._settle(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._settle({}, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


#: Groups that keys are dealt out to by hash, unless told otherwise.
BUCKETS = 1024


def response_cache(stream: DataFrame, seconds: int = DEFAULTS.response_ttl_seconds, delay: str = "30 minutes", buckets: int = BUCKETS) -> DataFrame:
    """key, ts, hit for each request (key, ts), judged in order of ts however the requests come: as :func:`quern.operators.caches.ttl_hits`, for a stream.

    A request waits in its key's state until the watermark has passed it, so that those out of order by up to ``delay`` take their place; later ones are dropped. A timer wakes it for
    what waits and when its entry ends; then nothing of the key is kept. State is thus the requests of the last ``delay``, and an expiry for each key of the last ``seconds``. Needs :func:`rocksdb_state` while the stream starts.

    A group's calls to the state store take milliseconds, so keys share states and timers, in ``buckets`` groups by their hash; they should grow with the keys.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    keyed = stream.select(bucket, "key", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", delay)
    kind = stream.schema["key"].dataType.simpleString()
    judged = keyed.groupBy("bucket").transformWithState(_Entries(seconds, kind), f"key {kind}, at long, hit boolean", "append", "EventTime")
    return judged.select("key", F.timestamp_micros("at").alias("ts"), "hit")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, dealt out to ``tasks`` (or the session's number): each of them starts a Python of its own in every batch."""
    asked = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    before = {name: spark.conf.get(name, None) for name in asked}
    for name, value in asked.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Rows of a file that a stream reads, on average of the fullest part.
ROWS_A_FILE = 250_000


def arriving_in_parts(rows: DataFrame, folder: str, order: str, parts: int, close: DataFrame | None = None, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """``rows`` written to ``folder`` in so many parts one after the other, by equal ranges of the number ``order``, then ``close``; and the stream that takes a part a batch.

    Every part has the same number of files, so that a batch is so many: as many as the fullest part has ``rows_a_file``. A part with fewer rows than files is filled up with empty ones.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - F.lit(low)) * parts / F.lit(max((high or 0) - (low or 0), 1))), F.lit(parts - 1))
    fullest = 0 if low is None else rows.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0]
    files = max(1, -(-fullest // rows_a_file))
    schema = rows.drop(order).schema
    for n in range(parts if low is not None else 0):
        own = rows.where(part == n).drop(order)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)
        for _ in range((n + 1) * files - len(spark.read.schema(schema).parquet(folder).inputFiles())):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(folder)
    if close is not None:
        close.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "30 minutes") -> DataFrame:
    """window_start, event_type, n, total."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def drain(stream: DataFrame, folder: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a stream over all that is there now, into Parquet under ``folder``, and read the result.

    An appended batch is written whole, so a repeated batch replaces itself. A complete result goes to a folder of its own for each batch, and the last one is read, so that nobody's rows are
    overwritten. ``progress`` gets the batches' reports.
    """
    spark = stream.sparkSession
    out = f"{folder}/rows"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last[:] = [number]

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    if not last and mode == "append":
        return spark.createDataFrame([], stream.schema)
    read = spark.read.schema(_plain(stream))
    return (read.parquet(out) if mode == "append" else read.parquet(f"{out}/batch={last[0]}")).select(*stream.columns)


def new_folder(root: str) -> str:
    return f"{root}/stream-{uuid.uuid4().hex}"


def _plain(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

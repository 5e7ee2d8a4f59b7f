"""The response cache over a stream, against the batch form."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators import caches
from quern.streaming import requests as rq

START = datetime(2024, 1, 1)


def test_out_of_order_late_and_expired(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), START + timedelta(seconds=rng.randrange(4000)), 0) for _ in range(150)] + [(f"k{i}", START + timedelta(seconds=17 * i), 0) for i in range(200)]
    frame = spark.createDataFrame([(k, ts, int(ts.timestamp()) + rng.randrange(300)) for k, ts, _ in rows], "key string, ts timestamp, arrival long")
    late = ("a", START + timedelta(seconds=5))  # after the watermark has passed it: dropped
    tail = spark.createDataFrame([(None, START + timedelta(seconds=9000))], "key string, ts timestamp")
    stream = rq.arriving_in_parts(frame, str(tmp_path / "in"), "arrival", 5, tail)
    spark.createDataFrame([late, (None, START + timedelta(seconds=9001))], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    progress = []
    with rq.rocksdb_state(spark):
        out = rq.drain(rq.response_cache(stream, 100, "10 minutes"), str(tmp_path / "out"), progress=progress)
    key = lambda r: (r.key or "", r.ts, r.hit)
    want = sorted(caches.ttl_hits(frame.select("key", "ts"), 100).collect(), key=key)
    got = sorted(out.where("key is not null").collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and any(r.hit for r in got)
    sizes = [sum(s.numRowsTotal for s in p.stateOperators) for p in progress if p.stateOperators]
    assert max(sizes) >= 5 * sizes[-1]  # what has expired is kept no more


def test_no_requests(spark, tmp_path):
    frame = spark.createDataFrame([], "key string, ts timestamp, arrival long")
    tail = spark.createDataFrame([(None, START)], "key string, ts timestamp")
    with rq.rocksdb_state(spark):
        assert rq.drain(rq.response_cache(rq.arriving_in_parts(frame, str(tmp_path / "in"), "arrival", 3, tail), 10), str(tmp_path / "out")).where("key is not null").count() == 0


def test_complete_results_keep_to_their_batch(spark, tmp_path):
    rows = spark.createDataFrame([(START + timedelta(hours=i), "x", 1.0, i) for i in range(6)], "ts timestamp, event_type string, value double, arrival long")
    stream = rq.arriving_in_parts(rows, str(tmp_path / "in"), "arrival", 3)
    out = rq.drain(rq.windowed_counts(stream), str(tmp_path / "out"), "complete")
    assert out.count() == 6 and out.agg(F.sum("n")).first()[0] == 6

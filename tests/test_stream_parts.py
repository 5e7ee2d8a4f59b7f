"""Requests that come in several files a part, and keys that share a state."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators import caches
from quern.streaming import requests as rq

START = datetime(2024, 1, 1)


def test_parts_of_several_files_and_shared_states(spark, tmp_path):
    rng = random.Random(7)
    # the third quarter has two requests, fewer than files
    seconds = [s for s in (rng.randrange(8000) for _ in range(900)) if not 3900 <= s < 6100] + [4500, 5000]
    rows = [(rng.choice([None, *"abcdefgh"]), START + timedelta(seconds=s), s + rng.randrange(100)) for s in seconds]
    frame = spark.createDataFrame(rows, "key string, ts timestamp, arrival long").repartition(3)
    tail = spark.createDataFrame([("end", START + timedelta(seconds=20_000))], "key string, ts timestamp")
    stream = rq.arriving_in_parts(frame, str(tmp_path / "in"), "arrival", 4, tail, rows_a_file=60)
    files = len(spark.read.parquet(str(tmp_path / "in")).inputFiles()) - 1
    assert files % 4 == 0 and files > 8
    progress = []
    with rq.rocksdb_state(spark, 3):
        out = rq.drain(rq.response_cache(stream, 100, "3 minutes", 2), str(tmp_path / "out"), progress=progress)
    read = [p.numInputRows for p in progress if p.numInputRows]
    assert len(read) == 5 and read[2] == 2 and read[4] == 1 and sum(read) == len(rows) + 1
    key = lambda r: (r.key or "", r.ts, r.hit)
    want = sorted(caches.ttl_hits(frame.select("key", "ts"), 100).collect(), key=key)
    got = sorted(out.where("key is null or key <> 'end'").collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and any(r.hit for r in got)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and out.select(F.count_distinct("key")).first()[0] >= 8

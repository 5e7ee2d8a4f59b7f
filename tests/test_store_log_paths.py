"""Buckets of the store, the log of stages, the TF-IDF pipeline, and shortest paths with an end."""

import heapq
import logging
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quern.operators import graph, lexical, tfidf_pipeline
from quern.plans.stage_log import StageLog
from quern.sources.store import CHUNKS, BucketedStore, upserted


def files(path):
    return {str(p.relative_to(path)): (p.stat().st_mtime_ns, p.read_bytes()) for p in path.rglob("*.parquet")}


def chunk(i, text="old", index=0):
    return (f"c{i}", None, "book", i, index, text)


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    db = BucketedStore(spark, str(tmp_path / "db"), buckets=8)
    rows = spark.createDataFrame([chunk(i) for i in range(200)], CHUNKS)
    assert db.add(rows, "disease").count() == 200
    db.add(rows.limit(20), "scheme")
    before = files(tmp_path / "db")
    change = spark.createDataFrame([chunk(7, "new"), chunk(7, "newest", 1), chunk(1000, "more")], CHUNKS)
    db.add(change, "disease")
    after = files(tmp_path / "db")
    touched = {f"buckets-8/bucket={r.b}" for r in change.select(F.pmod(F.xxhash64("chunk_id"), F.lit(8)).alias("b")).distinct().collect()}
    kept = {n for n in before if not any(f"citrus_diseases/{t}/" in n for t in touched)}
    assert kept and all(after[n] == before[n] for n in kept)  # byte for byte, and never written again
    held = {r.chunk_id: r.content for r in db.read("disease").collect()}
    assert len(held) == 201 and held["c7"] == "newest" and held["c1000"] == "more" and db.read("disease").count() == 201
    want = upserted(rows.withColumn("collection", F.lit("x")), change.withColumn("collection", F.lit("x")))
    assert {r.chunk_id: r.content for r in want.collect()} == held
    db.add(change, "disease")  # again: nothing changes
    assert {r.chunk_id: r.content for r in db.read("disease").collect()} == held
    assert {r.collection: r.n for r in db.stats().collect()} == {"citrus_diseases": 201, "government_schemes": 20}
    db.drop("scheme")
    assert db.read("scheme").count() == 0 and db.read().count() == 201
    assert BucketedStore(spark, str(tmp_path / "db"), buckets=3).add(change, "disease").count() == 3  # keeps its 8
    assert db.read("disease").count() == 201


def test_empty_store_and_rows_without_ids(spark, tmp_path):
    db = BucketedStore(spark, str(tmp_path / "db"))
    assert db.read().count() == 0 and db.read("disease").count() == 0
    db.add(spark.createDataFrame([], CHUNKS), "disease")
    db.drop("disease")
    extra = spark.createDataFrame([(None, "x", "s", 1, 4, "text", 9)], CHUNKS + ", bucket int")
    db.add(extra, "scheme")
    assert [(r.chunk_id, r.collection) for r in db.read().collect()] == [("scheme_4", "government_schemes")]
    with pytest.raises(ValueError):
        BucketedStore(spark, "x", buckets=0)


def test_stage_log(spark, caplog):
    log = StageLog(spark)
    with caplog.at_level(logging.INFO, logger="quern"):
        even = log.stage("even", spark.range(10), lambda rows: rows.where("id % 2 = 0"))
        twice = log.stage("twice", even, lambda rows: rows.unionByName(rows))
    assert [(r.ord, r.stage, r.rows_in, r.rows_out) for r in log.table().collect()] == [(1, "even", 10, 5), (2, "twice", 5, 10)]
    assert all(r.ms > 0 for r in log.table().collect()) and twice.count() == 10
    assert [m.getMessage().split(",")[0] for m in caplog.records] == ["even: 10 rows in", "twice: 5 rows in"]
    assert StageLog(spark).table().count() == 0


def test_ingest_into_buckets_with_a_log(spark, tmp_path):
    from quern.plans.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book.txt").write_text("some words of a page. " * 200 + "\f" + "another page")
    log, db = StageLog(spark), BucketedStore(spark, str(tmp_path / "db"), buckets=4)
    split = lambda b: b.decode().split("\f")
    stats = {r.collection: r.n for r in ingest(spark, {"disease": str(tmp_path / "in")}, str(tmp_path / "db"), split, store=db, log=log).collect()}
    (cut, kept) = log.table().orderBy("ord").collect()
    assert (cut.stage, kept.stage, cut.rows_in) == ("chunk disease", "store disease", 2) and cut.rows_out == kept.rows_in == kept.rows_out == stats["citrus_diseases"]


def test_pipeline_equals_the_join_form_and_survives_saving(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["the", "and", "x"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(120)] + [(500, None), (501, "")], "doc long, content string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(9)] + [(90, None), (91, "nothing of it")], "query_id long, question string")
    model = tfidf_pipeline.fit(docs, max_features=200)
    model.write().save(str(tmp_path / "model"))
    rows = lambda f: sorted(tuple(r) for r in f.select("query_id", "doc", "score", "rank").collect())
    want = rows(lexical.tfidf_corpus(lexical.tfidf_fit(docs, max_features=200), asked))
    assert rows(tfidf_pipeline.search(model, docs, asked)) == want
    assert rows(tfidf_pipeline.search(PipelineModel.load(str(tmp_path / "model")), docs, asked)) == want
    assert rows(tfidf_pipeline.search(tfidf_pipeline.fit(docs.limit(0)), docs.limit(0), asked)) == []


def queue(edges, start, end, max_cost):
    links = {}
    for a, b, _, w, _ in edges:
        links.setdefault(a, []).append((b, w))
    cost, path, done, heap = {start: 0.0}, {start: [start]}, set(), [(0.0, start)]
    while heap:
        far, here = heapq.heappop(heap)
        if here in done:
            continue
        done.add(here)
        if here == end:
            break
        if far > max_cost:
            continue
        for there, w in links.get(here, ()):
            if there not in done and far + w < cost.get(there, float("inf")):
                cost[there], path[there] = far + w, [*path[here], there]
                heapq.heappush(heap, (cost[there], there))
    return {(start, i): (c, path[i]) for i, c in cost.items()}


@pytest.mark.parametrize(("seed", "end", "max_cost"), [(1, "n5", float("inf")), (2, "n3", 1.0), (3, None, 0.75), (4, "nowhere", float("inf")), (5, "n0", float("inf"))])
def test_dijkstra_as_a_queue_finds_paths(spark, seed, end, max_cost):
    rng = random.Random(seed)
    found = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "r", rng.choice([0.25, 0.5, 1.0]), i) for i in range(34)]
    nodes = spark.createDataFrame([(f"n{i}", "t", f"N{i}", {}) for i in range(12)], graph.NODES)
    starts = spark.createDataFrame([("n0",), ("n1",), ("unknown",)], "start string")
    got = graph.dijkstra(nodes, spark.createDataFrame(found, graph.EDGES), starts, end, max_cost).collect()
    assert {(r.start, r.id): (r.cost, r.path) for r in got} == queue(found, "n0", end, max_cost) | queue(found, "n1", end, max_cost)
    strict = graph.dijkstra(nodes, spark.createDataFrame(found, graph.EDGES), starts, end, max_cost, strict_max_cost=True)
    assert all(r.cost <= max_cost for r in strict.collect())

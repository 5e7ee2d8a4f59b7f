"""The inverted file with product-quantised codes against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import ivf, knn
from quern.plans import catalogue

VECTORS = "vec_id long, embedding array<double>"


def recall(found, true):
    f, t = ({(r.query_id, r.vec_id) for r in x.select("query_id", "vec_id").collect()} for x in (found, true))
    return len(f & t) / len(t)


@pytest.mark.parametrize("metric", ["ip", "l2sq", "cosine"])
def test_recall_and_exact_distances(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24)) * 0.4
    x[100:160] = x[100]  # a group of copies
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0, None]), (9003, [1.0] * 5), (None, [1.0] * 24)], VECTORS).repartition(4)
    queries = vectors.where("vec_id % 60 = 0 and vec_id < 6000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = ivf.build(vectors, queries, metric)
    got, true = ivf.search(index, vectors, queries, 10).collect(), knn.nearest(vectors.where("vec_id < 6000"), queries, 10, metric)
    assert recall(spark.createDataFrame(got), true) >= 0.9
    assert index.probes < len(index.quantiser.centres) / 2 or metric == "ip"
    want = {(r.query_id, r.vec_id): r.distance for r in true.collect()}
    assert all(abs(r.distance - want[r.query_id, r.vec_id]) < 1e-5 for r in got if (r.query_id, r.vec_id) in want)
    assert sorted(r["rank"] for r in got if r.query_id == 0) == list(range(1, 11))


def test_codes_are_small_and_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 50)
    x = np.random.default_rng(1).normal(size=(20, 64))
    vectors = spark.createDataFrame([(i, x[0 if i < 400 else i % 20].tolist()) for i in range(600)], VECTORS)
    index = ivf.build(vectors, metric="l2sq", cells=4)
    assert index.codes.count() == 600 and index.codes.agg(F.max(F.octet_length("code"))).first()[0] * 10 < 64 * 4
    assert max(r["count"] for r in index.codes.groupBy("cell", "block").count().collect()) < 150
    got = ivf.search(index, vectors, vectors.where("vec_id in (3, 401)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 3)
    assert sorted((r.query_id, r.vec_id, r.distance) for r in got.collect()) == [(3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0), *((401, i, 0.0) for i in (401, 421, 441))]


def test_no_vectors(spark):
    assert ivf.build(spark.createDataFrame([(1, None)], VECTORS)) is None


def test_query_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    assert recall(catalogue.QUERIES["ivf_ip_batch"](spark, sf), catalogue.QUERIES["knn_ip_batch"](spark, sf)) >= 0.9

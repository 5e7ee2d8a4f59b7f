import math

import numpy as np
from pyspark.sql import functions as F

from quern.llm import ann


def brute(rows, k=20):
    """rows: vec_id -> list. Every query's k best by exact double inner product."""
    fine = {i: v for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in fine.items():
        if i % 20 == 0:
            out[i] = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine.items() if j != i)[:k]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in table.collect()])
    ids, x = np.array(ids), np.array(x, float)
    got, hits, n = answers(ann.search(table)), 0, 0
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, n = hits + len(best & {v for _, v, _ in found}), n + 20
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([x_ for _, _, x_ in found], [s[ids == v][0] for _, v, _ in found], atol=1e-12)
        assert [v for _, v, _ in found] == [v for _, v in sorted((-x_, v) for _, v, x_ in found)]
    assert hits / n >= 0.9


def test_edges_and_ties(spark):
    rows = {0: [1.0, 0.0], 20: [0.0, 2.0], 1: [1.0, 0.0], 2: [0.0, 0.0], 3: [None, 1.0], 4: [float("nan"), 1.0], 5: [float("inf"), 1.0], 6: None, 7: [], 8: [3.0, -1.0], 40: [0.0, 0.0], 60: None}
    rows |= {i: [1.0, 1.0] for i in range(100, 140)}
    table = spark.createDataFrame([*rows.items(), (1, rows[1]), (0, rows[0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    table = table.withColumns({c: F.lit(1) for c in ("part", "score", "rank", "ids", "vec")})
    got = answers(ann.search(table))
    want = brute(rows)
    assert {q: [(n + 1, j, -s) for n, (s, j) in enumerate(v)] for q, v in want.items()} == got
    few = answers(ann.search(table.where("vec_id in (0, 1, 8)")))
    assert few == {0: [(1, 8, 3.0), (2, 1, 1.0)]}
    assert ann.search(table.limit(0)).collect() == []
    assert ann.search(table.where("vec_id = 2")).collect() == []


def test_split_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = brute(dict(data), 5)
    monkeypatch.setattr(ann, "MAX_BLOCK_BYTES", 50 * 8 * 8)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 100 * 8 * 8)
    got = answers(ann.search(table, k=5, probes=10_000))
    assert {q: [v for _, v, _ in a] for q, a in got.items()} == {q: [j for _, j in v] for q, v in want.items()}


def test_shared_queue_pops_the_cheapest_leaves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12))
    forest = ann.Forest(x, 5, trees=3)
    q = x[:40]
    every = forest.nearest_leaves(q, 3 << 5)
    assert all(len(set(r.tolist())) == 3 << 5 for r in every)
    home = forest.leaves(q) + (np.arange(3) << 5)[:, None]
    few = forest.nearest_leaves(q, 12)
    assert all(set(home[:, i].tolist()) <= set(few[i].tolist()) for i in range(40))


def recall(got, ids, x):
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {v for _, v, _ in found})
    return hits / (20 * len(got))


def test_clustered_vectors_need_few_leaves(spark):
    """An index has to do less than exact search where the data allow it: here under a tenth of it, at two sizes."""
    for n in (4000, 16000):
        rng = np.random.default_rng(7)
        middle = rng.normal(size=(n // 100, 16))
        x = (middle[rng.integers(0, len(middle), n)] + rng.normal(size=(n, 16)) * 0.1).astype(np.float32).astype(float)
        ids, scored = np.arange(n), spark.sparkContext.accumulator(0)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = answers(ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), scored=scored))
        assert len(got) == n // 20 and recall(got, ids, x) >= 0.9
        assert scored.value < 0.1 * n * len(got)


def test_depth_follows_the_data():
    """Deeper than the dimensions, and than the sample has nodes for: leaves go on splitting, thresholds stay bounded."""
    x = np.random.default_rng(2).normal(size=(2000, 3))
    forest = ann.Forest(x, 20, trees=2)
    assert forest.depth == 20 and sum(c.size for t in forest.thresholds for c in t) < 4 * len(x)
    assert len(np.unique(forest.leaves(x)[0])) > 1000
    home = forest.codes(x[:50])
    assert all(set(h) <= set(p) for h, p in zip(home.tolist(), forest.nearest_leaves(x[:50], 40).tolist()))


def test_many_equal_queries(spark):
    """A third of all rows share one vector: they are one entry and one query, and every id gets its own answer."""
    rng = np.random.default_rng(4)
    rows = {i: ([1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(600)}
    got = answers(ann.search(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), k=5, probes=10_000))
    assert {q: [v for _, v, _ in a] for q, a in got.items()} == {q: [j for _, j in v] for q, v in brute(rows, 5).items()}

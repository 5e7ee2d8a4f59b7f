"""Corpus-wide TF-IDF: what a fit counts, and a search that shuffles its best alone."""

import math
import random
from collections import Counter

import pyarrow as pa

from quern.operators import lexical, tfidf_pipeline
from quern.operators.tfidf_pipeline import _frequent, _task_best


def texts(n, words, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randrange(30))) for _ in range(n)]


def counted(rows):
    total, df = Counter(), Counter()
    for row in rows:
        terms = [*row, *(f"{a} {b}" for a, b in zip(row, row[1:]))]
        total.update(terms)
        df.update(set(terms))
    return [(t, n, df[t]) for t, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))]


def test_frequent_terms_are_exact(spark):
    rows = [t.split() for t in texts(300, 60)] + [["é"] * 5, []]
    frame = spark.createDataFrame([(r,) for r in rows], "_kept array<string>").repartition(3)
    want = counted(rows)
    for most in (1, 7, 100, len(want), len(want) + 5):
        n, top = _frequent(frame, most)
        assert n == len(rows) and [(r.term, r.total, r.df) for r in top] == want[:most]


def test_search_without_a_join_of_terms(spark):
    held = texts(400, 50) + texts(5, 50) * 2 + ["", None, "nothing of theirs"]
    docs = spark.createDataFrame(list(enumerate(held)), "doc long, content string").repartition(5)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*held[:12], "", None, "unknown"])], "query_id long, question string")
    model = tfidf_pipeline.fit(docs, max_features=300)
    found = tfidf_pipeline.search(model, docs, asked, 7)
    joined = tfidf_pipeline.search(model, docs, asked, 7, max_entries=0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) and found.columns == joined.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_task_best_over_many_batches():
    asked = tfidf_pipeline._Asked(pa.table({"query_id": ["a", "b", "b"], "term": pa.array([0, 0, 2]), "qw": [1.0, 0.5, 0.5]}))
    rng = random.Random(1)
    rows = [(d, {t: rng.randrange(1, 4) / 4 for t in rng.sample(range(4), rng.randrange(4))}) for d in range(5000)]
    rng.shuffle(rows)
    batches = [pa.RecordBatch.from_pydict({"doc": [d for d, _ in part], "i": pa.array([list(x) for _, x in part], pa.list_(pa.int32())), "v": pa.array([list(x.values()) for _, x in part], pa.list_(pa.float64()))})
               for part in (rows[s : s + 500] for s in range(0, 5000, 500))]
    got = sorted(r for b in _task_best(batches, asked, 3, 6) for r in zip(*b.to_pydict().values()))
    want = []
    for q, weights in {"a": {0: 1.0}, "b": {0: 0.5, 2: 0.5}}.items():
        scores = sorted((-sum(w * x.get(t, 0) for t, w in weights.items()), d) for d, x in rows)
        want += [(q, d, -s) for s, d in scores[:3]]
    assert got == sorted(want)


def test_candidates_are_scored_where_their_query_is(spark):
    rng = random.Random(5)
    held = texts(40, 25, 6) + ["", None]
    pairs = [(q, d, i) for q in range(6) for i, d in enumerate(rng.sample(range(len(held)), 20))] + [(9, 0, 0), (9, 1, 1)]
    found = spark.createDataFrame([(q, d, i, held[d]) for q, d, i in pairs], "query_id long, doc long, ord int, content string")
    asks = {**{q: held[q * 3] for q in range(5)}, 5: None, 7: "w1 w2"}  # 9 asks nothing, 7 has no candidates
    asked = spark.createDataFrame(list(asks.items()), "query_id long, question string")
    out = lexical.tfidf_candidates(found, asked, 8, max_features=30)
    want = []
    for query in (*range(6), 9):
        own = [(i, d, (held[d] or "").split()) for q, d, i in pairs if q == query]
        top = counted([words for _, _, words in own])[:30]
        idf = {t: math.log((1 + len(own)) / (1 + df)) + 1 for t, _, df in top}
        vector = lambda words: {t: n * idf[t] for t, n, _ in counted([words]) if t in idf}  # noqa: B023, E731
        size = lambda v: math.sqrt(sum(w * w for w in v.values()))
        q = vector((asks.get(query) or "").split())
        scores = []
        for i, d, words in own:
            v = vector(words)
            dot = sum(w * q.get(t, 0.0) for t, w in v.items())
            scores.append((-round(dot / (size(v) * size(q)), 6) if dot else 0.0, i, d))
        want += [(query, d, -s + 0.0, rank) for rank, (s, i, d) in enumerate(sorted(scores)[:8], 1)]
    assert sorted((r.query_id, r.doc, round(r.score, 6), r["rank"]) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "term#" in line]

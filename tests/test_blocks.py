"""BM25 by blocks against scoring everything."""

import random
import re

import pytest

from quern.operators import blocks, lexical
from quern.sources import tables

DOCS, ASKED = "doc long, content string", "query_id long, question string"


@pytest.mark.parametrize(("seed", "width", "k"), [(1, 4, 3), (2, 1, 5), (3, 50, 2), (4, 1000, 5)])
def test_equal_to_scoring_everything(spark, seed, width, k):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)] + [(300, None), (301, ""), (302, "w1 w1 w1"), (303, "w1 w1 w1")]
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(12)] + [(90, "nowhere"), (91, None), (92, "w1 w1 w2"), (93, "")]
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(asked, ASKED)
    rows = lambda f: sorted(tuple(r) for r in f.select("query_id", "doc", "score", "rank").collect())
    want = rows(lexical.bm25_corpus(d, q, k))
    assert rows(blocks.bm25_blocks(blocks.block_index(d, width=width), q, k)) == want
    assert rows(blocks.bm25_blocks(blocks.block_index(d, lexical.query_terms(q), width), q, k)) == want


def test_blocks_below_the_threshold_stay_closed(spark):
    """A term that every document has is opened only where rarer ones bring a document up."""
    rng = random.Random(7)
    docs = [(i, " ".join(["the"] * rng.randrange(1, 3) + [f"x{rng.randrange(10**6)}" for _ in range(20)] + (["rare", "gem"] if i % 100 == 0 else []))) for i in range(2000)]
    index = blocks.block_index(spark.createDataFrame(docs, DOCS), width=8)
    q = spark.createDataFrame([(1, "the rare gem")], ASKED)
    assert blocks.share_opened(index, q, 5) < 0.15
    assert max(r.n for r in index.blocks.where("term = 'the'").collect()) < 60  # hot terms are split
    assert {r.doc % 100 for r in blocks.bm25_blocks(index, q, 5).collect()} == {0}


def test_no_documents_or_queries(spark):
    d, q = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ASKED)
    assert blocks.bm25_blocks(blocks.block_index(d), q).count() == 0
    assert blocks.bm25_blocks(blocks.block_index(spark.createDataFrame([(1, "a")], DOCS)), q.limit(0)).count() == 0


def test_pairs_of_query_and_document_are_summed_without_a_shuffle(spark):
    d, q = spark.createDataFrame([(i, f"w{i % 5} w{i % 7}") for i in range(60)], DOCS), spark.createDataFrame([(i, f"w{i}") for i in range(7)], ASKED)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan(lexical.bm25_corpus(d, q, 3))  # the k best of each query
    assert not re.search(r"hashpartitioning\(query_id#\d+L, (doc|range)#", plan(lexical.bm25_corpus(d, q, 3)))


def test_bounds_are_summed_where_their_blocks_are(spark, monkeypatch):
    frame = type(spark.range(0))
    dealt, real = [], frame.repartition
    monkeypatch.setattr(tables, "ROWS_A_TASK", 5)
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or real(self, *a))
    d, q = spark.createDataFrame([(i, f"w{i % 5} w{i % 7}") for i in range(200)], DOCS), spark.createDataFrame([(i, f"w{i}") for i in range(7)], ASKED)
    assert blocks.plan(blocks.block_index(d), q, 2)[1].count() > 0
    by_range = [a[0] for a in dealt if a[1:] == ("range",)]
    assert by_range and by_range[0] >= 45 * 7 // 5 > 40  # more tasks as there are more ranges and queries

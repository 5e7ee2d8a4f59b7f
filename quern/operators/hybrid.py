"""Weighted fusion of vector and lexical scores over a query's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.knn import nearest
from quern.operators.lexical import bm25_candidates, tfidf_candidates
from quern.settings import DEFAULTS, Settings, positive
from quern.sources.tables import settled


def candidates(corpus: DataFrame, queries: DataFrame, fetch: int, metric: str = "l2sq", where=None) -> DataFrame:
    """query_id, doc, ord, content, distance and the corpus' other columns: each query's ``fetch`` nearest.

    Queries x ``fetch`` rows, written down: every later step reads them, and the corpus is scanned once.
    """
    found = nearest(corpus, queries, fetch, metric, where=where, digits=12)
    return settled(found.withColumnsRenamed({"vec_id": "doc", "rank": "ord"}).drop("score"))


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int | None = None, settings: Settings = DEFAULTS, metric: str = "l2sq", where=None, digits: int = 6) -> DataFrame:
    """query_id, doc, score, rank, and the corpus' columns.

    ``corpus`` has vec_id, embedding, content; ``queries`` has query_id, query_vec, question. min(3k, 20) candidates come by vector; BM25
    is fitted to them; both scores are divided by their maximum (or 1 if that is not positive) and weighed.
    """
    k = int(positive("k", k, settings.top_k))
    found = candidates(corpus, queries, min(3 * k, 20), metric, where)
    scored = found.join(bm25_candidates(found, queries), ["query_id", "doc"])
    every = Window.partitionBy("query_id")
    top = lambda c: F.when(F.max(c).over(every) > 0, F.max(c).over(every)).otherwise(1.0)
    semantic = 1.0 - F.col("distance")
    mixed = settings.bm25_weight * F.col("bm25") / top(F.col("bm25")) + settings.semantic_weight * semantic / top(semantic)
    best = every.orderBy(F.desc("score"), "ord")
    out = scored.withColumn("score", F.round(mixed, digits))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("bm25", "ord")


def smart_search(corpus: DataFrame, queries: DataFrame, k: int | None = None, settings: Settings = DEFAULTS, metric: str = "l2sq") -> DataFrame:
    """Hybrid search, or the plain nearest where hybrid is off. Both give a score of which higher is better."""
    if settings.enable_hybrid:
        return hybrid_search(corpus, queries, k, settings, metric)
    return nearest(corpus, queries, k or settings.top_k, metric).withColumnRenamed("vec_id", "doc")


def tfidf_search(corpus: DataFrame, queries: DataFrame, k: int | None = None, metric: str = "l2sq") -> DataFrame:
    """query_id, doc, score, rank by TF-IDF over the min(5k, 50) nearest."""
    k = int(positive("k", k, DEFAULTS.top_k))
    return tfidf_candidates(candidates(corpus, queries, min(5 * k, 50), metric), queries, k)


def retriever(corpus: DataFrame, k: int | None = None, metric: str = "l2sq"):
    """A function of queries (query_id, query_vec) to their k nearest of ``corpus``."""
    return lambda queries: nearest(corpus, queries, k, metric)

"""Deduplication, reciprocal rank fusion, feature reranking and thresholds over ranked rows.

Rows are (query_id, collection, rank from 1, content, source, page, score). "First wins" is a row_number over an
explicit order everywhere; nothing relies on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import distinct_tokens, document_key, prefix_key
from quern.operators.dictionary import DISEASE_KEYWORDS, SCHEME_KEYWORDS, prefix_matches
from quern.settings import DEFAULTS, Settings, positive

RRF_K = 60


def first_of(rows: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    taken = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(taken)).where(F.col("_at") == 1).drop("_at")


def dedup_prefix(rows: DataFrame, order: list[Column | str], within: list[str] | None = None, prefix: int = 100) -> DataFrame:
    """One row of each text prefix (lowered, trimmed)."""
    return first_of(rows, [*(within or []), prefix_key(F.col("content"), prefix)], order)


def dedup_documents(rows: DataFrame, order: list[Column | str], within: list[str] | None = None) -> DataFrame:
    """One row of each document key; exact, where a Bloom filter may lose a row."""
    return first_of(rows, [*(within or []), document_key(F.col("content"), F.col("source"), F.col("page"))], order)


def reciprocal_rank_fusion(rows: DataFrame, top: int | None = None, k: int = RRF_K, merge_across: bool = False, digits: int = 9) -> DataFrame:
    """query_id, collection, page, content, source, score, rrf_score, rrf_rank.

    Disease rows that repeat the first 100 characters of an earlier one count towards it if they are of its page, and are dropped if
    not; scheme rows of another page stay. Collections merge only with ``merge_across``.
    """
    head = F.substring(F.coalesce("content", F.lit("")), 1, 100)
    rows = rows.withColumn("_head", head).withColumn("_side", F.when(F.col("collection") == "disease", 0).otherwise(1)).withColumn("_page", F.coalesce(F.col("page").cast("string"), F.lit("None")))
    ahead = Window.partitionBy("query_id", "collection", "_head").orderBy("rank")
    kept = rows.withColumn("_first", F.first("_page").over(ahead)).where((F.col("_side") == 1) | (F.col("_page") == F.col("_first")))
    same = ["query_id", "_page", "_head"] if merge_across else ["query_id", "_side", "_page", "_head"]
    first = lambda c: F.min_by(c, F.struct("_side", "rank")).alias(c)
    fused = kept.groupBy(*same).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("rrf_score"), F.min(F.struct("_side", "rank")).alias("_order"), *[first(c) for c in ("collection", "page", "content", "source", "score")]
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "_order")
    out = fused.withColumn("rrf_rank", F.row_number().over(best))
    out = out if top is None else out.where(F.col("rrf_rank") <= top)
    return out.select("query_id", "collection", "page", "content", "source", "score", "rrf_score", "rrf_rank")


def relevance(question: Column, content: Column, base: Column, disease: tuple[str, ...] = DISEASE_KEYWORDS, scheme: tuple[str, ...] = SCHEME_KEYWORDS) -> Column:
    """min(1, base + shared words + a shared phrase + shared keywords)."""
    q, c = F.lower(question), F.lower(F.coalesce(content, F.lit("")))
    words = F.size(F.array_intersect(distinct_tokens(q), distinct_tokens(c)))
    phrases = F.array(*[F.when(F.length(q) > i, F.substring(q, i + 1, 30)) for i in (0, 15, 30, 45)])
    phrase = F.exists(phrases, lambda p: F.coalesce((F.length(p) > 10) & F.contains(c, p), F.lit(False)))
    keywords = sum(F.size(F.array_intersect(prefix_matches(q, kw), prefix_matches(c, kw))) for kw in (disease, scheme))
    boost = F.least(keywords * 0.03, F.lit(0.2)) + F.when(keywords >= 3, 0.05).otherwise(0.0)
    total = F.coalesce(base, F.lit(0.5)) + F.least(words * 0.04, F.lit(0.25)) + F.when(phrase, 0.15).otherwise(0.0) + boost
    return F.least(total, F.lit(1.0))


def rerank(rows: DataFrame, top: int | None = None, order: str = "rank", settings: Settings = DEFAULTS, digits: int = 6, **keywords) -> DataFrame:
    """``rows`` (with question) with rerank_score and rerank_rank, the best ``top`` a query; ties keep the order of ``order``."""
    top = int(positive("top", top, settings.rerank_top_k))
    scored = rows.withColumn("rerank_score", F.round(relevance(F.col("question"), F.col("content"), F.col("score"), **keywords), digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), order)
    return scored.withColumn("rerank_rank", F.row_number().over(best)).where(F.col("rerank_rank") <= top)


def over_threshold(rows: DataFrame, least: float | None = None) -> DataFrame:
    """Rows whose score or rerank score is ``least`` or more."""
    least = DEFAULTS.min_relevance if least is None else least
    return rows.where((F.coalesce("score", F.lit(0.0)) >= least) | (F.coalesce("rerank_score", F.lit(0.0)) >= least))


def with_fallback(kept: DataFrame, every: DataFrame, order: list[Column | str], top: int | None = None) -> DataFrame:
    """``kept``, and for queries that have no row there their first ``top`` rows of ``every``, marked low_relevance."""
    top = int(positive("top", top, DEFAULTS.rerank_top_k))
    first = Window.partitionBy("query_id").orderBy(*order)
    lost = every.join(kept.select("query_id").distinct(), "query_id", "left_anti").withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= top)
    lost = lost.withColumn("edge_case", F.lit("low_relevance")).withColumn("final_rank", F.col("_at")).drop("_at")
    kept = kept.withColumn("edge_case", F.lit(None).cast("string")).withColumn("final_rank", F.col("rerank_rank"))
    return kept.unionByName(lost, allowMissingColumns=True)

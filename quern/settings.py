"""Defaults of retrieval and ranking, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1500
    chunk_overlap: int = 300
    top_k: int = 5
    min_relevance: float = 0.25
    enable_reranking: bool = True
    rerank_top_k: int = 4
    enable_hybrid: bool = True
    bm25_weight: float = 0.3
    semantic_weight: float = 0.7
    response_ttl_seconds: int = 1800
    response_cache_size: int = 500
    embedding_cache_size: int = 2000
    disease_collection: str = "citrus_diseases"
    scheme_collection: str = "government_schemes"

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "quern.") -> Settings:
        """The defaults, each overridden by ``quern.<name>`` where the session sets it."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(prefix + f.name, None)
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() == "true" if kind is bool else kind(value)
        return replace(cls(), **found)


DEFAULTS = Settings()


def positive(name: str, value: float | None, default: float) -> float:
    """``value``, or ``default`` for None; anything not above zero is an error rather than a silent default."""
    if value is None:
        return default
    if value <= 0:
        raise ValueError(f"{name} must be above 0, not {value}")
    return value

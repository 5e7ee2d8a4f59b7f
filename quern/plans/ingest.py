"""The ingest job: files to chunks to the store, one collection after the other, safe to run again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunking import chunked_pages
from quern.plans.stage_log import StageLog, staged
from quern.settings import DEFAULTS, Settings
from quern.sources.store import KINDS, ChunkStore
from quern.sources.tables import read_collections


def ingest(spark: SparkSession, paths: dict[str, str | None], base: str, split: Callable[[bytes], list[str]], settings: Settings = DEFAULTS, store: ChunkStore | None = None, log: StageLog | None = None) -> DataFrame:
    """Replace each collection (disease, scheme) that has files by their chunks; returns collection, n.

    ``split`` turns a file's bytes into the texts of its pages. Each step writes a version of its own collection, so a job that dies and is
    run again ends in the same state. No file at all is an error. ``store`` is a store of another kind, for ``base``; ``log`` takes down each stage.
    """
    store = store or ChunkStore(spark, base, settings)
    pages = read_collections(spark, {k: paths.get(k) for k in KINDS}, split)
    found = [r.collection for r in pages.select("collection").distinct().collect()]
    if not found:
        raise FileNotFoundError(f"none of {paths} has files")
    for kind in found:
        cut = lambda rows, kind=kind: chunked_pages(rows, kind, settings.chunk_size, settings.chunk_overlap)
        chunks = staged(log, f"chunk {kind}", pages.where(F.col("collection") == kind), cut)
        store.drop(kind)
        began = time.perf_counter()
        store.add(chunks, kind)
        if log:
            log.noted(f"store {kind}", chunks.count(), store.read(kind).count(), began)
    return store.stats()

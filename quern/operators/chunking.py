"""Texts to overlapping chunks: fixed windows in the JVM, and a recursive splitter."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import collected_context, context_block, preprocess_text
from quern.settings import DEFAULTS, positive
from quern.sources.tables import checkpoint_folder, small

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _sizes(size: int | None, overlap: int | None) -> tuple[int, int]:
    size = int(positive("chunk_size", size, DEFAULTS.chunk_size))
    overlap = DEFAULTS.chunk_overlap if overlap is None else overlap
    if not 0 <= overlap < size:
        raise ValueError(f"chunk_overlap must be from 0 up to below {size}, not {overlap}")
    return size, overlap


def window_chunks(text: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """Array of windows of ``size`` characters, each starting ``size - overlap`` after the one before; the last ends at the text's end."""
    size, overlap = _sizes(size, overlap)
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters where the separators allow it, cut at the coarsest separator that the text has.

    A separator opens the piece after it. Pieces are gathered into chunks; a chunk that is full leaves its tail, of at most ``overlap``
    characters, to the next.
    """
    here = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[here], separators[here + 1 :]
    if mark == "":
        parts = list(text)
    else:
        first, *others = text.split(mark)
        parts = [p for p in (first, *(mark + o for o in others)) if p]
    out: list[str] = []
    short: list[str] = []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        out += _gather(short, size, overlap)
        short = []
        out += split_recursively(part, size, overlap, finer) if finer else [part]
    return out + _gather(short, size, overlap)


def _gather(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    first, total = 0, 0
    for n, part in enumerate(parts):
        if total + len(part) > size and n > first:
            out.append("".join(parts[first:n]).strip())
            while total > overlap or (total > 0 and total + len(part) > size):
                total -= len(parts[first])
                first += 1
        total += len(part)
    out.append("".join(parts[first:]).strip())
    return [x for x in out if x]


def recursive_chunks(text: Column, size: int | None = None, overlap: int | None = None, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of chunks by :func:`split_recursively`, some rows at a time: an Arrow batch of whole texts and their chunks would be 10,000 rows however long."""
    size, overlap = _sizes(size, overlap)

    @F.udf("array<string>", useArrow=False)
    def split(text: str | None) -> list[str]:
        return split_recursively(text, size, overlap, separators) if text else []

    return split(text)


def chunked_pages(pages: DataFrame, collection: str | Column, size: int | None = None, overlap: int | None = None, clean: bool = True, chunks: Callable[..., Column] = recursive_chunks) -> DataFrame:
    """chunk_id, collection, source_file, page, chunk_index, content from (source_file, page, content).

    chunk_index counts over all pages of a file, from 0: by page, then by the rows' text, then by place. Pages are sorted by ranges, cut where they then lie, and written once with
    their place in that order; a file's first place is what its chunks' numbers are counted from. So no task holds a file, however long, and texts are cut once.
    """
    text = preprocess_text(F.col("content")) if clean else F.col("content")
    source, page = F.coalesce(F.col("source_file"), F.lit("unknown")), F.coalesce(F.col("page"), F.lit(0))
    collection = F.lit(collection) if isinstance(collection, str) else collection
    rows = pages.select(collection.alias("collection"), source.alias("source_file"), page.alias("page"), text.alias("content")).orderBy("collection", "source_file", "page", "content")
    rows = rows.select("collection", "source_file", "page", F.explode(chunks(F.col("content"), size, overlap)).alias("content")).withColumn("_at", F.monotonically_increasing_id())
    path = f"{checkpoint_folder(pages.sparkSession)}/chunks-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    rows = pages.sparkSession.read.schema(rows.schema).parquet(path)
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    # by (file, range): the file's first row there, and how many; a file lies in consecutive ranges
    parts = rows.groupBy("collection", "source_file", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("collection", "source_file").orderBy("_part")) - F.col("_n")
    parts = parts.select("collection", "source_file", "_part", (before - F.col("_first")).alias("_shift"))
    same = [F.col("r.collection").eqNullSafe(F.col("p.collection")), F.col("r.source_file") == F.col("p.source_file"), F.col("r._part") == F.col("p._part")]
    numbered = rows.alias("r").join(small(parts).alias("p"), same).select("r.collection", "r.source_file", "r.page", (F.col("_row") + F.col("_shift")).cast("int").alias("chunk_index"), "r.content")
    name = F.concat("source_file", F.lit("_page"), F.col("page").cast("string"), F.lit("_chunk"), F.col("chunk_index").cast("string"))
    return numbered.select(name.alias("chunk_id"), "collection", "source_file", "page", "chunk_index", "content")


def contexts(rows: DataFrame) -> DataFrame:
    """query_id, context: each query's sources (rank, source, page, content), numbered and joined."""
    block = context_block(F.col("rank"), F.col("source"), F.col("page"), F.col("content"))
    return rows.groupBy("query_id").agg(collected_context(F.col("rank"), block).alias("context"))

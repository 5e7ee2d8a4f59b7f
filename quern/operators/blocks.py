"""BM25 over an index of blocks: a block is what one range of documents holds of one term, with the most that it can add to a score.

A query first sums bounds: of each range, the most that any of its documents can score. The ranges of the highest sums are scored first, which gives a threshold, the k-th best score there; then only blocks of
ranges whose sum reaches it are opened. The k best documents are all in such ranges, so the result is that of scoring everything. A common term is as many blocks as there are
ranges, so no key holds more than a range's documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.lexical import B, K1, bm25_weight, idf, query_terms
from quern.settings import DEFAULTS, positive
from quern.sources.tables import settled, small, tasks_for, written

#: Documents of a range, on average, and the ranges that are scored first for a threshold, times k. The more documents, the fewer bounds to sum, and the further these are from what one document scores.
WIDTH, SEEDS = 4, 2
#: Scores are rounded to so many digits, so a bound this much below the threshold may still reach it.
DIGITS, CLOSE = 6, 1e-5


@dataclass
class BlockIndex:
    """blocks: term, range, bound, n, entries (an array of doc, weight), written down; width: documents of a range."""

    blocks: DataFrame
    width: int


def block_index(docs: DataFrame, terms: DataFrame | None = None, width: int = WIDTH, k1: float = K1, b: float = B) -> BlockIndex:
    """Index of (doc, content), of all terms or of those in ``terms`` (term), over ranges of ``width`` documents on average, by hash. A doc stands for all rows that have it."""
    words = docs.select("doc", tokens(F.col("content")).alias("words"))
    each = words.select("doc", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))  # "" keeps one row a document
    if terms is not None:
        each = each.join(small(terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()), "term", "left_semi")
    held = written(each.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")))
    total = held.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    ranges = F.greatest(F.floor(F.col("n") / width), F.lit(1))
    df = held.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = held.where("term <> ''").join(df, "term").join(F.broadcast(total), F.lit(True))  # one row
    weighed = weighed.select("term", "doc", F.pmod(F.xxhash64("doc"), ranges).alias("range"), (idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("weight"))
    blocks = weighed.groupBy("term", "range").agg(F.max("weight").alias("bound"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("doc", "weight")).alias("entries"))
    return BlockIndex(written(blocks), width)


def _opened(index: BlockIndex, asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, doc, score of the documents in the ``wanted`` (query_id, range, n) ranges."""
    tasks = tasks_for(wanted, F.sum("n"))
    lists = wanted.join(small(asked), "query_id").select("query_id", "term", "range", "qtf")
    entries = index.blocks.select("term", "range", "entries").repartition(tasks, "term", "range").join(lists.repartition(tasks, "term", "range"), ["term", "range"]).select("query_id", "qtf", F.explode("entries").alias("x"))
    scored = entries.groupBy("query_id", F.col("x.doc").alias("doc")).agg(F.sum(F.col("qtf") * F.col("x.weight")).alias("score"))
    return scored.withColumn("score", F.round("score", DIGITS))


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def plan(index: BlockIndex, queries: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query terms; query_id, range, n: the ranges whose blocks a query has to open, and the postings in them)."""
    k = int(positive("k", k, DEFAULTS.top_k))
    asked = settled(query_terms(queries))
    every = index.blocks.select("term", "range", "bound", "n")
    tasks = tasks_for(every.join(F.broadcast(asked.agg(F.count_distinct("query_id").alias("queries"))), F.lit(True)), (F.max("range") + 1) * F.max("queries"))
    bounds = every.repartition(tasks, "range").join(small(asked), "term")  # a range's sums are made where its blocks are
    bounds = written(bounds.groupBy("query_id", "range").agg(F.sum(F.col("qtf") * F.col("bound")).alias("most"), F.sum("n").alias("n")))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "range")
    first = bounds.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= SEEDS * k).select("query_id", "range", "n")
    reached = _best(_opened(index, asked, first), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = bounds.join(reached, "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - CLOSE))
    return asked, written(open_.select("query_id", "range", "n"))


def bm25_blocks(index: BlockIndex, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc, score, rank: as :func:`quern.operators.lexical.bm25_corpus`, of what ``plan`` opens."""
    k = int(positive("k", k, DEFAULTS.top_k))
    asked, wanted = plan(index, queries, k)
    return _best(_opened(index, asked, wanted), k)


def share_opened(index: BlockIndex, queries: DataFrame, k: int | None = None) -> float:
    """Postings that the queries open, of all that their terms have."""
    asked, wanted = plan(index, queries, k)
    opened = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = index.blocks.select("term", "n").join(small(asked), "term").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return opened / every if every else 0.0

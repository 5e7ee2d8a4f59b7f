"""Corpus-wide TF-IDF as an ML pipeline: tokenizer, stop words, pairs of neighbours, counts, inverse document frequencies, vectors of length 1.

The vocabulary is the ``max_features`` terms of the highest total count, ties by the alphabet, so that a fit is reproducible; that bounds what the driver holds. A fitted pipeline is saved and loaded
by Spark's own writer, and its rows are sparse vectors.

Nearly all pairs of words are rare, so a fit first counts terms by ``BINS`` hash bins, in arrays of the tasks: a bin's count is no less than that of any term in it, and only terms of full bins are counted by
themselves (Park, Chen and Yu). A search multiplies each task's vectors with the queries' and passes on the k best a query, as :mod:`quern.operators.knn` does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.operators.lexical import MAX_FEATURES, STOP_WORDS
from quern.settings import DEFAULTS, positive
from quern.sources.tables import settled, small, written

#: Hash bins of a fit, a power of 2, and rows whose words a task counts at once.
BIN_BITS, ROWS_AT_ONCE = 20, 1000
BINS = 1 << BIN_BITS
#: Terms that a task counts before it passes them on.
TERMS_HELD = 500_000
#: Entries of the queries' vectors that are one broadcast; beyond them a search is a join. Scores, and products of entries, that a task computes at once.
MAX_ENTRIES, CELLS = 1_000_000, 1 << 21


def fit(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, max_features: int = MAX_FEATURES) -> PipelineModel:
    """A pipeline from ``content`` to ``weights``, fitted to the documents (doc, content). Null contents are empty."""
    words = [
        SQLTransformer(statement="SELECT *, coalesce(content, '') AS _content FROM __THIS__"),
        RegexTokenizer(inputCol="_content", outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stop_words)),
    ]
    stages = [
        *words,
        NGram(inputCol="_kept", outputCol="_pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]
    n, top = _frequent(PipelineModel(words).transform(docs.select("content")).select("_kept"), max_features)
    if top:
        weights = [float(np.log((n + 1) / (r.df + 1))) + 1.0 for r in top]
        counts = CountVectorizerModel.from_vocabulary([r.term for r in top], inputCol="_terms", outputCol="_counts")
        smooth = ElementwiseProduct(inputCol="_counts", outputCol="_weights", scalingVec=Vectors.dense(weights))
        stages += [counts, smooth, Normalizer(inputCol="_weights", outputCol="weights", p=2.0)]
    return PipelineModel(stages)


def _frequent(words: DataFrame, most: int) -> tuple[int, list]:
    """Number of rows (_kept), and term, total, df of the ``most`` terms of the highest total among their words and pairs of neighbours."""
    bins = written(words.mapInArrow(_bin_counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")), "bins")
    rows = int(bins.where("bin < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    full = bins.where("bin >= 0")
    edge = full.orderBy(F.desc("n")).limit(most).agg(F.min("n"), F.count("n")).first()
    least = max(1, edge[0] // 2) if edge[1] == most else 1
    while True:
        wanted = np.zeros(BINS, bool)
        wanted[full.where(F.col("n") >= least).select("bin").toArrow().column("bin").to_numpy()] = True  # of BINS
        shared = words.sparkSession.sparkContext.broadcast(wanted)
        counted = words.mapInArrow(lambda batches: _term_counts(batches, shared.value), "term string, total long, df long")  # noqa: B023
        counted = counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
        top = counted.orderBy(F.desc("total"), "term").limit(most).collect()  # max_features at most
        # Terms of other bins have totals under `least`.
        if least == 1 or len(top) == most and top[-1].total >= least:
            return rows, top
        least = top[-1].total if len(top) == most else 1


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct words, their hashes, each word's number among them, its row, whether the next is its row's too), some rows at once."""
    for start in range(0, batch.num_rows, ROWS_AT_ONCE):
        lists = batch.column("_kept").slice(start, ROWS_AT_ONCE)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            continue
        texts, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        yield texts, pd.util.hash_array(texts, categorize=False), codes, row, np.append(row[1:] == row[:-1], False)


def _word_bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _pair_bins(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (hashes[first] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[second] >> np.uint64(7))
    return _word_bins(mixed * np.uint64(0xC2B2AE3D27D4EB4F))


def _bin_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bin, n of a task's terms; bin -1 counts its rows."""
    held, rows = np.zeros(BINS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, hashes, codes, _, followed in _coded(batch):
            at = np.flatnonzero(followed)
            held += np.bincount(_word_bins(hashes)[codes], minlength=BINS)
            held += np.bincount(_pair_bins(hashes, codes[at], codes[at + 1]), minlength=BINS)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], rows))], ["bin", "n"])


def _term_counts(batches: Iterable[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """term, total, df of a task's terms in the wanted bins."""
    held: list[pa.Table] = []
    for batch in batches:
        for texts, hashes, codes, row, followed in _coded(batch):
            at = np.flatnonzero(wanted[_word_bins(hashes)][codes])
            held.append(_counted(codes[at], row[at], lambda own: texts[own]))  # noqa: B023
            at = np.flatnonzero(followed)
            at = at[wanted[_pair_bins(hashes, codes[at], codes[at + 1])]]
            held.append(_counted(codes[at] * len(texts) + codes[at + 1], row[at], lambda own: texts[own // len(texts)] + " " + texts[own % len(texts)]))  # noqa: B023
        if sum(t.num_rows for t in held) > TERMS_HELD:
            held = [_summed(held)]
            if held[0].num_rows > TERMS_HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _summed(held).to_batches(max_chunksize=10_000)


def _counted(keys: np.ndarray, row: np.ndarray, text) -> pa.Table:
    own, codes, total = np.unique(keys, return_inverse=True, return_counts=True)
    df = np.bincount(np.unique(row * max(1, len(own)) + codes) % max(1, len(own)), minlength=len(own))
    return pa.table({"term": pa.array(text(own), pa.string()), "total": pa.array(total.astype(np.int64)), "df": pa.array(df.astype(np.int64))})


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("term").aggregate([("total", "sum"), ("df", "sum")]).rename_columns(["term", "total", "df"])


def weighed(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """key, term (number), w: the entries of each row's vector; rows have ``content``."""
    made = model.transform(rows.select(key, "content"))
    if "weights" not in made.columns:
        return made.select(key, F.lit(0).alias("term"), F.lit(0.0).alias("w")).limit(0)
    vector = F.unwrap_udt("weights")
    return made.select(key, vector["indices"].alias("i"), vector["values"].alias("v")).select(key, F.explode(F.arrays_zip("i", "v")).alias("x")).select(key, F.col("x.i").alias("term"), F.col("x.v").alias("w"))


def search(model: PipelineModel, docs: DataFrame, queries: DataFrame, k: int | None = None, digits: int = 6, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """query_id, doc, score, rank: the k best of (doc, content), a row a document, by cosine for each of (query_id, question), of those that share a term with it.

    Queries of over ``max_entries`` terms in all meet the documents' terms in a join.
    """
    k = int(positive("k", k, DEFAULTS.top_k))
    asked = settled(weighed(model, queries.select("query_id", F.col("question").alias("content")), "query_id").withColumnRenamed("w", "qw"))
    block = asked.limit(max_entries + 1).toArrow()
    made = model.transform(docs.select("doc", "content"))
    if block.num_rows <= max_entries and "weights" in made.columns:
        schema = StructType([asked.schema["query_id"], docs.schema["doc"], StructField("score", DoubleType())])
        vector, shared = F.unwrap_udt("weights"), docs.sparkSession.sparkContext.broadcast(_Asked(block))
        dots = made.select("doc", vector["indices"].alias("i"), vector["values"].alias("v")).mapInArrow(lambda batches: _task_best(batches, shared.value, k, digits), schema)
    else:
        dots = weighed(model, docs, "doc").join(small(asked), "term").groupBy("query_id", "doc").agg(F.round(F.sum(F.col("w") * F.col("qw")), digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return dots.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Asked:
    """Queries by term: those of term t are who[ptr[t] : ptr[t + 1]], with their weights."""

    def __init__(self, rows: pa.Table):
        coded = rows.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        term = rows.column("term").to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.ids, self.who, self.weight = coded.dictionary, coded.indices.to_numpy().astype(np.int64)[order], rows.column("qw").to_numpy()[order]
        self.ptr = np.searchsorted(term[order], np.arange(int(term.max(initial=-1)) + 2))


def _scores(batch: pa.RecordBatch, asked: _Asked) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores by row and query) of some rows at once."""
    lists = batch.column("i")
    term, w = lists.flatten().to_numpy().astype(np.int64), batch.column("v").flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    known = term < len(asked.ptr) - 1
    term, w, row = term[known], w[known], row[known]
    first, n = asked.ptr[term], asked.ptr[term + 1] - asked.ptr[term]
    upto = np.cumsum(np.bincount(row, weights=n, minlength=batch.num_rows))
    q, start = len(asked.ids), 0
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        end = max(start + 1, min(start + CELLS // q, int(np.searchsorted(upto, done + CELLS, "right"))))
        a, b = np.searchsorted(row, [start, end])
        many = n[a:b]
        at = np.arange(many.sum()) + np.repeat(first[a:b] - np.append(0, np.cumsum(many)[:-1])[: len(many)], many)
        cell = np.repeat(row[a:b] - start, many) * q + asked.who[at]
        yield start, np.bincount(cell, weights=np.repeat(w[a:b], many) * asked.weight[at], minlength=(end - start) * q).reshape(end - start, q)
        start = end


def _task_best(batches: Iterable[pa.RecordBatch], asked: _Asked, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """query_id, doc, score of each query's k best in a task."""
    q, held, fresh = len(asked.ids), [], 0
    edge = np.full(q, -1.0)
    for batch in batches if q else ():
        for start, raw in _scores(batch, asked):
            score = np.round(raw, digits)
            least = np.maximum(edge, np.partition(score, -k, axis=0)[-k]) if len(score) > k else edge
            rows, who = np.nonzero((raw > 0) & (score >= least))
            held.append(pa.table({"who": who, "doc": batch.column("doc").take(pa.array(rows + start)), "score": score[rows, who]}))
            fresh += len(rows)
            if fresh > max(q * k, 100_000):
                held, fresh = [_k_best(held, k)], 0
                who, n = np.unique(held[0].column("who").to_numpy(), return_counts=True)
                last = np.cumsum(n) - 1
                edge[who[n == k]] = held[0].column("score").to_numpy()[last[n == k]]
    if held:
        best = _k_best(held, k)
        ids = asked.ids.take(best.column("who").combine_chunks())
        yield from pa.table([ids, best.column("doc"), best.column("score")], names=["query_id", "doc", "score"]).combine_chunks().to_batches(max_chunksize=10_000)


def _k_best(tables: list[pa.Table], k: int) -> pa.Table:
    rows = pa.concat_tables(tables)
    rows = rows.take(pc.sort_indices(rows, [("who", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_start"))
    who = rows.column("who").to_numpy()
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return rows.filter(pa.array(place < k))

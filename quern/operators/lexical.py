"""BM25 and TF-IDF, over a whole corpus or over each query's own candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.settings import DEFAULTS, positive
from quern.sources.tables import small, tasks_for, written

K1, B = 1.5, 0.75
#: English words that TF-IDF leaves out by default; a parameter everywhere.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once "
    "only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with you your".split()
)
MAX_FEATURES = 10_000


def postings(docs: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., doc, term, tf, dl from rows (scope..., doc, content)."""
    words = docs.select(*scope, "doc", tokens(F.col("content")).alias("words"))
    each = words.select(*scope, "doc", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return each.groupBy(*scope, "doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df over all documents (doc, content); words are made distinct a document before they are shuffled."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def sizes(docs: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., n, avgdl."""
    length = F.size(tokens(F.col("content")))
    return docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf (how often the query has it) from (query_id, question)."""
    return queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_candidates(candidates: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc, bm25 of every candidate (query_id, doc, content); statistics are of the query's candidates alone, and 0 without overlap."""
    held = postings(candidates, ["query_id"])
    df = held.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    scored = (
        held.join(query_terms(queries), ["query_id", "term"])
        .join(df, ["query_id", "term"])
        .join(sizes(candidates, ["query_id"]), "query_id")
        .groupBy("query_id", "doc")
        .agg(F.sum(F.col("qtf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("bm25"))
    )
    return candidates.select("query_id", "doc").join(scored, ["query_id", "doc"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def bm25_corpus(docs: DataFrame, queries: DataFrame, k: int | None = None, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """query_id, doc, score, rank: the k best of the whole corpus a query, of those that share a word with it.

    The corpus is tokenised once: words that no query has are dropped before the shuffle (a broadcast join where the queries' words are few enough), and
    every document keeps one row without a word, for the number of documents and their mean length. These postings are written down, since document
    frequencies, sizes and scores all read them, and dealt out by document, so that a document's scores are summed where its postings are: none of the pairs of query and document is shuffled but the best.
    """
    k = int(positive("k", k, DEFAULTS.top_k))
    asked = query_terms(queries)
    wanted = small(asked.select("term").union(queries.sparkSession.createDataFrame([("",)], "term string")).distinct())
    words = docs.select("doc", tokens(F.col("content")).alias("words"))
    each = words.select("doc", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term")).join(wanted, "term", "left_semi")
    held = written(each.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), "postings")
    total = held.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = held.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asking = F.broadcast(asked.agg(F.count_distinct("query_id").alias("queries")))
    tasks = tasks_for(held.where("term = ''").join(asking, F.lit(True)), F.count(F.lit(1)) * F.max("queries"))
    scored = (
        held.where("term <> ''").repartition(tasks, "doc").join(small(df), "term").join(small(asked), "term").join(F.broadcast(total), F.lit(True))  # one row
        .groupBy("query_id", "doc")
        .agg(F.round(F.sum(F.col("qtf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)), digits).alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tfidf_terms(content: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two or more characters but the stop words, and pairs of neighbours among what is left."""
    words = F.filter(F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(list(stop_words)))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


#: Characters of a text for each of its terms, to foresee how many there will be.
CHARS_A_TERM = 4


def tfidf_candidates(candidates: DataFrame, queries: DataFrame, k: int | None = None, stop_words: tuple[str, ...] = STOP_WORDS, max_features: int = MAX_FEATURES, digits: int = 6) -> DataFrame:
    """query_id, doc, score, rank: cosine of L2-normalised TF-IDF vectors fitted to the query's own candidates (query_id, doc, ord, content).

    Texts are shuffled once, to their query, and terms not at all: everything is counted where a query's candidates and its own text are.
    """
    k = int(positive("k", k, DEFAULTS.top_k))
    tasks = tasks_for(candidates, F.sum(F.length("content")) / CHARS_A_TERM)
    own = queries.select("query_id", F.lit(True).alias("asked"), F.lit(None).cast(candidates.schema["doc"].dataType).alias("doc"), F.col("question").alias("content"))
    texts = candidates.select("query_id", F.lit(False).alias("asked"), "doc", "content").unionByName(own).repartition(tasks, "query_id")
    every, held = Window.partitionBy("query_id"), F.when(~F.col("asked"), F.lit(1))
    terms = texts.withColumn("n", F.count(held).over(every)).select("query_id", "asked", "doc", "n", F.explode(tfidf_terms(F.col("content"), stop_words)).alias("term"))
    tf = terms.groupBy("query_id", "asked", "doc", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    each = Window.partitionBy("query_id", "term")
    tf = tf.withColumns({"df": F.count(held).over(each), "total": F.sum(held * F.col("tf")).over(each), "qtf": F.max(F.when(F.col("asked"), F.col("tf"))).over(each)}).where("df > 0")
    tf = tf.withColumn("at", F.dense_rank().over(every.orderBy(F.desc("total"), "term"))).where(F.col("at") <= max_features)
    idf_ = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighed = tf.select("query_id", "asked", "doc", (F.col("tf") * idf_).alias("w"), (F.col("qtf") * idf_).alias("qw"))
    sums = weighed.groupBy("query_id", "asked", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    sums = sums.withColumn("q_norm", F.max(F.when(F.col("asked"), F.col("norm"))).over(every)).where(~F.col("asked"))
    scored = sums.select("query_id", "doc", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score"))
    every = candidates.select("query_id", "doc", "ord").join(scored, ["query_id", "doc"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


def tfidf_fit(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(terms: term, idf; weights: doc, term, w with vectors of length 1) of a whole corpus (doc, content).

    The vocabulary is a top-k by total count, so it is bounded by ``max_features`` and broadcast.
    """
    tf = docs.select("doc", F.explode(tfidf_terms(F.col("content"), stop_words)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    top = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(max_features)
    terms = top.join(F.broadcast(total), F.lit(True)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(terms), "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return terms, raw.join(norms, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_corpus(model: tuple[DataFrame, DataFrame], queries: DataFrame, k: int | None = None, stop_words: tuple[str, ...] = STOP_WORDS, digits: int = 6) -> DataFrame:
    """query_id, doc, score, rank: the k best by cosine of those that share a term with the query."""
    k = int(positive("k", k, DEFAULTS.top_k))
    terms, weights = model
    asked = queries.select("query_id", F.explode(tfidf_terms(F.col("question"), stop_words)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = asked.join(terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    dots = weights.join(small(asked), "term").groupBy("query_id", "doc").agg(F.sum(F.col("w") * F.col("qw")).alias("dot")).join(norms, "query_id")
    scored = dots.select("query_id", "doc", F.round(F.col("dot") / F.col("q_norm"), digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

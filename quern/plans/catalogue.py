"""The registered queries over the test tables; :mod:`quern.plans.oracles` states each in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import automaton, blocks, bloom, caches, chunking, dictionary, fusion, graph, hybrid, intent, ivf, knn, lexical, tfidf_pipeline
from quern.plans import requests
from quern.plans.answer import answer
from quern.plans.stage_log import StageLog
from quern.settings import DEFAULTS, Settings
from quern.sources.store import BucketedStore, collection_stats, upserted
from quern.sources.tables import ROWS_A_TASK, checkpoint_folder, settled, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Queries of batched searches: every row whose id is divisible by this.
EACH = 50
#: The test texts are invented prose; these of its words and stems stand beside the domain's keywords.
COMMON = ("the", "and", "der", "que", "les", "th", "un", "est", "state", "rot", "con")
FIXTURE_DISEASE, FIXTURE_SCHEME = ("the", "les", "der", "erst", "treatment"), ("and", "que", "und", "pour", "state")
TTL = 86_400


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def one_query(spark, sf):
    """The vector 0 asks."""
    return vectors(spark, sf).where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def many_queries(spark, sf):
    return vectors(spark, sf).where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def corpus(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "source", (F.col("doc_id") % 10).cast("int").alias("page"))
    kind = F.when(F.col("label") % 2 == 0, "disease").otherwise("scheme")
    return vectors(spark, sf).join(docs, "vec_id").withColumn("collection", kind)


def asked(spark, sf):
    """Every fiftieth document asks with its vector and its whole text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return many_queries(spark, sf).join(docs, "query_id")


def contents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))


def benchmark_questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


# --- nearest neighbours -------------------------------------------------------------------------------------------


@query
def knn_l2(spark, sf):
    return knn.nearest(vectors(spark, sf).drop("label"), one_query(spark, sf)).select("vec_id", "distance", "rank")


@query
def knn_cosine(spark, sf):
    return knn.nearest(vectors(spark, sf).drop("label"), one_query(spark, sf), metric="cosine").select("vec_id", "distance", "score", "rank")


@query
def knn_ip(spark, sf):
    return knn.nearest(vectors(spark, sf).drop("label"), one_query(spark, sf), metric="ip").select("vec_id", "distance", "rank")


@query
def knn_filtered(spark, sf):
    return knn.nearest(vectors(spark, sf), one_query(spark, sf), where=F.col("label") == 3).select("vec_id", "label", "distance", "rank")


@query
def knn_threshold(spark, sf):
    return knn.over_threshold(knn.nearest(vectors(spark, sf).drop("label"), one_query(spark, sf), 20, "cosine")).select("vec_id", "score", "rank")


@query
def knn_batch_rownum(spark, sf):
    return knn.nearest(vectors(spark, sf).drop("label"), many_queries(spark, sf)).select("query_id", "vec_id", "distance", "rank")


@query
def knn_per_collection(spark, sf):
    kinds = vectors(spark, sf).withColumn("collection", F.when(F.col("label") % 2 == 0, "diseases").otherwise("schemes")).drop("label")
    return knn.nearest(kinds, one_query(spark, sf), within=["collection"]).select("collection", "vec_id", "distance", "rank")


@query
def knn_cosine_batch(spark, sf):
    return knn.nearest(vectors(spark, sf).drop("label"), many_queries(spark, sf), metric="cosine").select("query_id", "vec_id", "distance", "score", "rank")


@query
def knn_ip_batch(spark, sf):
    return knn.nearest(vectors(spark, sf).drop("label"), many_queries(spark, sf), metric="ip").select("query_id", "vec_id", "distance", "rank")


@query
def knn_filtered_batch(spark, sf):
    return knn.nearest(vectors(spark, sf), many_queries(spark, sf), where=F.col("label") == 3).select("query_id", "vec_id", "label", "distance", "rank")


@query
def knn_threshold_batch(spark, sf):
    return knn.over_threshold(knn.nearest(vectors(spark, sf).drop("label"), many_queries(spark, sf), 20, "cosine")).select("query_id", "vec_id", "score", "rank")


@query
def knn_per_collection_batch(spark, sf):
    kinds = vectors(spark, sf).withColumn("collection", F.when(F.col("label") % 2 == 0, "diseases").otherwise("schemes")).drop("label")
    return knn.nearest(kinds, many_queries(spark, sf), within=["collection"]).select("query_id", "collection", "vec_id", "distance", "rank")


@query
def mmr(spark, sf):
    return knn.max_marginal_relevance(vectors(spark, sf).drop("label"), many_queries(spark, sf))


# --- lexical scores -----------------------------------------------------------------------------------------------


@query
def bm25_fit_df(spark, sf):
    return lexical.document_frequency(contents(spark, sf))


@query
def bm25_idf(spark, sf):
    docs = contents(spark, sf)
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    return lexical.document_frequency(docs).join(F.broadcast(total), F.lit(True)).select("term", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query
def bm25_topk_corpus(spark, sf):
    return lexical.bm25_corpus(contents(spark, sf), benchmark_questions(spark, sf)).select("query_id", "doc", "score", "rank")


@query
def bm25_topk_blocks(spark, sf):
    """The same from an index of blocks, of which only those that can matter are opened."""
    asked = benchmark_questions(spark, sf)
    index = blocks.block_index(contents(spark, sf), lexical.query_terms(asked))
    return blocks.bm25_blocks(index, asked).select("query_id", "doc", "score", "rank")


@query
def tfidf_pipeline_topk(spark, sf):
    """Benchmark items ask the whole corpus, by a fitted pipeline that has been saved and loaded."""
    docs, folder = contents(spark, sf), f"{checkpoint_folder(spark)}/tfidf-{uuid.uuid4().hex}"
    tfidf_pipeline.fit(docs).write().save(folder)
    return tfidf_pipeline.search(PipelineModel.load(folder), docs, benchmark_questions(spark, sf)).select("query_id", "doc", "score", "rank")


@query
def bm25_candidates(spark, sf):
    found = hybrid.candidates(corpus(spark, sf), asked(spark, sf), 15)
    return lexical.bm25_candidates(found, asked(spark, sf)).select("query_id", "doc", F.round("bm25", 6).alias("bm25"))


@query
def tfidf_topk(spark, sf):
    return hybrid.tfidf_search(corpus(spark, sf), asked(spark, sf))


# --- hybrid search ------------------------------------------------------------------------------------------------


@query
def hybrid_search(spark, sf):
    question = one_query(spark, sf).withColumn("question", F.lit("the state of the water and light"))
    return hybrid.hybrid_search(corpus(spark, sf), question).select("doc", "score", "rank")


@query
def hybrid_batch(spark, sf):
    return hybrid.hybrid_search(corpus(spark, sf), asked(spark, sf)).select("query_id", "doc", "score", "rank")


@query
def smart_search_nohybrid(spark, sf):
    return hybrid.smart_search(corpus(spark, sf), asked(spark, sf), settings=Settings(enable_hybrid=False)).select("query_id", "doc", "distance", "score", "rank")


# --- fusion and reranking -----------------------------------------------------------------------------------------


def ranked_lists(spark, sf):
    """query_id, question, collection, rank, content, source, page, score: 5 of each collection a query."""
    found = knn.nearest(corpus(spark, sf), many_queries(spark, sf), within=["collection"])
    return found.join(asked(spark, sf).select("query_id", "question"), "query_id")


@query
def rrf_parity(spark, sf):
    out = fusion.reciprocal_rank_fusion(ranked_lists(spark, sf))
    return out.select("query_id", "collection", "page", F.md5("content").alias("content_md5"), "rrf_score", "rrf_rank")


@query
def rrf_fuse(spark, sf):
    out = fusion.reciprocal_rank_fusion(ranked_lists(spark, sf), top=8, merge_across=True)
    return out.select("query_id", "collection", "page", F.md5("content").alias("content_md5"), "rrf_score", "rrf_rank")


def reranked(spark, sf, top=10):
    lists = ranked_lists(spark, sf).withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("collection", "rank")))
    return lists, fusion.rerank(lists, top, "ord", disease=FIXTURE_DISEASE, scheme=FIXTURE_SCHEME)


@query
def rerank_score(spark, sf):
    return reranked(spark, sf)[1].select("query_id", "vec_id", "rerank_score", "rerank_rank")


@query
def rerank_threshold(spark, sf):
    return fusion.over_threshold(reranked(spark, sf, 4)[1], 0.3).select("query_id", "vec_id", "score", "rerank_score")


@query
def rerank_fallback(spark, sf):
    lists, best = reranked(spark, sf, 4)
    kept = fusion.over_threshold(best, 0.55)
    return fusion.with_fallback(kept, lists, ["ord"]).select("query_id", "vec_id", "edge_case", "final_rank")


# --- deduplication ------------------------------------------------------------------------------------------------


def dedup_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), "source", (F.col("doc_id") % 10).cast("int").alias("page"))


@query
def prefix_dedup_100(spark, sf):
    return fusion.dedup_prefix(dedup_rows(spark, sf), ["doc_id"]).select("doc_id")


@query
def docid_dedup_200(spark, sf):
    key = tx.document_key(F.col("content"), F.col("source"), F.col("page"))
    return fusion.dedup_documents(dedup_rows(spark, sf), ["doc_id"]).select("doc_id", key.alias("doc_key"))


@query
def dedup_batch(spark, sf):
    rows = dedup_rows(spark, sf).withColumns({"source": F.lit(None).cast("string"), "batch": F.col("doc_id") % 7})
    return fusion.dedup_documents(rows, ["doc_id"], ["batch"]).select("batch", "doc_id")


@query
def cross_collection_dedup(spark, sf):
    """Documents of both collections share one filter, disease ones first; page is left out of the key."""
    rows = dedup_rows(spark, sf).withColumns({"collection": F.when(F.col("doc_id") % 2 == 0, "disease").otherwise("scheme"), "page": F.lit(None).cast("int")})
    return fusion.dedup_documents(rows, ["collection", "doc_id"]).select("collection", "doc_id")


# --- text functions -----------------------------------------------------------------------------------------------


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query
def preprocess_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n\n\n 7 \n").alias("raw"))
    return pages.select("page_id", tx.preprocess_text(F.col("raw")).alias("cleaned"))


@query
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate_text(F.col("text"), 200).alias("short"))


@query
def extract_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.extract_keywords(F.col("text")), " ").alias("keywords"))


@query
def cache_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.cache_key(F.col("text")).alias("cache_key"))


@query
def query_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.query_hash(F.col("text")).alias("query_hash"))


@query
def token_counts(spark, sf):
    words = tx.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


@query
def ivf_ip_batch(spark, sf):
    """The same searches as knn_ip_batch by the approximate index, built over all vectors."""
    rows, asked = vectors(spark, sf).drop("label"), many_queries(spark, sf)
    index = ivf.build(rows, asked, "ip")
    return ivf.search(index, rows, asked).select("query_id", "vec_id", "distance", "rank")


# --- dictionaries -------------------------------------------------------------------------------------------------


def listed(column):
    return F.array_join(F.array_sort(column), ",")


@query
def kw_exact(spark, sf):
    words = dictionary.DISEASE_KEYWORDS + dictionary.SCHEME_KEYWORDS + COMMON
    return table(spark, sf, "documents").select("doc_id", listed(dictionary.exact_matches(F.col("text"), words)).alias("matches"))


@query
def kw_prefix(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", listed(dictionary.prefix_matches(F.col("text"), dictionary.DISEASE_KEYWORDS + COMMON)).alias("matches"))


@query
def kw_all(spark, sf):
    """Prefix matches by category, as rows: the join form for large dictionaries."""
    lists = {"disease": dictionary.DISEASE_KEYWORDS + ("the", "les"), "scheme": dictionary.SCHEME_KEYWORDS + ("and", "que")}
    return dictionary.prefix_matches_joined(contents(spark, sf), dictionary.keyword_table(spark, lists))


@query
def kw_overlap(spark, sf):
    """Words of a benchmark item that are keywords and words of the document of the same number."""
    pairs = benchmark_questions(spark, sf).join(contents(spark, sf), F.col("query_id") == F.col("doc"))
    q, c = tx.distinct_tokens(F.col("question")), tx.distinct_tokens(F.col("content"))
    both = dictionary.keyword_overlap(q, c, FIXTURE_DISEASE) + dictionary.keyword_overlap(q, c, FIXTURE_SCHEME)
    return pairs.select("query_id", dictionary.keyword_overlap(q, c, FIXTURE_DISEASE).alias("disease"), both.alias("both_lists"))


@query
def kw_starts_with(spark, sf):
    """Of all keywords of the large dictionary."""
    return dictionary.starts_with(large_dictionary(spark, sf).distinct(), "TH").select("category", "keyword")


@query
def kw_count(spark, sf):
    return large_dictionary(spark, sf).groupBy("category").agg(F.count_distinct("keyword").alias("n_words"))


@query
def kw_phrase(spark, sf):
    words = ("the and", "of the", "mit license", "root rot")
    return table(spark, sf, "documents").select("doc_id", listed(dictionary.phrase_matches(F.col("text"), words)).alias("matches"))


def large_dictionary(spark, sf):
    """Part names, every phrase of three words of a benchmark item, and the two keyword lists."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    items = table(spark, sf, "benchmark").select(words.alias("w")).where(F.size("w") >= 3)
    phrases = items.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("keyword"))
    named = phrases.select(F.lit("benchmark").alias("category"), "keyword").unionByName(table(spark, sf, "part").select(F.lit("part").alias("category"), F.col("p_name").alias("keyword")))
    return named.unionByName(dictionary.keyword_table(spark).select("category", "keyword"))


@query
def kw_automaton(spark, sf):
    """All keywords and phrases of a large dictionary, counted in one pass over each document."""
    return automaton.dictionary_hits(contents(spark, sf), large_dictionary(spark, sf))


# --- graph --------------------------------------------------------------------------------------------------------


#: Of the segments that customers belong to, in order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table_graph(spark, sf):
    """(nodes, edges) from tables, with the kinds of the domain graph: regions are schemes, nations diseases, a nation's market segments symptoms, suppliers treatments, customers pests.

    Weights differ by key, so that the shortest way to a nation is straight for some and by a supplier for others.
    """
    c, s, n, r = (table(spark, sf, t) for t in ("customer", "supplier", "nation", "region"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    node = lambda rows, id_, kind, title, meta=None: rows.select(id_.alias("id"), F.lit(kind).alias("node_type"), title.alias("name"), (meta if meta is not None else F.create_map().cast("map<string,string>")).alias("metadata"))
    segments = c.select("c_nationkey", "c_mktsegment").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    pair = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))
    severity = F.when(F.col("n_nationkey") % 3 == 0, "high").when(F.col("n_nationkey") % 3 == 1, "critical").otherwise("medium")
    nodes = (
        node(r, name("r", "r_regionkey"), "scheme", F.col("r_name"), F.create_map(F.lit("type"), F.col("r_name")))
        .unionByName(node(n, name("n", "n_nationkey"), "disease", F.col("n_name"), F.create_map(F.lit("severity"), severity)))
        .unionByName(node(segments, pair, "symptom", F.concat_ws(" ", "n_name", "c_mktsegment")))
        .unionByName(node(s, name("s", "s_suppkey"), "treatment", F.col("s_name")))
        .unionByName(node(c, name("c", "c_custkey"), "pest", F.col("c_name")))
    )
    edge = lambda rows, src, dst, relation, weight, seq: rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), weight.cast("double").alias("weight"), seq.cast("long").alias("seq"))
    at = F.col("n_nationkey").cast("long") * 20 + 2 * F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    home = name("n", "n_nationkey")
    helped = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    edges = (
        edge(segments, home, pair, "causes", F.lit(0.5), at)
        .unionByName(edge(segments, pair, home, "symptom_of", F.lit(0.5), at + 1))
        .unionByName(edge(s, name("s", "s_suppkey"), name("n", "s_nationkey"), "treats", F.col("s_suppkey") % 3 / 10 + 0.25, F.col("s_suppkey") + 10**9))
        .unionByName(edge(c, name("c", "c_custkey"), name("n", "c_nationkey"), "causes", F.lit(0.4), F.col("c_custkey") + 2 * 10**9))
        .unionByName(edge(helped, name("r", "n_regionkey"), name("s", "s_suppkey"), "subsidizes", F.lit(0.4), F.col("s_suppkey") + 3 * 10**9))
        .unionByName(edge(n, name("r", "n_regionkey"), home, "applies_to", F.col("n_nationkey") % 4 / 10 + 0.6, F.col("n_nationkey") + 4 * 10**9))
    )
    return settled(nodes), settled(edges)


def every_start(nodes):
    return nodes.select(F.col("id").alias("start"))


@query
def kg_stats(spark, sf):
    return graph.graph_stats(*table_graph(spark, sf))


@query
def kg_nodes_by_type(spark, sf):
    return table_graph(spark, sf)[0].where("node_type = 'disease'").select("id", "name", F.element_at("metadata", "severity").alias("severity"))


@query
def kg_neighbors(spark, sf):
    return graph.neighbors(table_graph(spark, sf)[1], "n3")


@query
def kg_incoming(spark, sf):
    return graph.incoming(table_graph(spark, sf)[1], "n3")


@query
def kg_bfs(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.bfs(nodes, edges, every_start(nodes), 4).select("start", "id", "depth", F.array_join("path", ">").alias("path"))


@query
def kg_bfs_relation(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.bfs(nodes, edges, every_start(nodes), 3, ["causes", "treats"]).select("start", "id", "depth", F.array_join("path", ">").alias("path"))


@query
def kg_multi_hop(spark, sf):
    nodes, edges = table_graph(spark, sf)
    found = graph.multi_hop(nodes, edges, every_start(nodes), ["disease", "symptom"], 3)
    return found.select("start", "id", "name", "type", "hops", F.array_join("path", ">").alias("path"))


@query
def kg_schemes(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.schemes_for(nodes, edges, nodes).select("id", "scheme", "scheme_name", "scheme_type", F.array_join("path", ">").alias("path"))


@query
def kg_treatments_both_ways(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.treatments_for_symptom(nodes, edges, nodes.where("node_type = 'symptom'").select(F.col("id").alias("start")), "both").select("start", "id", "hops")


@query
def kg_disease_context(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.disease_context(nodes, edges, nodes.where("node_type = 'disease'").select(F.col("id").alias("start")))


@query
def kg_shortest_path(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.shortest_paths(nodes, edges, every_start(nodes)).select("start", "id", F.round("cost", 6).alias("cost"))


@query
def kg_dijkstra(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.dijkstra(nodes, edges, every_start(nodes)).select("start", "id", F.round("cost", 6).alias("cost"))


@query
def kg_dfs(spark, sf):
    nodes, edges = table_graph(spark, sf)
    return graph.dfs(nodes, edges, every_start(nodes)).select("start", "ord", "id", "depth", F.array_join("path", ">").alias("path"))


@query
def kg_enrich(spark, sf):
    """Each customer asks about its nation and the next one, with an intent by its key."""
    nodes, edges = table_graph(spark, sf)
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    kinds = F.array(F.lit("disease"), F.lit("scheme"), F.lit("hybrid"), F.lit("greeting"))
    text = F.concat(F.lit("What of NATION_"), F.col("c_nationkey").cast("string"), F.lit(" and nation_"), (F.col("c_nationkey") + 1).cast("string"), F.lit(" or NATION_3?"))
    asked = c.select(F.col("c_custkey").alias("query_id"), text.alias("question"), F.get(kinds, (F.col("c_custkey") % 4).cast("int")).alias("intent"))
    entities = n.select(F.lower("n_name").alias("word"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"))
    found = graph.enrich(asked, nodes, edges.where("relation <> 'treats' or weight < 0.3"), entities=entities)
    return found.groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("n"), F.md5(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "id", "name"))))).alias("items_md5"))


@query
def nation_bfs(spark, sf):
    """A graph from tables: customers and suppliers at their nations, nations at their regions; who is within two edges of a region."""
    c, s, n, r = (table(spark, sf, t) for t in ("customer", "supplier", "nation", "region"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nodes = (
        c.select(name("c", "c_custkey").alias("id")).union(s.select(name("s", "s_suppkey"))).union(n.select(name("n", "n_nationkey"))).union(r.select(name("r", "r_regionkey")))
    )
    edges = (
        n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.col("n_nationkey").alias("seq"))
        .union(c.select(name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey").cast("int")))
        .union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey").cast("int")))
    )
    edges = edges.withColumns({"relation": F.lit("has"), "weight": F.lit(1.0)})
    found = graph.bfs(nodes, edges, r.select(name("r", "r_regionkey").alias("start")), 2)
    return found.groupBy("start", "depth", F.substring("id", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- intents ------------------------------------------------------------------------------------------------------

SAMPLES = [
    (1, "Hi"), (2, "How are you"), (3, "My lemon leaves have canker spots"), (4, "What subsidy is there for drip irrigation?"), (5, "Is there government help for treating HLB?"),
    (6, "Tell me a joke"), (7, "thanks"), (8, "Goodbye"), (9, "what can you do"), (10, "who are you"), (11, "loan for treatment of disease"), (12, "Namaste"), (13, "kaise ho bhai"), (14, "please guide me to the scheme"),
]
LABELS = [
    (1, "INTENT: disease\nCONFIDENCE: 0.9\nREASON: names a disease"), (2, "intent: SCHEME\nconfidence: 1.7\nreason: a: b"), (3, "INTENT: weather\nCONFIDENCE: high\nREASON:"),
    (4, "no label"), (5, "INTENT: disease\nINTENT: hybrid\nCONFIDENCE: .4\nCONFIDENCE: -2"), (6, "  INTENT:greeting  \n\n CONFIDENCE: 7e-1 "),
]


def questions(spark, sf):
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("query_id"), F.col("text").alias("question"))
    return spark.createDataFrame(SAMPLES, "query_id long, question string").unionByName(turns)


@query
def intent_rules(spark, sf):
    return questions(spark, sf).select("query_id", intent.rule_intent(F.col("question")).alias("intent"))


@query
def intent_route(spark, sf):
    branch = intent.route(intent.rule_intent(F.col("question")))
    return questions(spark, sf).select("query_id", branch.alias("branch"), F.array_join(intent.target_collections(branch), ",").alias("targets"))


@query
def greeting_cascade(spark, sf):
    return questions(spark, sf).select("query_id", intent.greeting_key(F.col("question")).alias("reply_key"))


@query
def llm_label_parse(spark, sf):
    """Each event's answer of a model, right and wrong ones in turn, with what the event says in it."""
    parsed = intent.parse_label(F.col("raw"))
    said = F.get(F.array(*[F.lit(raw) for _, raw in LABELS]), (F.col("event_id") % len(LABELS)).cast("int"))
    more = F.concat(F.lit("\nCONFIDENCE: "), (F.col("event_id") % 13 / 8).cast("string"), F.lit("\nReason:  "), "event_type", F.lit(" "), F.col("user_id").cast("string"))
    raw = F.concat(said, F.when(F.col("event_id") % 4 != 0, more).otherwise(""))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), raw.alias("raw")).select("id", parsed["intent"].alias("intent"), parsed["confidence"].alias("confidence"), parsed["reason"].alias("reason"))


@query
def confidence_gate(spark, sf):
    """Each event's value is a confidence in percent of 200, and its number says how many documents were found."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") / 200).alias("confidence"), (F.col("event_id") % 3).alias("n_docs"))
    return rows.select("id", intent.gate(F.col("confidence"), F.col("n_docs")).alias("outcome"))


# --- sketches -----------------------------------------------------------------------------------------------------

BITS, HASHES = bloom.optimal_bits(5000, 0.001), bloom.optimal_hashes(bloom.optimal_bits(5000, 0.001), 5000)


def keys(spark, sf):
    rows = dedup_rows(spark, sf)
    return rows.select("doc_id", tx.document_key(F.col("content"), F.col("source"), F.col("page")).alias("item"))


@query
def bloom_bits(spark, sf):
    return bloom.filter_bits(keys(spark, sf), BITS, HASHES)


@query
def bloom_membership(spark, sf):
    """Keys of the even documents are in; which keys of all documents may be?"""
    every = keys(spark, sf)
    inside = bloom.filter_bits(every.where("doc_id % 2 = 0"), BITS, HASHES)
    return bloom.membership(every, inside, BITS, HASHES)


@query
def bloom_stats(spark, sf):
    return bloom.stats(keys(spark, sf), 5000, 0.001)


@query
def bloom_page_membership(spark, sf):
    """The same, by bit pages; for each document."""
    every = keys(spark, sf)
    return bloom.page_membership(every, bloom.filter_pages(every.where("doc_id % 2 = 0"), BITS, HASHES), BITS, HASHES)


#: A filter so small that it takes documents for known that are not.
NARROW = bloom.optimal_bits(500, 0.05), bloom.optimal_hashes(bloom.optimal_bits(500, 0.05), 500)


def arriving(spark, sf):
    """Keys of all documents, in order of doc_id."""
    return bloom.arrivals(keys(spark, sf), ["doc_id", "item"])


@query
def bloom_add_if_new(spark, sf):
    return bloom.add_if_new(arriving(spark, sf), *NARROW).select("doc_id", "is_new")


@query
def bloom_dedup_stats(spark, sf):
    return bloom.dedup_stats(arriving(spark, sf), 500, 0.05)


@query
def scalable_bloom_add_if_new(spark, sf):
    """The first filter takes 100 documents."""
    return bloom.scalable_add_if_new(arriving(spark, sf), 100, 0.05).select("doc_id", "is_new", "filter")


@query
def scalable_bloom_assign(spark, sf):
    """Documents arrive in order of doc_id."""
    rows = bloom.arrivals(table(spark, sf, "documents").select("doc_id", F.lit("").alias("item")), ["doc_id"])
    return bloom.scalable_assignment(rows, 100).groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


#: Of the first filter; small, so that several are filled on the test tables.
FIRST_CAPACITY = 20


@query
def scalable_bloom_membership(spark, sf):
    """Keys of the even documents are added in order of doc_id; which keys of all documents may be in any of the filters?"""
    every = keys(spark, sf)
    added = bloom.arrivals(every.where("doc_id % 2 = 0"), ["doc_id", "item"])
    return bloom.scalable_membership(every, added, FIRST_CAPACITY)


# --- chunks, store, caches ----------------------------------------------------------------------------------------


@query
def window_chunks(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.window_chunks(F.col("text"))).alias("chunk", "content"))
    return pieces.select("doc_id", "chunk", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query
def recursive_chunks(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"))).alias("chunk", "content"))
    return pieces.select("doc_id", "chunk", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def chunk_rows(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").cast("int").alias("page"), F.col("text").alias("content"))
    kind = F.when(F.substring("source_file", 4, 10).cast("int") % 2 == 0, DEFAULTS.disease_collection).otherwise(DEFAULTS.scheme_collection)
    return chunking.chunked_pages(pages, kind, clean=False, chunks=chunking.window_chunks)


@query
def chunk_ids(spark, sf):
    return chunk_rows(spark, sf).select("chunk_id", "collection", "chunk_index")


@query
def collection_stats_query(spark, sf):
    return collection_stats(chunk_rows(spark, sf), [DEFAULTS.disease_collection, DEFAULTS.scheme_collection, "absent"])


@query
def upsert_chunks(spark, sf):
    """Chunks of even pages come anew: once as they are, once reversed with a later index, which stays."""
    old = chunk_rows(spark, sf)
    new = old.where("page % 2 = 0").withColumns({"content": F.reverse("content"), "chunk_index": F.col("chunk_index") + 1})
    return upserted(old, old.where("page % 2 = 0").unionByName(new)).select("chunk_id", "chunk_index", F.md5("content").alias("content_md5"))


@query
def bucketed_upsert(spark, sf):
    """Chunks go to a store on disk, those of even pages come anew, and one collection is dropped and filled again: what the store holds then."""
    store = BucketedStore(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    rows = chunk_rows(spark, sf)
    for kind, name in (("disease", DEFAULTS.disease_collection), ("scheme", DEFAULTS.scheme_collection)):
        mine = rows.where(F.col("collection") == name)
        store.add(mine, kind)
        store.add(mine.where("page % 2 = 0").withColumns({"content": F.reverse("content"), "chunk_index": F.col("chunk_index") + 1}), kind)
    store.drop("scheme")
    store.add(rows.where((F.col("collection") == DEFAULTS.scheme_collection) & (F.col("page") % 3 == 0)), "scheme")
    return store.read().select("chunk_id", "collection", "chunk_index", F.md5("content").alias("content_md5"))


@query
def context_builder(spark, sf):
    rows = ranked_lists(spark, sf).where("collection = 'disease'")
    return chunking.contexts(rows).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@query
def embed_cache_stats(spark, sf):
    return caches.cache_stats(table(spark, sf, "conversations").select("text"))


#: Small, so that keys are forgotten on the test tables.
LRU_SIZE, LRU_CHUNK = 40, 64


@query
def embed_cache_lru(spark, sf):
    """Turns of the conversations ask one after the other for their embeddings, from a cache of a few keys."""
    turns = bloom.arrivals(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn", "text"])
    return caches.lru_stats(turns.select("text", "ord"), LRU_SIZE, LRU_CHUNK)


@query
def intent_prompts(spark, sf):
    """The system prompt that each question's answer would be generated under."""
    prompt = tx.system_prompt(intent.route(intent.rule_intent(F.col("question"))))
    return questions(spark, sf).select("query_id", F.md5(prompt).alias("prompt_md5"))


@query
def ttl_cache_hits(spark, sf):
    requests = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return caches.ttl_hits(requests, TTL).groupBy("key").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("misses"))


@query
def stream_event_windows(spark, sf):
    """The event table as a stream: hourly counts a type, drained to the end."""
    from quern.streaming.requests import drain, read_events, windowed_counts

    return drain(windowed_counts(read_events(spark, f"{sf}/events.parquet")), stream_folder(spark), "complete")


@query
def stream_response_cache(spark, sf):
    """The requests of ttl_cache_hits as a stream of several batches, each row up to 6 hours late and so out of order; hits and misses a user."""
    from quern.streaming.requests import BUCKETS, arriving_in_parts, drain, response_cache, rocksdb_state

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    late = F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600)) * 1_000_000
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.timestamp_micros(at).alias("ts"), (at + late).alias("arrival"))
    # A last request of nobody moves the watermark past all others.
    close = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    folder = stream_folder(spark)
    n = rows.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    with rocksdb_state(spark, tasks):
        found = drain(response_cache(arriving_in_parts(rows, f"{folder}/in", "arrival", STREAM_PARTS, close), TTL, "12 hours", max(BUCKETS, n // ROWS_A_BUCKET)), folder)
    found = found.where("key is not null")
    return found.groupBy("key").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("misses"))


#: Batches that the request stream comes in, and requests of a group of its keys.
STREAM_PARTS, ROWS_A_BUCKET = 4, 5000


def stream_folder(spark):
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


# --- the whole answer ---------------------------------------------------------------------------------------------


def answer_questions(spark, sf):
    """Benchmark items ask, each with the vector of its own number."""
    vecs = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return benchmark_questions(spark, sf).join(vecs, "query_id")


def fixture_intent(question):
    return intent.rule_intent(question, FIXTURE_DISEASE, FIXTURE_SCHEME)


@query
def answer_all(spark, sf):
    out = answer(corpus(spark, sf), answer_questions(spark, sf), classifier=fixture_intent, disease=FIXTURE_DISEASE, scheme=FIXTURE_SCHEME)
    return out.select("query_id", "success", "intent", "outcome", "n_sources", "sources", F.md5("answer").alias("answer_md5"))


@query
def answer_stages(spark, sf):
    """What each stage of answer_all takes in and gives out."""
    log = StageLog(spark)
    answer(corpus(spark, sf), answer_questions(spark, sf), classifier=fixture_intent, disease=FIXTURE_DISEASE, scheme=FIXTURE_SCHEME, log=log)
    return log.table().select("stage", "rows_in", "rows_out", (F.col("ms") > 0).alias("timed"))


# --- requests -----------------------------------------------------------------------------------------------------

#: Bodies come in so many kinds, six of them faulty.
BODY_KINDS = 9


def request_body(kind, text):
    """A JSON body that asks ``text``: plain, with ids, or with one of the faults that a caller makes."""
    said = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    said = F.substr(said, F.lit(2), F.length(said) - 2)
    plain = F.concat(F.lit('{"question": '), said, F.lit("}"))
    bodies = {
        1: F.lit('{"question": ""}'),
        2: F.lit('{"user_id": "u1"}'),
        3: F.substr(plain, F.lit(1), F.length(plain) - 1),
        4: F.lit('{"question": 17, "session_id": []}'),
        5: F.lit('{"question": null}'),
        6: F.concat(F.lit('{"user_id": 5, "question": '), said, F.lit("}")),
        7: F.concat(F.lit("["), said, F.lit("]")),
        8: F.concat(F.lit('{"session_id": "s1", "user_id": null, "more": {"question": 1}, "question": '), said, F.lit("}")),
    }
    out = plain
    for n, body in bodies.items():
        out = F.when(kind == n, body).otherwise(out)
    return out


@query
def request_parse(spark, sf):
    """Every turn of the conversations as a request's body, plain or faulty."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(BODY_KINDS))
    bodies = table(spark, sf, "conversations").select("conv_id", "turn", request_body(kind, F.col("text")).alias("body"))
    return requests.parsed_requests(bodies).select("conv_id", "turn", "question", "user_id", "session_id", requests.error_text(F.col("errors")).alias("errors"))


@query
def request_replies(spark, sf):
    """Benchmark items as bodies, plain or faulty: accepted ones answered, others refused; what the reply's JSON says."""
    bodies = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), request_body(F.pmod(F.col("item_id"), F.lit(BODY_KINDS)), F.col("text")).alias("body"))
    vecs = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    out = requests.served(corpus(spark, sf), bodies, lambda rows: rows.join(vecs, "query_id"), classifier=fixture_intent, disease=FIXTURE_DISEASE, scheme=FIXTURE_SCHEME)
    said = lambda path: F.get_json_object("body", path)
    return out.select("query_id", "status", said("$.intent").alias("intent"), said("$.detail[0].field").alias("field"), said("$.detail[0].problem").alias("problem"), F.md5(said("$.answer")).alias("answer_md5"))

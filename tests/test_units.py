"""Operators that SQL does not state: sequential searches, the splitter, stores, caches and streams."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import bloom, caches, chunking, dictionary, fusion, graph, hybrid, intent, knn, lexical
from quern.plans.catalogue import QUERIES
from quern.settings import Settings, positive
from quern.sources import store, tables
from quern.streaming import requests as rq


def one(frame):
    return frame.collect()[0][0]


# --- settings and text ---


def test_settings(spark):
    spark.conf.set("quern.top_k", "7")
    spark.conf.set("quern.enable_hybrid", "false")
    found = Settings.of(spark)
    assert (found.top_k, found.enable_hybrid, found.chunk_size) == (7, False, 1500)
    spark.conf.unset("quern.top_k")
    spark.conf.unset("quern.enable_hybrid")
    with pytest.raises(ValueError):
        positive("k", 0, 5)
    assert positive("k", None, 5) == 5


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a\n\n\n\n  b", "a b"), ("x\n 12 \ny", "x y"), ("100% & ₹50 fine-tuned?", "100  50 fine-tuned?"), ("", ""), ("  ", ""), ("naïve_word (x)", "naïve_word x"),
    ],
)
def test_preprocess(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "t string").select(tx.preprocess_text(F.col("t")))) == want


def test_keys_strip_all_white_space(spark):
    texts = ["\thello  world\n", "hello world", "\u00a0\u2003hello world\u3000", "\x1chello \x0bworld\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.cache_key(F.col("t"))).collect()] == [t.strip().lower() for t in texts]
    assert [r[0] for r in df.select(tx.prefix_key(F.col("t"), 8)).collect()] == [t[:8].lower().strip() for t in texts]
    want = [hashlib.md5(" ".join(t.lower().split()).encode()).hexdigest() for t in texts]
    assert [r[0] for r in df.select(tx.query_hash(F.col("t"))).collect()] == want and len(set(want)) == 1
    assert [r[0] for r in df.select(tx.content_hash(F.col("t"))).collect()] == want
    assert one(spark.createDataFrame([("\u2003Thanks\n",)], "q string").select(intent.greeting_key(F.col("q")))) == "thanks"


def test_keys_and_their_sql(spark):
    """On rows with tabs, line breaks and other scripts' spaces at the ends, as the test tables have none."""
    import duckdb

    from quern.plans.oracles import spaced, strip

    texts = ["\ta b\n", " a  b ", "\u00a0a\u2003b\u3000", "\x1ca\x0bb\r", "", "a\u200bb"]
    con = duckdb.connect()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.stripped(F.col("t")), tx.spaced(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [con.execute(f"SELECT {strip('x')}, {spaced('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone() for t in texts]


def test_truncate_and_keys(spark):
    df = spark.createDataFrame([("one two three",), ("onetwothree",), ("short",)], "t string")
    assert [r[0] for r in df.select(tx.truncate_text(F.col("t"), 9)).collect()] == ["one two...", "onetwothr...", "short"]
    keys = df.select(tx.document_key(F.col("t"), F.lit(""), F.lit(1)), tx.document_key(F.col("t"), F.lit("s"), F.lit(None).cast("int")), tx.document_key(F.col("t"), F.lit("s"), F.lit(0))).first()
    assert keys[0] == keys[1] and len(keys[0]) == 32 and keys[2] == f"s_p0_{keys[0][:8]}"
    assert one(df.select(tx.prompt(F.lit("c"), F.col("t")))) == "Context:\nc\n\nQuestion: one two three"


# --- nearest neighbours ---


def test_query_blocks_do_not_matter(spark, monkeypatch):
    vectors = tables.table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    rows = lambda: sorted(map(tuple, knn.nearest(vectors, queries, 3).select("query_id", "vec_id", "rank").collect()))
    whole = rows()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 120)
    assert rows() == whole and len(whole) == 1500
    assert sorted(map(tuple, hybrid.retriever(vectors, 3)(queries).select("query_id", "vec_id", "rank").collect())) == whole
    monkeypatch.setattr(knn, "PART_BYTES", 64 * 8 * 50)
    assert rows() == whole
    with pytest.raises(ValueError):
        knn.nearest(vectors, queries, 3, "angular")


def test_wide_columns_and_repeats(spark, monkeypatch):
    """Texts are joined after the ranking; rows of one id, and repeated rows, come out each with its own."""
    rows = [(1, [1.0], "a", 5), (1, [1.0], "b", 6), (2, [1.0], None, 7), (2, [1.0], None, 7), (3, [9.0], "far", 8)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, content string, page int")
    queries = spark.createDataFrame([(q, [1.0]) for q in range(5)], "query_id long, query_vec array<double>")
    want = sorted((q, i, str(t), p) for q in range(5) for i, _, t, p in rows[:4])
    for block in (100, 2):
        monkeypatch.setattr(knn, "QUERY_BLOCK", block)
        got = knn.nearest(corpus, queries, 4)
        assert got.columns == ["query_id", "vec_id", "content", "page", "distance", "rank", "score"]
        assert sorted((r.query_id, r.vec_id, str(r.content), r.page) for r in got.collect()) == want


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_nearest_edges(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "CELLS", 40)
    rows = [(i, [1.0, float(i % 3)], "ab"[i % 2]) for i in range(60)] + [(100, None, "a"), (101, [None, 1.0], "a"), (102, [1.0], "b"), (103, [0.0, 0.0], None), (104, [], "a")]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, None), (4, [5.0])], "query_id long, query_vec array<double>")
    length = lambda v: math.sqrt(sum(x * x for x in v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    far = {"l2sq": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)), "ip": lambda a, b: 1 - dot(a, b), "cosine": lambda a, b: 1 - dot(a, b) / length(a) / length(b) if length(b) else None}[metric]
    for within in ([], ["kind"]):
        got = sorted((r.query_id, str(r.kind) if within else "", r["rank"], r.vec_id, r.distance) for r in knn.nearest(corpus, queries, 7, metric, within).collect())
        want = []
        for q, v in [(1, [1.0, 1.0]), (2, [2.0, 0.0]), (4, [5.0])]:
            for kind in ({str(k) for _, _, k in rows} if within else {""}):
                near = sorted((round(far(v, e), 6), i) for i, e, k in rows if e and None not in e and len(e) == len(v) and far(v, e) is not None and kind in ("", str(k)))
                want += [(q, kind, n + 1, i, d) for n, (d, i) in enumerate(near[:7])]
        assert got == sorted(want)
        monkeypatch.setattr(knn, "QUERY_BLOCK", 1)
        assert sorted((r.query_id, str(r.kind) if within else "", r["rank"], r.vec_id, r.distance) for r in knn.nearest(corpus, queries, 7, metric, within).collect()) == sorted(want)
        monkeypatch.setattr(knn, "QUERY_BLOCK", 2000)
    assert knn.nearest(corpus, queries.limit(0), 3, metric).collect() == [] and knn.nearest(corpus.limit(0), queries, 3, metric).collect() == []


def test_mmr_against_the_rule(spark):
    rng = random.Random(5)
    data = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(40)}
    vectors = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * 6) / math.dist(b, [0] * 6)
    for weight in (0.5, 1.0, 0.1):
        got = {}
        for r in sorted(knn.max_marginal_relevance(vectors, queries, 5, 20, weight).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
        for q in range(3):
            near = sorted(data, key=lambda i: (round(math.dist(data[q], data[i]) ** 2, 6), i))[:20]
            chosen = [max(near, key=lambda i: round(cos(data[q], data[i]), 12))]
            while len(chosen) < 5:
                chosen.append(max((i for i in near if i not in chosen), key=lambda i: round(weight * cos(data[q], data[i]) - (1 - weight) * max(cos(data[i], data[c]) for c in chosen), 12)))
            assert got[q] == chosen


# --- lexical ---


def test_saved_index_scores_like_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fish", "blue fish fish", "one two red", "", "none of these"])], "doc long, content string")
    asked = spark.createDataFrame([(1, "red fish fish"), (2, "two"), (3, "absent")], "query_id long, question string")
    store.save_lexical_index(docs.where("doc <> 3"), str(tmp_path / "index"))
    got = sorted(map(tuple, store.search_lexical_index(store.load_lexical_index(spark, str(tmp_path / "index")), asked).select("query_id", "doc", "score", "rank").collect()))
    want = sorted(map(tuple, lexical.bm25_corpus(docs.where("doc <> 3"), asked).select("query_id", "doc", "score", "rank").collect()))
    assert got == want and {q for q, *_ in got} == {1, 2}


def test_tfidf_terms(spark):
    got = one(spark.createDataFrame([("The quick, quick fox x of FOX",)], "t string").select(lexical.tfidf_terms(F.col("t"))))
    assert got == ["quick", "quick", "fox", "fox", "quick quick", "quick fox", "fox fox"]
    assert one(spark.createDataFrame([("the",)], "t string").select(lexical.tfidf_terms(F.col("t")))) == []


def test_saved_tfidf(spark, tmp_path):
    docs = spark.createDataFrame([(0, "red fish swims"), (1, "blue fish fish"), (2, "one two red"), (3, "")], "doc long, content string")
    asked = spark.createDataFrame([(1, "red fish"), (2, "nothing shared")], "query_id long, question string")
    store.save_tfidf(lexical.tfidf_fit(docs), str(tmp_path / "model"))
    got = lexical.tfidf_corpus(store.load_tfidf(spark, str(tmp_path / "model")), asked).collect()
    assert [r.doc for r in sorted(got, key=lambda r: r["rank"])][0] == 0 and {r.query_id for r in got} == {1} and all(0 < r.score <= 1 for r in got)
    candidates = docs.select(F.lit(1).cast("long").alias("query_id"), "doc", F.col("doc").alias("ord"), "content")
    local = {r.doc: r.score for r in lexical.tfidf_candidates(candidates, asked.limit(1)).collect()}
    assert {r.doc: r.score for r in got} == {d: x for d, x in local.items() if x}


# --- fusion ---


def fusion_rows(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, collection string, rank int, content string, source string, page int, score double")


def test_rrf_duplicate_rules(spark):
    rows = [("disease", 1, "a", "s", 1, 0.5), ("disease", 2, "a", "s", 1, 0.4), ("disease", 3, "a", "s", 2, 0.3), ("scheme", 1, "a", "s", 1, 0.2), ("scheme", 2, "a", "s", 2, 0.1), ("scheme", 3, "a", "s", 2, 0.1)]
    got = [(r.collection, r.page, r.rrf_score) for r in fusion.reciprocal_rank_fusion(fusion_rows(spark, rows)).orderBy("rrf_rank").collect()]
    assert got == [("disease", 1, round(1 / 61 + 1 / 62, 9)), ("scheme", 2, round(1 / 62 + 1 / 63, 9)), ("scheme", 1, round(1 / 61, 9))]
    merged = fusion.reciprocal_rank_fusion(fusion_rows(spark, rows), merge_across=True).orderBy("rrf_rank").collect()
    assert [(r.collection, r.page) for r in merged] == [("disease", 1), ("scheme", 2)]


def test_rrf_does_not_depend_on_the_scale_of_scores(spark):
    rows = [("disease", i, f"d{i}", "s", i, 1.0 / i) for i in range(1, 6)] + [("scheme", i, f"e{i}", "s", i, 1.0 / i) for i in range(1, 4)]
    order = lambda f: [(r.collection, r.page) for r in fusion.reciprocal_rank_fusion(f).orderBy("rrf_rank").collect()]
    frame = fusion_rows(spark, rows)
    assert order(frame) == order(frame.withColumn("score", F.col("score") * 100))


def test_relevance_parts(spark):
    content = "the copper spray for citrus canker treatment is applied in the morning"
    question = "copper spray for citrus canker treatment"
    got = one(spark.createDataFrame([(question, content, 0.1)], "q string, c string, s double").select(fusion.relevance(F.col("q"), F.col("c"), F.col("s"))))
    assert abs(got - (0.1 + 6 * 0.04 + 0.15 + 4 * 0.03 + 0.05)) < 1e-9
    assert one(spark.createDataFrame([("x", None, None)], "q string, c string, s double").select(fusion.relevance(F.col("q"), F.col("c"), F.col("s")))) == 0.5


def test_dedup_is_idempotent(spark):
    rows = fusion_rows(spark, [("disease", i, "Same Text" if i < 3 else f"t{i}", "s", None if i == 4 else i % 2, 0.1) for i in range(1, 7)])
    once = fusion.dedup_prefix(rows, ["rank"])
    assert sorted(r["rank"] for r in once.collect()) == sorted(r["rank"] for r in fusion.dedup_prefix(once, ["rank"]).collect()) == [1, 3, 4, 5, 6]


# --- dictionaries ---


def test_prefix_phrase_and_join_forms(spark):
    df = spark.createDataFrame([(1, "Rotation of the root-rot, pm-kisan statement!"), (2, "")], "doc long, content string")
    assert [set(r[0]) for r in df.select(dictionary.prefix_matches(F.col("content"), ("rot", "state", "root rot", "kisan"))).collect()] == [{"rot", "state"}, set()]
    assert [r[0] for r in df.select(dictionary.phrase_matches(F.col("content"), ("root rot", "pm kisan", "of root"))).collect()] == [["root rot", "pm kisan"], []]
    joined = dictionary.prefix_matches_joined(df, dictionary.keyword_table(spark, {"a": ("rot", "state", "ROT"), "b": ("root",)}))
    assert {tuple(r) for r in joined.collect()} == {(1, "a", "rot"), (1, "a", "state"), (1, "b", "root")}


def test_prefixes_meet_the_keywords_before_they_are_shuffled(spark):
    df = spark.createDataFrame([(1, "rotation rotor rots"), (2, None), (3, "state 1")], "doc long, content string")
    joined = dictionary.prefix_matches_joined(df, dictionary.keyword_table(spark, {"a": ("rot", "stat"), "b": ("rotor", "1")}))
    top = joined._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Aggregate [doc")  # made distinct last, so of matches alone
    assert sorted(tuple(r) for r in joined.collect()) == [(1, "a", "rot"), (1, "b", "rotor"), (3, "a", "stat"), (3, "b", "1")]
    assert dictionary.prefix_matches_joined(df, dictionary.keyword_table(spark).limit(0)).count() == 0


# --- graph ---


def plain_graph(rng, n=14, m=40):
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("ab"), rng.choice([0.5, 1.0, 2.0]), s) for s in range(m)]


def test_depth_first_search_of_more_edges_than_a_task_took(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_LOCAL_EDGES", 3, raising=False)  # of the search that broadcast the graph
    nodes = spark.createDataFrame([(i, "t", i, {}) for i in "abcdefg"], graph.NODES)
    links = ["ab", "bc", "ac", "cd", "de", "ef", "fg", "ba", "ab"]
    edges = spark.createDataFrame([(s, d, "r", 1.0, n) for n, (s, d) in enumerate(links)], graph.EDGES)
    starts = spark.createDataFrame([("a",), ("c",), ("g",)], "start string")
    got = {}
    for r in sorted(graph.dfs(nodes, edges, starts, 3).collect(), key=lambda r: r.ord):
        got.setdefault(r.start, []).append("".join(r.path))
    assert got == {"a": ["ab", "abc", "abcd"], "c": ["cd", "cde", "cdef"]}
    assert graph.dfs(nodes, edges, starts, 0).count() == 0


def test_searches_against_plain_python(spark):
    edges_list = plain_graph(random.Random(2))
    nodes = spark.createDataFrame([(f"n{i}", "t", f"N{i}", {}) for i in range(14)], graph.NODES)
    edges = spark.createDataFrame(edges_list, graph.EDGES)
    starts = nodes.select(F.col("id").alias("start")).union(spark.createDataFrame([("nowhere",)], "start string"))
    links = {}
    for s, d, r, w, _ in edges_list:
        links.setdefault(s, []).append((d, w))
    bfs, dfs, far = {}, {}, {}
    for i in range(14):
        start = f"n{i}"
        seen, queue = {start}, [(start, [start])]
        for here, path in queue:
            if len(path) > 1:
                bfs[start, here] = path
            if len(path) <= 4:
                for d, _ in links.get(here, []):
                    if d not in seen:
                        seen.add(d)
                        queue.append((d, [*path, d]))
        order, visited = [], set()

        def walk(here, path):
            if here in visited or len(path) > 6:
                return
            visited.add(here)
            if len(path) > 1:
                order.append((here, path))
            for d, _ in links.get(here, []):
                walk(d, [*path, d])

        walk(start, [start])
        dfs[start] = order
        cost = {start: 0.0}
        for _ in range(14):
            for s, d, _, w, _ in edges_list:
                if s in cost and cost[s] + w < cost.get(d, math.inf):
                    cost[d] = cost[s] + w
        far |= {(start, d): c for d, c in cost.items()}
    assert {(r.start, r.id): r.path for r in graph.bfs(nodes, edges, starts, 4).collect()} == bfs
    got = {}
    for r in sorted(graph.dfs(nodes, edges, starts).collect(), key=lambda r: r.ord):
        got.setdefault(r.start, []).append((r.id, r.path))
    assert got == {s: o for s, o in dfs.items() if o}
    assert {(r.start, r.id): r.cost for r in graph.shortest_paths(nodes, edges, starts).collect()} == far
    assert {(r.start, r.id): r.cost for r in graph.dijkstra(nodes, edges, starts).collect()} == far
    near = {(r.start, r.id): r.cost for r in graph.dijkstra(nodes, edges, starts, max_cost=1.0, strict_max_cost=True).collect()}
    assert near == {k: c for k, c in far.items() if c <= 1.0}
    loose = {(r.start, r.id) for r in graph.dijkstra(nodes, edges, starts, max_cost=1.0).collect()}
    assert set(near) < loose


def test_domain_graph(spark):
    nodes, edges = graph.domain_graph(spark)
    assert (nodes.count(), edges.count()) == (38, 70)
    found = {(r.id, r.scheme) for r in graph.schemes_for(nodes, edges, nodes.where("node_type = 'disease'").select("id")).collect()}
    want = {"citrus_canker": "pmfby nhm", "hlb": "pmfby nhm", "tristeza": "pmfby nhm", "scab": "nhm", "melanose": "nhm", "anthracnose": "nhm", "gummosis": "pmksy", "root_rot": "pmksy nhm"}
    assert found == {(d, s) for d, ss in want.items() for s in ss.split()}
    symptom = spark.createDataFrame([("yellowing",)], "start string")
    assert graph.treatments_for_symptom(nodes, edges, symptom).collect() == []
    assert graph.treatments_for_symptom(nodes, edges, symptom, "both").count() > 0
    pests = nodes.where("node_type = 'pest'").select(F.col("id").alias("start"))
    severe = graph.multi_hop(nodes, edges, pests, ["disease"], 1, where=F.element_at("metadata", "severity") == "critical")
    assert {(r.start, r.id) for r in severe.collect()} == {("asian_citrus_psyllid", "hlb")}
    assert graph.bfs(nodes, edges, pests, 3, where=F.col("weight") < 0.4).collect() == []
    assert [r.path for r in graph.find_path(nodes, edges, "nhm", "hlb").collect()] == [["nhm", "biological_control", "hlb"]]
    assert graph.find_path(nodes, edges, "hlb", "hlb").collect() == []
    assert [r.path for r in graph.find_path(nodes, edges, "hlb", "hlb", True).collect()] == [["hlb"]]


def test_growing_a_graph(spark):
    nodes, edges = graph.domain_graph(spark)
    more = spark.createDataFrame([("x", "t", "X", {}, 1), ("x", "t", "Later", {}, 2), ("hlb", "t", "Other", {}, 3)], graph.NODES + ", ord int")
    grown = graph.add_nodes(nodes, more)
    assert grown.count() == 39 and grown.where("id = 'x'").first().name == "X" and grown.where("id = 'hlb'").first().node_type == "disease"
    links = spark.createDataFrame([("x", "hlb", "causes", 1.0, 100), ("x", "nowhere", "causes", 1.0, 101)], graph.EDGES)
    assert graph.add_edges(grown, edges, links).count() == 71
    assert graph.add_edges(grown, edges, links, both_ways=True).where("dst = 'x' and src = 'hlb'").count() == 1


# --- intents ---


def test_labels_and_replies(spark):
    df = spark.createDataFrame([("Disease",), ("weather",), (None,)], "x string")
    assert [r[0] for r in df.select(intent.label_to_intent(F.col("x"))).collect()] == ["disease", "unknown", "unknown"]
    assert [r[0] for r in df.select(intent.route(intent.label_to_intent(F.col("x")))).collect()] == ["disease", "hybrid", "hybrid"]
    assert one(df.select(intent.reply(intent.no_result_key(F.lit("scheme"))))) == intent.REPLIES["scheme"]


# --- sketches ---


@pytest.mark.parametrize("n, p, bits, hashes", [(10000, 0.01, 95851, 7), (1000, 0.01, 9586, 7), (2000, 0.005, 22056, 8), (5000, 0.001, 71888, 10)])
def test_bloom_sizes(n, p, bits, hashes):
    assert (bloom.optimal_bits(n, p), bloom.optimal_hashes(bits, n)) == (bits, hashes)


def test_bloom_bits_and_no_false_negatives(spark):
    import hashlib

    items = spark.createDataFrame([(f"item {i} é",) for i in range(200)], "item string")
    filter_ = bloom.filter_bits(items, 2000, 5)
    h = lambda f, x: int(f(x.encode()).hexdigest(), 16)
    want = {(h(hashlib.md5, f"item {i} é") + k * h(hashlib.sha1, f"item {i} é")) % 2000 for i in range(200) for k in range(5)}
    assert {r.bit for r in filter_.collect()} == want
    assert all(r.maybe for r in bloom.membership(items, filter_, 2000, 5).collect())


def test_scalable_filter():
    first = bloom.scalable_filter(most=3)
    assert [(c, r) for _, c, r, _, _ in first] == [(1000, 0.01), (2000, 0.005), (4000, 0.0025)] and [b for *_, b, _ in first][:2] == [9586, 22056]


def test_scalable_filter_with_gaps_and_repeats(spark):
    rows = [(7 * (i // 2), f"item {i}") for i in range(50)]
    added = bloom.arrivals(spark.createDataFrame(rows, "id long, item string").repartition(3), ["id", "item"])
    assert sorted(r.ord for r in added.collect()) == list(range(1, 51))
    counts = {r.filter: r["count"] for r in bloom.scalable_assignment(added, 10).groupBy("filter").count().collect()}
    assert counts == {0: 10, 1: 20, 2: 20}
    probes = spark.createDataFrame([(f"item {i}",) for i in range(1050)], "item string")
    maybe = {r.item: r.maybe for r in bloom.scalable_membership(probes, added, 10).collect()}
    import hashlib

    h = lambda f, x: int(f(x.encode()).hexdigest(), 16)
    bits = lambda x, m, k: {(h(hashlib.md5, x) + i * h(hashlib.sha1, x)) % m for i in range(k)}
    by_id = sorted(rows)
    filters = [(set().union(*(bits(x, m, k) for _, x in by_id[a:b])), m, k) for (_, _, _, m, k), (a, b) in zip(bloom.scalable_filter(10, most=3), ((0, 10), (10, 30), (30, 50)))]
    assert maybe == {x: any(bits(x, m, k) <= held for held, m, k in filters) for x in maybe} and len(maybe) == 1050 and all(maybe[x] for _, x in rows)
    assert not any(r.maybe for r in bloom.scalable_membership(probes, added.limit(0), 10).collect())


# --- chunks and stores ---


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitter_keeps_words_and_sizes(text, size, overlap):
    chunks = chunking.split_recursively(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    letters = "".join(c for c in text if c in "ab")
    joined = [c for c in "".join(chunks) if c in "ab"]
    assert len(joined) >= len(letters)


def test_splitter_by_hand():
    assert chunking.split_recursively("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert chunking.split_recursively("one. two. three", 9, 0) == ["one. two", ". three"]
    assert chunking.split_recursively("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.split_recursively("x" * 10, 10, 3) == ["x" * 10] and chunking.split_recursively("", 10, 3) == []


def test_window_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(100))
    for n in (0, 1, 30, 31, 100):
        got = one(spark.createDataFrame([(text[:n],)], "t string").select(chunking.window_chunks(F.col("t"), 30, 10)))
        assert got == [text[i : min(i + 30, n)] for i in range(0, max(n - 10, min(n, 1)), 20)]
    with pytest.raises(ValueError):
        chunking.window_chunks(F.lit("x"), 10, 10)


def test_store(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.txt").write_text("first page text\fsecond page text")
    rows = tables.read_collections(spark, {"disease": str(pages), "scheme": None, "other": str(tmp_path / "none")}, lambda b: b.decode().split("\f"))
    chunks = chunking.chunked_pages(rows, "disease", 12, 0)
    ids = sorted(r.chunk_id for r in chunks.collect())
    assert ids[0] == "a.txt_page0_chunk0" and {r.page for r in chunks.collect()} == {0, 1}
    db = store.ChunkStore(spark, str(tmp_path / "store"))
    empty = {r.collection: r.n for r in db.stats().collect()}
    assert empty == {"citrus_diseases": 0, "government_schemes": 0}
    assert sorted(r.chunk_id for r in db.add(chunks, "disease").collect()) == ids
    db.add(chunks.limit(1).withColumn("content", F.lit("new")), "disease")
    db.add(chunks.withColumn("chunk_id", F.lit(None).cast("string")), "scheme")
    assert {r.collection: r.n for r in db.stats().collect()} == {"citrus_diseases": len(ids), "government_schemes": len(ids)}
    assert db.read("disease").where("content = 'new'").count() == 1 and db.read("scheme").where("chunk_id = 'scheme_0'").count() == 1
    db.drop("disease")
    assert db.read("disease").count() == 0 and db.read().count() == len(ids)
    assert sorted(p.name for p in (tmp_path / "store" / "government_schemes").iterdir()) == ["v1"]  # a change of one collection leaves the other alone
    assert sorted(p.name for p in (tmp_path / "store" / "citrus_diseases").iterdir()) == ["v2", "v3"]
    with pytest.raises(ValueError):
        db.read("other")


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    asked = spark.createDataFrame([(1, "A b"), (2, " a B"), (3, "long " * 30), (4, "new")], "id int, text string")
    cache = spark.createDataFrame([("a b", [3.0])], "key string, vector array<double>")
    rows, grown = caches.embed_cached(asked, cache, embed)
    assert {r.id: r.was_cached for r in rows.collect()} == {1: True, 2: True, 3: False, 4: False} and calls.value == 2
    assert grown.count() == 3 and caches.cleared(grown).count() == 0 and caches.warm(cache, asked, embed).count() == 3


def test_embedding_cache_is_bounded(spark):
    embed = lambda texts: texts.map(lambda t: [float(len(t))])
    ask = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    cache = spark.createDataFrame([], "key string, vector array<double>")
    _, cache = caches.embed_cached(ask("a", "b", "c"), cache, embed, size=3)
    rows, cache = caches.embed_cached(ask("a", "d"), cache, embed, size=3)  # b or c goes: both were used in the first batch
    assert {r.text: r.was_cached for r in rows.collect()} == {"a": True, "d": False}
    assert {r.key for r in cache.collect()} == {"a", "d", "b"}
    rows, _ = caches.embed_cached(ask("c", "b"), cache, embed, size=3)
    assert {r.text: r.was_cached for r in rows.collect()} == {"b": True, "c": False}


@pytest.mark.parametrize("keys, size, chunk", [(5, 10, 7), (30, 8, 11), (30, 8, 1000), (12, 12, 5), (200, 20, 50), (3, 1, 2)])
def test_lru_against_a_replay(spark, keys, size, chunk):
    from collections import OrderedDict

    rng = random.Random(keys * size)
    asked = [f"k{min(rng.randrange(keys), rng.randrange(keys))}" if rng.random() < 0.8 else "hot" for _ in range(400)]
    held, want = OrderedDict(), []
    for k in asked:
        want.append(k in held)
        held[k] = None
        held.move_to_end(k)
        if len(held) > size:
            held.popitem(last=False)
    frame = spark.createDataFrame([(k, i + 1, i * 2) for i, k in enumerate(asked)], "key string, ord long, tag int")
    got = sorted(caches.lru_hits(frame, size, chunk).collect(), key=lambda r: r.ord)
    assert [r.hit for r in got] == want and [(r.key, r.tag) for r in got] == [(k, i * 2) for i, k in enumerate(asked)]
    assert caches.lru_hits(frame.limit(0), size, chunk).collect() == []


# --- streams ---


def event_rows():
    return [("a", 0), ("a", 1799), ("a", 1800), ("a", 3700), ("b", 10), ("b", 5000), ("a", 5500)]


def test_ttl_batch_and_stream(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in event_rows()]
    frame = spark.createDataFrame(rows, "key string, ts timestamp")
    want = [("a", 0, False), ("a", 1799, True), ("a", 1800, False), ("a", 3700, False), ("a", 5500, False), ("b", 10, False), ("b", 5000, False)]
    seconds = lambda r: int((pd.Timestamp(r.ts) - pd.Timestamp("2024-01-01")).total_seconds())
    got = sorted((r.key, seconds(r), r.hit) for r in caches.ttl_hits(frame).collect())
    assert got == sorted(want)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rq.ttl_cache(rq.read_events(spark, str(tmp_path / "in")))
    assert sorted((r.key, seconds(r), r.hit) for r in rq.drain(stream, str(tmp_path / "out")).collect()) == sorted(want)


def test_ttl_of_dense_keys_null_keys_and_early_times(spark):
    rng = random.Random(12)
    rows = [("hot", t) for t in rng.sample(range(-900_000, 900_000), 700)] + [("edge", 100 * i) for i in range(-40, 40)] + [(None, rng.randrange(5000)) for _ in range(60)] + [("hot", 77), ("hot", 77), ("late", None), ("edge", None)]
    frame = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    for seconds in (100, 1800, 100_000):
        want, until = [], {}
        for key, at in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
            hit = at is not None and at < until.get(key, -(10**9))
            if not hit and at is not None:
                until[key] = at + seconds
            want.append((str(key), str(at), hit))
        got = caches.ttl_hits(frame.repartition(5), seconds).select("key", F.unix_seconds("ts").alias("s"), "hit").collect()
        assert sorted((str(r.key), str(r.s), r.hit) for r in got) == sorted(want), seconds
    assert caches.ttl_hits(frame.limit(0)).collect() == []


def test_first_requests(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in event_rows()]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = rq.drain(rq.first_requests(rq.read_events(spark, str(tmp_path / "in")), ["key"]), str(tmp_path / "out"))
    assert sorted(r.key for r in got.collect()) == ["a", "b"]


# --- jobs ---


def test_ingest(spark, tmp_path):
    from quern.plans.ingest import ingest

    for kind in ("disease", "scheme"):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "book.txt").write_text("some words of a page. " * 200 + "\f" + "another page")
    paths = {"disease": str(tmp_path / "disease"), "scheme": str(tmp_path / "scheme")}
    split = lambda b: b.decode().split("\f")
    first = {r.collection: r.n for r in ingest(spark, paths, str(tmp_path / "db"), split).collect()}
    again = {r.collection: r.n for r in ingest(spark, {**paths, "scheme": None}, str(tmp_path / "db"), split).collect()}
    assert first == again and all(n > 2 for n in first.values())
    with pytest.raises(FileNotFoundError):
        ingest(spark, {}, str(tmp_path / "db"), split)


def test_answers_from_cache(spark):
    from quern.plans import catalogue
    from quern.plans.answer import answer_cached, as_json

    sf = "/root/testdata/sf0.001"
    asked = catalogue.answer_questions(spark, sf).limit(3)
    asked = asked.unionByName(asked.withColumns({"query_id": F.col("query_id") + 1000, "question": F.concat(F.lit("  "), F.upper("question"))}))
    empty = spark.createDataFrame([], "query_hash string, success boolean, intent string, outcome string, n_sources long, sources string, answer string")
    rows, cache = answer_cached(catalogue.corpus(spark, sf), asked, empty, classifier=catalogue.fixture_intent)
    assert rows.count() == 6 and cache.count() == 3 and rows.where("was_cached").count() == 0
    rows, _ = answer_cached(catalogue.corpus(spark, sf), asked, cache, classifier=catalogue.fixture_intent)
    assert rows.where("was_cached").count() == 6 and '"success":true' in as_json(rows).first().body


def test_cached_answers_expire_and_are_bounded(spark):
    from quern.plans import catalogue
    from quern.plans.answer import answer_cached

    corpus = catalogue.corpus(spark, "/root/testdata/sf0.001").limit(5)
    vec = corpus.select(F.col("embedding").alias("query_vec")).limit(1)
    ask = lambda *qs: vec.crossJoin(spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "query_id long, question string"))
    few, start = Settings(response_cache_size=2, response_ttl_seconds=100), datetime(2024, 1, 1)
    cache = spark.createDataFrame([], "query_hash string, success boolean, intent string, outcome string, n_sources long, sources string, answer string")
    seen = lambda rows: {r.query_id: r.was_cached for r in rows.collect()}
    rows, cache = answer_cached(corpus, ask("hi", "thanks"), cache, start, few)
    assert seen(rows) == {0: False, 1: False} and cache.count() == 2
    rows, cache = answer_cached(corpus, ask("HI ", "bye"), cache, start + timedelta(seconds=60), few)
    assert seen(rows) == {0: True, 1: False} and cache.count() == 2  # thanks was used longest ago
    rows, cache = answer_cached(corpus, ask("thanks", "hi"), cache, start + timedelta(seconds=99), few)
    assert seen(rows) == {0: False, 1: True}
    rows, _ = answer_cached(corpus, ask("hi"), cache, start + timedelta(seconds=100), few)
    assert seen(rows) == {0: False}  # a use does not prolong it


def test_generator_and_labels(spark):
    from quern.plans import catalogue
    from quern.plans.answer import answer, generated

    sf = "/root/testdata/sf0.001"
    vec = catalogue.vectors(spark, sf).where("vec_id = 3").select(F.col("embedding").alias("query_vec"))
    rows = [(1, "what of canker"), (2, "what grants"), (3, "hm"), (4, "thanks"), (5, "broken"), (6, "no answer please")]
    asked = vec.crossJoin(spark.createDataFrame(rows, "query_id long, question string"))
    raw = {1: "INTENT: disease\nCONFIDENCE: 0.9", 2: "INTENT: scheme\nCONFIDENCE: 0.8", 3: "INTENT: out\nCONFIDENCE: 0.2", 4: "INTENT: greeting\nCONFIDENCE: 1", 6: "INTENT: disease\nCONFIDENCE: 0.7"}
    labels = lambda q: F.element_at(F.create_map(*[F.lit(x) for i, t in raw.items() for x in (dict(rows)[i], t)]), q)

    @F.pandas_udf("string")
    def model(system, prompt):
        return pd.Series([None if "no answer" in p else f"{s[:24]}|{p[-14:]}|{'[Source 1' in p}" for s, p in zip(system, prompt)])

    got = {r.query_id: r for r in answer(catalogue.corpus(spark, sf), asked, labels=labels, generator=model).collect()}
    assert got[1].answer == "You advise citrus growers|what of canker|True"[:24] + "|what of canker|True" and got[1].outcome == "answer" and got[1].n_sources > 0
    assert got[2].intent == "scheme" and got[2].answer.endswith("what grants|True") and got[4].outcome == "greeting:thanks"
    assert got[5].intent == "unknown" and got[5].outcome == "answer" and got[3].intent == "unknown"  # an unknown intent is looked up in both collections
    assert (got[6].success, got[6].outcome, got[6].answer) == (False, "failed", intent.REPLIES["failed"])
    empty = {r.query_id: r for r in answer(catalogue.corpus(spark, sf).limit(0), asked, labels=labels, generator=model).collect()}
    assert empty[3].outcome == "ambiguous_query" and empty[3].answer.startswith("A grower's question is u|") and empty[5].outcome == "ambiguous_query"
    assert empty[1].outcome == "no_documents" and empty[1].success
    table = spark.createDataFrame([("q", "disease", 0, None, None), ("q", "scheme", 0, None, None), ("q", "unknown", 0, None, None), ("q", "disease", 2, "ctx", "a:1; b:2")], "question string, intent string, n long, context string, sources string")
    out = [(r.answer, r.citations, r.failed) for r in generated(table).collect()]
    assert out == [(intent.REPLIES[k], [], False) for k in ("disease", "scheme", "other")] + [("ctx", ["a:1", "b:2"], False)]


@pytest.mark.parametrize("name", ["knn_batch_rownum", "knn_cosine_batch", "knn_ip_batch", "knn_filtered_batch", "knn_threshold_batch", "knn_per_collection_batch"])
def test_batched_searches_ask_every_fiftieth_vector(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {r.query_id for r in found.select("query_id").distinct().collect()} == set(range(0, 500, 50))


def test_long_paths_and_many_types(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(53)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(52)], "src string, dst string, weight double")
    found = {r.id: r.cost for r in graph.shortest_paths(nodes, edges, nodes.where("id = 'n0'").select(F.col("id").alias("start"))).collect()}
    assert found == {f"n{i}": float(i) for i in range(53)}
    many = [("s", "scheme", "S", {"type": "x"}), *[(f"t{i}", f"type{i}", f"T{i}", {"type": ""}) for i in range(1200)]]
    kinds = spark.createDataFrame(many, "id string, node_type string, name string, metadata map<string,string>")
    links = spark.createDataFrame([("s", f"t{i}", "for", 1.0, i) for i in range(1200)], "src string, dst string, relation string, weight double, seq int")
    assert graph.schemes_for(kinds, links, kinds.where("id <> 's'").select("id")).count() == 1200

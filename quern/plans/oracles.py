"""DuckDB SQL for the registered queries, written from what each operator means, not from its plan."""

from __future__ import annotations

from quern.operators import intent
from quern.operators.bloom import scalable_filter
from quern.operators.dictionary import DISEASE_KEYWORDS, SCHEME_KEYWORDS
from quern.operators.lexical import STOP_WORDS
from quern.functions.text import SYSTEM_PROMPTS
from quern.plans.catalogue import BITS, COMMON, EACH, FIRST_CAPACITY, FIXTURE_DISEASE, FIXTURE_SCHEME, HASHES, LABELS, LRU_SIZE, NARROW, SAMPLES, SEGMENTS, TTL

W = r"[\p{L}\p{N}_]+"
#: White space of any script; trim() takes U+0020 alone and RE2's \s is ASCII.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def lit(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def rows(data) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data)


def array(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}')"


def clean_words(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({x}), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> ''))"


def prefix_hits(x: str, words) -> str:
    return f"list_filter({array(dict.fromkeys(words))}, lambda k: len(list_filter({clean_words(x)}, lambda w: starts_with(w, k))) > 0)"


def ip(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]))"


def l2(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def cos(a, b):
    return f"({ip(a, b)} / (sqrt({ip(a, a)}) * sqrt({ip(b, b)})))"


VEC = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
CORPUS = f"""{VEC}, corpus AS (SELECT vec_id, v, label, text AS content, source, CAST(doc_id % 10 AS INT) AS page,
  CASE WHEN label % 2 = 0 THEN 'disease' ELSE 'scheme' END AS collection FROM vec JOIN documents ON doc_id = vec_id)"""
ASKED = f"q AS (SELECT vec_id AS query_id, v AS qv, text AS question FROM vec JOIN documents ON doc_id = vec_id WHERE vec_id % {EACH} = 0)"
CLEAN = r"trim(regexp_replace(trim(regexp_replace({x}, '" + WS.replace("{", "{{").replace("}", "}}") + r"+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s.,!?-]', '', 'g'))"


def one_knn(dist: str, k: int, more: str = "", cols: str = "vec_id, distance, rank", where: str = "true", part: str = "") -> str:
    return f"""WITH {VEC}, q AS (SELECT v AS qv FROM vec WHERE vec_id = 0), d AS (SELECT vec.*, round({dist}, 6) AS distance {more} FROM vec, q WHERE {where}),
    r AS (SELECT *, round(1 - distance, 6) AS score, CAST(row_number() OVER ({part} ORDER BY distance, vec_id) AS INT) AS rank FROM d QUALIFY rank <= {k}) SELECT {cols} FROM r"""


def many_knn(dist: str, k: int, more: str = "", cols: str = "vec_id, distance, rank", where: str = "true", part: str = "") -> str:
    return f"""WITH {VEC}, q AS (SELECT vec_id AS query_id, v AS qv FROM vec WHERE vec_id % {EACH} = 0), d AS (SELECT query_id, vec.*, round({dist}, 6) + 0.0 AS distance {more} FROM vec, q WHERE {where}),
    r AS (SELECT *, round(1 - distance, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id {part} ORDER BY distance, vec_id) AS INT) AS rank FROM d QUALIFY rank <= {k}) SELECT query_id, {cols} FROM r"""


def candidates(n: int) -> str:
    return f"""cand AS (SELECT q.query_id, c.vec_id AS doc, c.content, c.source, c.page, round({l2("qv", "v")}, 12) AS distance,
      row_number() OVER (PARTITION BY q.query_id ORDER BY round({l2("qv", "v")}, 12), c.vec_id) AS ord FROM corpus c, q QUALIFY ord <= {n})"""


BM25 = f"""dl AS (SELECT query_id, doc, len({tok("content")}) AS dl FROM cand), stat AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY query_id),
    words AS (SELECT query_id, doc, unnest({tok("content")}) AS term FROM cand), tf AS (SELECT query_id, doc, term, count(*) AS tf FROM words GROUP BY ALL),
    df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL), qw AS (SELECT query_id, unnest({tok("question")}) AS term FROM q), qt AS (SELECT query_id, term, count(*) AS qtf FROM qw GROUP BY ALL),
    hit AS (SELECT query_id, doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
      FROM tf JOIN qt USING (query_id, term) JOIN df USING (query_id, term) JOIN dl USING (query_id, doc) JOIN stat USING (query_id) GROUP BY ALL),
    bm AS (SELECT query_id, doc, coalesce(s, 0) AS bm25 FROM cand LEFT JOIN hit USING (query_id, doc))"""
HYBRID = f"""{candidates(15)}, {BM25},
    mx AS (SELECT cand.*, bm25, max(bm25) OVER w AS mb, max(1 - distance) OVER w AS ms FROM cand JOIN bm USING (query_id, doc) WINDOW w AS (PARTITION BY query_id)),
    sc AS (SELECT *, round(0.3 * bm25 / CASE WHEN mb > 0 THEN mb ELSE 1 END + 0.7 * (1 - distance) / CASE WHEN ms > 0 THEN ms ELSE 1 END, 6) AS score FROM mx),
    hy AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INT) AS rank FROM sc QUALIFY rank <= 5)"""

_tf = "[\\p{L}\\p{N}_]{2,}"


def tfidf_words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{_tf}'), lambda w: NOT list_contains({array(STOP_WORDS)}, w))"


def tfidf_terms(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


TFIDF = f"""{candidates(25)}, dw AS (SELECT query_id, doc, {tfidf_words("content")} AS w FROM cand), dt AS (SELECT query_id, doc, unnest({tfidf_terms("w")}) AS term FROM dw),
    tf AS (SELECT query_id, doc, term, count(*) AS tf FROM dt GROUP BY ALL), nn AS (SELECT query_id, count(*) AS n FROM cand GROUP BY ALL),
    voc AS (SELECT query_id, term, count(*) AS df, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, term) AS nth FROM tf GROUP BY query_id, term QUALIFY nth <= 10000),
    idf AS (SELECT query_id, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM voc JOIN nn USING (query_id)), wt AS (SELECT query_id, doc, term, tf * idf AS w FROM tf JOIN idf USING (query_id, term)),
    q0 AS (SELECT query_id, {tfidf_words("question")} AS w FROM q), q1 AS (SELECT query_id, unnest({tfidf_terms("w")}) AS term FROM q0), q2 AS (SELECT query_id, term, count(*) AS qtf FROM q1 GROUP BY ALL),
    qw AS (SELECT query_id, term, qtf * idf AS qw FROM q2 JOIN idf USING (query_id, term)), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY ALL),
    dn AS (SELECT query_id, doc, sqrt(sum(w * w)) AS dn FROM wt GROUP BY ALL), dots AS (SELECT query_id, doc, sum(w * qw) AS dot FROM wt JOIN qw USING (query_id, term) GROUP BY ALL),
    sc AS (SELECT query_id, doc, ord, round(coalesce(dot / (dn * qn), 0), 6) AS score FROM cand LEFT JOIN dots USING (query_id, doc) LEFT JOIN dn USING (query_id, doc) LEFT JOIN qn USING (query_id))"""
LISTS = f"""lists AS (SELECT q.query_id, q.question, c.vec_id, c.content, c.source, c.page, c.collection, round({l2("qv", "v")}, 6) AS distance,
    CAST(row_number() OVER (PARTITION BY q.query_id, c.collection ORDER BY round({l2("qv", "v")}, 6), c.vec_id) AS INT) AS rank FROM corpus c, q QUALIFY rank <= 5),
    rl AS (SELECT *, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY collection, rank) AS ord FROM lists)"""


def rrf(src: str, same: str, top: str = "") -> str:
    return f"""h AS (SELECT *, substr(coalesce(content, ''), 1, 100) AS head, coalesce(CAST(page AS VARCHAR), 'None') AS pg, CASE WHEN collection = 'disease' THEN 0 ELSE 1 END AS side FROM {src}),
    f AS (SELECT *, first_value(pg) OVER (PARTITION BY query_id, collection, head ORDER BY rank) AS fp FROM h), k AS (SELECT * FROM f WHERE side = 1 OR pg = fp),
    g AS (SELECT query_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(side * 1000000 + rank) AS o, arg_min(collection, side * 1000000 + rank) AS collection, arg_min(page, side * 1000000 + rank) AS page,
      arg_min(content, side * 1000000 + rank) AS content, arg_min(source, side * 1000000 + rank) AS source, arg_min(score, side * 1000000 + rank) AS score FROM k GROUP BY query_id, {same}),
    rf AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, o) AS INT) AS rrf_rank FROM g {top})"""


def relevance(question: str, content: str, score: str, disease, scheme) -> str:
    def shared(words):
        return f"len(list_intersect({prefix_hits(f'lower({question})', words)}, {prefix_hits(f'lower({content})', words)}))"

    m = f"({shared(disease)} + {shared(scheme)})"
    words = f"len(list_intersect(list_distinct({tok(question)}), list_distinct({tok(content)})))"
    phrase = " OR ".join(f"(length({question}) > {i} AND length(substr(lower({question}), {i + 1}, 30)) > 10 AND contains(lower({content}), substr(lower({question}), {i + 1}, 30)))" for i in (0, 15, 30, 45))
    return f"round(least({score} + least({words} * 0.04::DOUBLE, 0.25) + CASE WHEN {phrase} THEN 0.15::DOUBLE ELSE 0 END + least({m} * 0.03::DOUBLE, 0.2) + CASE WHEN {m} >= 3 THEN 0.05::DOUBLE ELSE 0 END, 1.0), 6)"


RERANK = f"""{CORPUS}, {ASKED}, {LISTS}, rs AS (SELECT *, {relevance("question", "content", "score", FIXTURE_DISEASE, FIXTURE_SCHEME)} AS rerank_score FROM rl),
    rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS INT) AS rerank_rank FROM rs)"""
KEY = f"CASE WHEN length(lower({strip('text')})) > 100 THEN md5(lower({strip('text')})) ELSE lower({strip('text')}) END"
HASH = f"md5(substr({spaced('lower(text)')}, 1, 200))"
DOCKEY = f"CASE WHEN source IS NOT NULL AND source <> '' THEN source || '_p' || (doc_id % 10) || '_' || substr({HASH}, 1, 8) ELSE {HASH} END"
RAW = r"regexp_replace(html, '<[^>]*>', E'\n\n\n 7 \n', 'g')"
PRE = CLEAN.format(x=r"regexp_replace(regexp_replace(regexp_replace(" + RAW + r", '\n{3,}', E'\n\n', 'g'), ' {2,}', ' ', 'g'), '(?m)^\s*\d+\s*$', '', 'g')")
NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'scheme' AS node_type, r_name AS name, NULL AS severity, r_name AS kind FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'disease', n_name, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' ELSE 'medium' END, NULL FROM nation
    UNION ALL SELECT DISTINCT 'n' || n_nationkey || '-' || c_mktsegment, 'symptom', n_name || ' ' || c_mktsegment, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 's' || s_suppkey, 'treatment', s_name, NULL, NULL FROM supplier UNION ALL SELECT 'c' || c_custkey, 'pest', c_name, NULL, NULL FROM customer)"""
EDGES = f"""seg AS (SELECT DISTINCT 'n' || n_nationkey AS home, 'n' || n_nationkey || '-' || c_mktsegment AS pair, CAST(n_nationkey AS BIGINT) * 20 + 2 * list_position({array(SEGMENTS)}, c_mktsegment) AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey),
    edges AS (SELECT home AS src, pair AS dst, 'causes' AS relation, 0.5::DOUBLE AS weight, seq FROM seg UNION ALL SELECT pair, home, 'symptom_of', 0.5::DOUBLE, seq + 1 FROM seg
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'treats', CAST(s_suppkey % 3 AS DOUBLE) / 10 + 0.25::DOUBLE, s_suppkey + 1000000000 FROM supplier
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'causes', 0.4::DOUBLE, c_custkey + 2000000000 FROM customer
    UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, 'subsidizes', 0.4::DOUBLE, s_suppkey + 3000000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'applies_to', CAST(n_nationkey % 4 AS DOUBLE) / 10 + 0.6::DOUBLE, CAST(n_nationkey AS BIGINT) + 4000000000 FROM nation)"""


def bfs(depth: int, name: str = "b", edges: str = "SELECT src, dst, seq FROM edges", starts: str = "SELECT id FROM nodes") -> str:
    """Recursive walk over simple paths; the least sequence of edges among the shortest is what a queue finds first."""
    return f"""{name}_e AS ({edges}), {name}_w(start, id, depth, path, sp) AS (SELECT id, id, 0, [id], CAST([] AS BIGINT[]) FROM ({starts})
    UNION ALL SELECT start, dst, depth + 1, list_append(path, dst), list_append(sp, CAST(seq AS BIGINT)) FROM {name}_w JOIN {name}_e ON src = {name}_w.id WHERE depth < {depth} AND NOT list_contains(path, dst)),
    {name} AS (SELECT * FROM {name}_w WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY depth, sp) = 1)"""


BOTH = "SELECT src, dst, seq FROM edges UNION ALL SELECT dst, src, seq + 1000000000000000 FROM edges"
NAMED = "array_to_string(list_transform(path, lambda p: names[p]), '>')"
NAMES = "nm AS (SELECT map(list(id), list(name)) AS names FROM nodes)"


def fold_by(digest: str, pieces: int, bits: str) -> str:
    """A hex digest's number modulo a column."""
    out = "0::BIGINT"
    for i in range(pieces):
        out = f"(({out} * (4294967296 % {bits}) + ('0x' || substr({digest}, {1 + 8 * i}, 8))::BIGINT) % {bits})"
    return out


def fold(digest: str, pieces: int, bits: int = BITS) -> str:
    out = "0::BIGINT"
    for i in range(pieces):
        out = f"(({out} * {2**32 % bits} + ('0x' || substr({digest}, {1 + 8 * i}, 8))::BIGINT) % {bits})"
    return out


KEYS = f"keys AS (SELECT doc_id, {DOCKEY} AS item FROM documents), hs AS (SELECT doc_id, item, {fold('md5(item)', 4)} AS h1, {fold('sha1(item)', 5)} AS h2 FROM keys), bits AS (SELECT doc_id, item, (h1 + i * h2) % {BITS} AS bit FROM hs, range({HASHES}) r(i))"
NARROW_BITS = f"keys AS (SELECT doc_id, {DOCKEY} AS item FROM documents), hs AS (SELECT doc_id, {fold('md5(item)', 4, NARROW[0])} AS h1, {fold('sha1(item)', 5, NARROW[0])} AS h2 FROM keys), bits AS (SELECT doc_id, (h1 + i * h2) % {NARROW[0]} AS bit FROM hs, range({NARROW[1]}) r(i)), new AS (SELECT DISTINCT d FROM (SELECT min(doc_id) AS d FROM bits GROUP BY bit))"
GROWN = [(j, FIRST_CAPACITY * (2**j - 1), FIRST_CAPACITY * (2 ** (j + 1) - 1), bits, hashes) for j, _, _, bits, hashes in scalable_filter(FIRST_CAPACITY, most=16)]
QUESTIONS = f"qs AS (SELECT * FROM ({rows(SAMPLES)}) t(query_id, question) UNION ALL SELECT conv_id * 1000 + turn + 100, text FROM conversations)"


def has(x: str, words) -> str:
    return f"len(list_intersect({clean_words(x)}, {array(words)})) > 0"


def rule(x: str, disease, scheme) -> str:
    plain = rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
    return f"""CASE WHEN {plain} IN ({", ".join(map(lit, intent.GREETINGS))}) AND len(string_split({plain}, ' ')) <= 3 THEN 'greeting' WHEN {has(x, disease)} AND {has(x, scheme)} THEN 'hybrid'
      WHEN {has(x, disease)} THEN 'disease' WHEN {has(x, scheme)} THEN 'scheme' ELSE 'out_of_scope' END"""


def cascade(x: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({strip(f'lower({x})')}, {lit(p)})" for p in ps) + f" THEN {lit(k)}" for k, ps in intent.CASCADE)
    return f"CASE {whens} ELSE 'hello' END"


REPLY = "CASE " + " ".join(f"WHEN k = {lit(k)} THEN {lit(v)}" for k, v in intent.REPLIES.items()) + " END"
CHUNKS = """pieces AS (SELECT source, doc_id, i, substr(text, CAST(i * 1200 + 1 AS BIGINT), 1500) AS content FROM documents, range(greatest(1, CAST(ceil((length(text) - 300) / 1200.0) AS BIGINT))) r(i) WHERE length(text) > 0),
    ch AS (SELECT source, doc_id, content, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i, content) - 1 AS INT) AS chunk_index,
      CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'citrus_diseases' ELSE 'government_schemes' END AS collection FROM pieces), ci AS (SELECT *, source || '_page' || doc_id || '_chunk' || chunk_index AS chunk_id FROM ch)"""
BLOCK = "'[Source ' || {r} || ': ' || coalesce(source, 'Unknown') || ', Page ' || coalesce(CAST(page AS VARCHAR), 'N/A') || E']\\n' || content"


def answer_sql() -> str:
    """Hybrid search by collection, documents' keys, fusion, reranking, threshold and fallback, in one statement."""
    relevant = relevance("question", "content", "score", FIXTURE_DISEASE, FIXTURE_SCHEME)
    one = HYBRID.replace("PARTITION BY q.query_id ", "PARTITION BY q.query_id, c.collection ").replace("c.content,", "c.content, c.collection,").replace("FROM corpus c, q QUALIFY", "FROM corpus c JOIN tgt q ON q.target = c.collection QUALIFY")
    # every later step is by query and collection: the collection goes into the key
    one = one.replace("SELECT q.query_id,", "SELECT q.query_id || ':' || c.collection AS query_id, q.query_id AS qid,").replace("FROM q)", "FROM (SELECT query_id || ':' || target AS query_id, question FROM tgt))")
    return f"""WITH {CORPUS}, q AS (SELECT item_id AS query_id, v AS qv, text AS question FROM benchmark JOIN vec ON vec_id = item_id),
    qi AS (SELECT *, {rule("question", FIXTURE_DISEASE, FIXTURE_SCHEME)} AS intent FROM q),
    tgt AS (SELECT query_id, qv, question, intent, unnest(CASE intent WHEN 'hybrid' THEN ['disease', 'scheme'] WHEN 'disease' THEN ['disease'] WHEN 'scheme' THEN ['scheme'] ELSE CAST([] AS VARCHAR[]) END) AS target FROM qi),
    {one},
    dd AS (SELECT *, {HASH.replace("text", "content")} AS hash FROM hy),
    un AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN source <> '' AND page IS NOT NULL THEN source || '_p' || page || '_' || substr(hash, 1, 8) ELSE hash END ORDER BY collection, rank) = 1),
    fo AS (SELECT un.* EXCLUDE (rank, query_id, ord), qid AS query_id, CAST(row_number() OVER (PARTITION BY qid, collection ORDER BY rank) AS INT) AS rank FROM un),
    od AS (SELECT fo.*, qi.question, qi.intent, row_number() OVER (PARTITION BY fo.query_id ORDER BY collection, rank) AS ord FROM fo JOIN qi USING (query_id)),
    hq AS (SELECT * FROM od WHERE intent = 'hybrid'), {rrf("hq", "side, pg, head", "QUALIFY rrf_rank <= 8")},
    al AS (SELECT rf.query_id, qi.question, qi.intent, collection, content, source, page, score, CAST(rrf_rank AS BIGINT) AS ord, 8 AS lim FROM rf JOIN qi USING (query_id)
      UNION ALL SELECT query_id, question, intent, collection, content, source, page, score, ord, 4 FROM od WHERE intent <> 'hybrid'),
    rs AS (SELECT *, {relevant} AS rerank_score FROM al), r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS rr FROM rs QUALIFY rr <= lim),
    r2 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY query_id, {strip("lower(substr(content, 1, 100))")} ORDER BY rr) = 1),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr) AS fr FROM r2 WHERE score >= 0.25 OR rerank_score >= 0.25),
    lo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS fr FROM od WHERE query_id NOT IN (SELECT query_id FROM r3) QUALIFY fr <= 4),
    fin AS (SELECT query_id, content, source, page, fr FROM r3 UNION ALL SELECT query_id, content, source, page, fr FROM lo),
    ga AS (SELECT query_id, count(*) AS n, string_agg({BLOCK.format(r="fr")}, E'\\n\\n' ORDER BY fr) AS context, string_agg(source || ':' || coalesce(CAST(page AS VARCHAR), 'N/A'), '; ' ORDER BY fr) AS sources FROM fin GROUP BY query_id),
    ou AS (SELECT qi.*, coalesce(n, 0) AS n, coalesce(sources, '') AS sources, context, {cascade("question")} AS gk,
      CASE WHEN intent = 'greeting' THEN 'greeting:' || {cascade("question")} WHEN intent = 'out_of_scope' THEN intent WHEN coalesce(n, 0) = 0 THEN 'no_documents' ELSE 'answer' END AS outcome FROM qi LEFT JOIN ga USING (query_id)),
    sa AS (SELECT *, CASE WHEN intent = 'greeting' THEN gk ELSE outcome END AS k FROM ou)
    SELECT query_id, true AS success, intent, outcome, n AS n_sources, sources, md5(CASE WHEN outcome = 'answer' THEN context ELSE {REPLY} END) AS answer_md5 FROM sa"""


ORACLE_SQL: dict[str, str] = {
    "knn_l2": one_knn(l2("qv", "v"), 5),
    "knn_cosine": one_knn(f"1 - {cos('qv', 'v')}", 5, cols="vec_id, distance, score, rank"),
    "knn_ip": one_knn(f"1 - {ip('qv', 'v')}", 5),
    "knn_filtered": one_knn(l2("qv", "v"), 5, where="label = 3", cols="vec_id, label, distance, rank"),
    "knn_threshold": one_knn(f"1 - {cos('qv', 'v')}", 20, cols="vec_id, score, rank") + " WHERE score >= 0.25",
    "knn_batch_rownum": f"""WITH {VEC}, d AS (SELECT q.vec_id AS query_id, c.vec_id, round({l2("q.v", "c.v")}, 6) AS distance FROM vec c, vec q WHERE q.vec_id % {EACH} = 0)
        SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM d QUALIFY rank <= 5""",
    "knn_per_collection": one_knn(l2("qv", "v"), 5, ", CASE WHEN label % 2 = 0 THEN 'diseases' ELSE 'schemes' END AS collection", "collection, vec_id, distance, rank", part="PARTITION BY collection"),
    "knn_cosine_batch": many_knn(f"1 - {cos('qv', 'v')}", 5, cols="vec_id, distance, score, rank"),
    "knn_ip_batch": many_knn(f"1 - {ip('qv', 'v')}", 5),
    "knn_filtered_batch": many_knn(l2("qv", "v"), 5, where="label = 3", cols="vec_id, label, distance, rank"),
    "knn_threshold_batch": many_knn(f"1 - {cos('qv', 'v')}", 20, cols="vec_id, score, rank") + " WHERE score >= 0.25",
    "knn_per_collection_batch": many_knn(l2("qv", "v"), 5, ", CASE WHEN label % 2 = 0 THEN 'diseases' ELSE 'schemes' END AS collection", "collection, vec_id, distance, rank", part=", collection"),
    "bm25_fit_df": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({tok('text')})) AS term FROM documents) GROUP BY term",
    "bm25_idf": f"WITH d AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({tok('text')})) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d, n",
    "bm25_topk_corpus": f"""WITH dl AS (SELECT doc_id AS doc, len({tok("text")}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), w AS (SELECT doc_id AS doc, unnest({tok("text")}) AS term FROM documents),
        tf AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), qw AS (SELECT item_id AS query_id, unnest({tok("text")}) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qtf FROM qw GROUP BY ALL),
        s AS (SELECT query_id, doc, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc), st GROUP BY ALL)
        SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank FROM s QUALIFY rank <= 5""",
    "bm25_candidates": f"WITH {CORPUS}, {ASKED}, {candidates(15)}, {BM25} SELECT query_id, doc, round(bm25, 6) AS bm25 FROM bm",
    "tfidf_topk": f"WITH {CORPUS}, {ASKED}, {TFIDF} SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INT) AS rank FROM sc QUALIFY rank <= 5",
    "hybrid_search": f"WITH {CORPUS}, q AS (SELECT 0 AS query_id, v AS qv, 'the state of the water and light' AS question FROM vec WHERE vec_id = 0), {HYBRID} SELECT doc, score, rank FROM hy",
    "hybrid_batch": f"WITH {CORPUS}, {ASKED}, {HYBRID} SELECT query_id, doc, score, rank FROM hy",
    "smart_search_nohybrid": f"""WITH {CORPUS}, {ASKED}, d AS (SELECT query_id, vec_id AS doc, round({l2("qv", "v")}, 6) AS distance FROM corpus, q)
        SELECT query_id, doc, distance, round(1 - distance, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc) AS INT) AS rank FROM d QUALIFY rank <= 5""",
    "rrf_parity": f"WITH {CORPUS}, {ASKED}, {LISTS}, {rrf('rl', 'side, pg, head')} SELECT query_id, collection, page, md5(content) AS content_md5, rrf_score, rrf_rank FROM rf",
    "rrf_fuse": f"WITH {CORPUS}, {ASKED}, {LISTS}, {rrf('rl', 'pg, head', 'QUALIFY rrf_rank <= 8')} SELECT query_id, collection, page, md5(content) AS content_md5, rrf_score, rrf_rank FROM rf",
    "rerank_score": f"WITH {RERANK} SELECT query_id, vec_id, rerank_score, rerank_rank FROM rr WHERE rerank_rank <= 10",
    "rerank_threshold": f"WITH {RERANK} SELECT query_id, vec_id, score, rerank_score FROM rr WHERE rerank_rank <= 4 AND (score >= 0.3 OR rerank_score >= 0.3)",
    "rerank_fallback": f"""WITH {RERANK}, kept AS (SELECT * FROM rr WHERE rerank_rank <= 4 AND (score >= 0.55 OR rerank_score >= 0.55)),
        lost AS (SELECT query_id, vec_id, 'low_relevance' AS edge_case, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INT) AS final_rank FROM rl WHERE query_id NOT IN (SELECT query_id FROM kept) QUALIFY final_rank <= 4)
        SELECT query_id, vec_id, CAST(NULL AS VARCHAR) AS edge_case, rerank_rank AS final_rank FROM kept UNION ALL SELECT * FROM lost""",
    "prefix_dedup_100": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {strip('lower(substr(text, 1, 100))')}",
    "docid_dedup_200": f"SELECT min(doc_id) AS doc_id, {DOCKEY.replace('text', 'any_text')} AS doc_key FROM (SELECT doc_id, source, text AS any_text FROM documents) GROUP BY doc_key".replace("min(doc_id) AS doc_id", "min(doc_id) AS doc_id"),
    "dedup_batch": f"SELECT doc_id % 7 AS batch, min(doc_id) AS doc_id FROM documents GROUP BY doc_id % 7, {HASH}",
    "cross_collection_dedup": f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'disease' ELSE 'scheme' END AS collection, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id % 2, doc_id) = 1""",
    "clean_text": f"SELECT doc_id, {CLEAN.format(x='text')} AS cleaned FROM documents",
    "preprocess_text": f"SELECT page_id, trim({PRE}) AS cleaned FROM pages",
    "truncate_text": r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), ' [^ ]*\z', '') || '...' END AS short FROM documents",
    "extract_keywords": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
        f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f QUALIFY r <= 10), s AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM k GROUP BY doc_id)
        SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN s USING (doc_id)""",
    "cache_key": f"SELECT conv_id, turn, {KEY} AS cache_key FROM conversations",
    "query_hash": f"SELECT conv_id, turn, md5({spaced('lower(text)')}) AS query_hash FROM conversations",
    "token_counts": f"SELECT doc_id, CAST(len({tok('text')}) AS INT) AS n_tokens, CAST(len(list_distinct({tok('text')})) AS INT) AS n_distinct FROM documents",
    "kw_exact": f"SELECT doc_id, array_to_string(list_sort(list_intersect({clean_words('text')}, {array(dict.fromkeys(DISEASE_KEYWORDS + SCHEME_KEYWORDS + COMMON))})), ',') AS matches FROM documents",
    "kw_prefix": f"""WITH w AS (SELECT doc_id, unnest({clean_words("text")}) AS w FROM documents), k AS (SELECT unnest({array(dict.fromkeys(DISEASE_KEYWORDS + COMMON))}) AS k), m AS (SELECT DISTINCT doc_id, k FROM w JOIN k ON starts_with(w, k)),
        s AS (SELECT doc_id, string_agg(k, ',' ORDER BY k) AS matches FROM m GROUP BY doc_id) SELECT doc_id, coalesce(matches, '') AS matches FROM documents LEFT JOIN s USING (doc_id)""",
    "kw_all": f"""WITH k AS (SELECT DISTINCT * FROM ({rows([("disease", k) for k in DISEASE_KEYWORDS + ("the", "les")] + [("scheme", k) for k in SCHEME_KEYWORDS + ("and", "que")])}) t(category, keyword)),
        w AS (SELECT doc_id AS doc, unnest({clean_words("text")}) AS w FROM documents) SELECT DISTINCT doc, category, keyword FROM w JOIN k ON starts_with(w, keyword)""",
    "kw_overlap": f"""WITH p AS (SELECT item_id AS query_id, list_distinct({tok("b.text")}) AS q, list_distinct({tok("d.text")}) AS c FROM benchmark b JOIN documents d ON doc_id = item_id),
        n AS (SELECT query_id, CAST(len(list_intersect(list_intersect(q, c), {array(FIXTURE_DISEASE)})) AS INT) AS disease, CAST(len(list_intersect(list_intersect(q, c), {array(FIXTURE_SCHEME)})) AS INT) AS scheme FROM p)
        SELECT query_id, disease, disease + scheme AS both_lists FROM n""",
    "kw_phrase": r"""WITH p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_filter(['the and', 'of the', 'mit license', 'root rot'], lambda k: contains(t, ' ' || k || ' '))), ',') AS matches FROM p""",
    "kg_stats": f"""WITH {NODES}, {EDGES}, c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e) SELECT 'total_nodes' AS metric, CAST(n AS DOUBLE) AS value FROM c
        UNION ALL SELECT 'total_edges', CAST(e AS DOUBLE) FROM c UNION ALL SELECT 'avg_degree', round(e / n, 6) FROM c UNION ALL SELECT 'type:' || node_type, CAST(count(*) AS DOUBLE) FROM nodes GROUP BY node_type""",
    "kg_nodes_by_type": f"WITH {NODES} SELECT id, name, severity FROM nodes WHERE node_type = 'disease'",
    "kg_neighbors": f"WITH {EDGES} SELECT dst, relation, CAST(weight AS DOUBLE) AS weight, seq FROM edges WHERE src = 'n3'",
    "kg_incoming": f"WITH {EDGES} SELECT src, relation, CAST(weight AS DOUBLE) AS weight, seq FROM edges WHERE dst = 'n3'",
    "kg_bfs": f"WITH RECURSIVE {NODES}, {EDGES}, {bfs(4)} SELECT start, id, depth, array_to_string(path, '>') AS path FROM b",
    "kg_bfs_relation": f"WITH RECURSIVE {NODES}, {EDGES}, {bfs(3, 'b', '''SELECT src, dst, seq FROM edges WHERE relation IN ('causes', 'treats')''')} SELECT start, id, depth, array_to_string(path, '>') AS path FROM b",
    "kg_multi_hop": f"WITH RECURSIVE {NODES}, {EDGES}, {NAMES}, {bfs(3)} SELECT start, b.id, name, node_type AS type, depth AS hops, {NAMED} AS path FROM nm, b JOIN nodes ON nodes.id = b.id WHERE node_type IN ('disease', 'symptom')",
    "kg_schemes": f"""WITH RECURSIVE {NODES}, {EDGES}, {NAMES}, {bfs(2)} SELECT b.id, start AS scheme, s.name AS scheme_name, s.kind AS scheme_type, {NAMED} AS path FROM nm, b JOIN nodes s ON s.id = start WHERE s.node_type = 'scheme'""",
    "kg_treatments_both_ways": f"""WITH RECURSIVE {NODES}, {EDGES}, {bfs(2, "b", BOTH)} SELECT start, b.id, depth AS hops FROM b JOIN nodes s ON s.id = start JOIN nodes t ON t.id = b.id WHERE s.node_type = 'symptom' AND t.node_type = 'treatment'""",
    "kg_disease_context": f"""WITH RECURSIVE {NODES}, {EDGES}, {bfs(2)}, x AS (SELECT b.*, s.node_type AS st, t.node_type AS tt, t.name AS tn, s.name AS sn FROM b JOIN nodes s ON s.id = start JOIN nodes t ON t.id = b.id)
        SELECT start, CASE tt WHEN 'symptom' THEN 'symptoms' WHEN 'treatment' THEN 'treatments' ELSE 'related_pests' END AS part, id, tn AS name, depth AS hops FROM x WHERE st = 'disease' AND (tt = 'symptom' AND depth = 1 OR tt IN ('treatment', 'pest'))
        UNION ALL SELECT id, 'applicable_schemes', start, sn, depth FROM x WHERE st = 'scheme' AND tt = 'disease'""",
    "nation_bfs": """WITH a AS (SELECT 'r' || n_regionkey AS start, 1 AS depth, 'n' AS kind, n_nationkey AS k FROM nation), x AS (SELECT start, depth, kind FROM a UNION ALL SELECT start, 2, 'c' FROM a JOIN customer ON c_nationkey = k UNION ALL SELECT start, 2, 's' FROM a JOIN supplier ON s_nationkey = k)
        SELECT start, depth, kind, count(*) AS n FROM x GROUP BY ALL""",
    "intent_rules": f"WITH {QUESTIONS} SELECT query_id, {rule('question', intent.DISEASE_WORDS, intent.SCHEME_WORDS)} AS intent FROM qs",
    "intent_route": f"""WITH {QUESTIONS}, i AS (SELECT query_id, {rule("question", intent.DISEASE_WORDS, intent.SCHEME_WORDS)} AS branch FROM qs)
        SELECT query_id, branch, CASE WHEN branch = 'hybrid' THEN 'disease,scheme' WHEN branch IN ('disease', 'scheme') THEN branch ELSE '' END AS targets FROM i""",
    "greeting_cascade": f"WITH {QUESTIONS} SELECT query_id, {cascade('question')} AS reply_key FROM qs",
    "llm_label_parse": "WITH raw AS (SELECT event_id AS id, " + array([t.replace("\n", "|") for _, t in LABELS]) + f"[event_id % {len(LABELS)} + 1]" + r""" || CASE WHEN event_id % 4 <> 0 THEN '|CONFIDENCE: ' || CAST(CAST(event_id % 13 AS DOUBLE) / 8 AS VARCHAR) || '|Reason:  ' || event_type || ' ' || user_id ELSE '' END AS raw FROM events), l AS (SELECT id, list_transform(string_split(trim(raw, ' |'), '|'), lambda x: trim(x)) AS ls FROM raw),
        v AS (SELECT id, list_transform(list_filter(ls, lambda x: starts_with(upper(x), 'INTENT:')), lambda x: lower(trim(substr(x, 8)))) AS i, list_transform(list_filter(ls, lambda x: starts_with(upper(x), 'CONFIDENCE:')), lambda x: trim(substr(x, 12))) AS c,
          list_transform(list_filter(ls, lambda x: starts_with(upper(x), 'REASON:')), lambda x: trim(substr(x, 8))) AS r FROM l)
        SELECT id, coalesce(list_filter(i, lambda x: x IN ('disease', 'scheme', 'hybrid', 'greeting', 'out_of_scope'))[-1], 'unknown') AS intent, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast(c[-1] AS DOUBLE), 0.5::DOUBLE))) AS confidence, coalesce(r[-1], '') AS reason FROM v""",
    "confidence_gate": "SELECT id, CASE WHEN c < 0.4 AND n = 0 THEN 'ambiguous_query' WHEN n = 0 THEN 'no_documents' ELSE 'answer' END AS outcome FROM (SELECT event_id AS id, value / 200 AS c, event_id % 3 AS n FROM events)",
    "bloom_bits": f"WITH {KEYS} SELECT DISTINCT bit FROM bits",
    "bloom_membership": f"""WITH {KEYS}, ins AS (SELECT DISTINCT bit FROM bits WHERE doc_id % 2 = 0), pr AS (SELECT DISTINCT item, bit FROM bits) SELECT item, count(ins.bit) = count(*) AS maybe FROM pr LEFT JOIN ins USING (bit) GROUP BY item""",
    "bloom_page_membership": f"WITH {KEYS}, ins AS (SELECT DISTINCT bit FROM bits WHERE doc_id % 2 = 0) SELECT doc_id, item, count(ins.bit) = count(*) AS maybe FROM bits LEFT JOIN ins USING (bit) GROUP BY doc_id, item",
    "bloom_add_if_new": f"WITH {NARROW_BITS} SELECT doc_id, doc_id IN (SELECT d FROM new) AS is_new FROM documents",
    "bloom_dedup_stats": f"""WITH {NARROW_BITS}, f AS (SELECT count(DISTINCT bit) / {NARROW[0]} AS r FROM bits), n AS (SELECT count(*) AS taken FROM new), d AS (SELECT count(*) AS offered FROM documents)
        SELECT offered, offered - taken AS refused, {NARROW[0]} AS size_bits, {-(-NARROW[0] // 8)} AS size_bytes, {NARROW[1]} AS hash_count, taken AS elements_added, round(r, 4) AS fill_ratio, round(pow(r, {NARROW[1]}), 6) AS estimated_fp_rate, 0.05::DOUBLE AS target_fp_rate FROM f, n, d""",
    "bloom_stats": f"""WITH {KEYS}, f AS (SELECT count(DISTINCT bit) / {BITS} AS r FROM bits), e AS (SELECT count(DISTINCT item) AS n FROM keys)
        SELECT {BITS} AS size_bits, {-(-BITS // 8)} AS size_bytes, {HASHES} AS hash_count, n AS elements_added, round(r, 4) AS fill_ratio, round(pow(r, {HASHES}), 6) AS estimated_fp_rate, 0.001::DOUBLE AS target_fp_rate FROM f, e""",
    "scalable_bloom_assign": """WITH c AS (SELECT CAST(j AS INT) AS filter, 100 * (pow(2, j) - 1) AS lo, 100 * (pow(2, j + 1) - 1) AS hi FROM range(40) r(j)) SELECT filter, count(*) AS n, min(doc_id) AS first_doc FROM documents JOIN c ON doc_id >= lo AND doc_id < hi GROUP BY filter""",
    "scalable_bloom_membership": f"""WITH keys AS (SELECT doc_id, {DOCKEY} AS item FROM documents), sz(filter, lo, hi, m, k) AS ({rows(GROWN)}),
        arr AS (SELECT item, row_number() OVER (ORDER BY doc_id, item) AS ord FROM keys WHERE doc_id % 2 = 0), inn AS (SELECT filter, item FROM arr JOIN sz ON ord > lo AND ord <= hi), used AS (SELECT DISTINCT filter FROM inn),
        hs AS (SELECT item, filter, k, m, {fold_by('md5(item)', 4, 'm')} AS h1, {fold_by('sha1(item)', 5, 'm')} AS h2 FROM (SELECT DISTINCT item FROM keys), sz SEMI JOIN used USING (filter)),
        b AS (SELECT DISTINCT item, filter, (h1 + unnest(range(k)) * h2) % m AS bit FROM hs), ins AS (SELECT DISTINCT filter, bit FROM b SEMI JOIN inn USING (item, filter)),
        e AS (SELECT item, b.filter, count(ins.bit) = count(*) AS maybe FROM b LEFT JOIN ins USING (filter, bit) GROUP BY item, b.filter) SELECT item, bool_or(maybe) AS maybe FROM e GROUP BY item""",
    "window_chunks": f"WITH {CHUNKS} SELECT doc_id, CAST(i AS INT) AS chunk, CAST(length(content) AS INT) AS n_chars, md5(content) AS content_md5 FROM pieces",
    "chunk_ids": f"WITH {CHUNKS} SELECT chunk_id, collection, chunk_index FROM ci",
    "collection_stats_query": f"WITH {CHUNKS}, n(collection) AS (VALUES ('citrus_diseases'), ('government_schemes'), ('absent')) SELECT n.collection, count(chunk_id) AS n FROM n LEFT JOIN ci USING (collection) GROUP BY ALL",
    "upsert_chunks": f"WITH {CHUNKS} SELECT chunk_id, chunk_index + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS chunk_index, md5(CASE WHEN doc_id % 2 = 0 THEN reverse(content) ELSE content END) AS content_md5 FROM ci",
    "context_builder": f"""WITH {CORPUS}, {ASKED}, {LISTS}, c AS (SELECT query_id, string_agg({BLOCK.format(r="rank")}, E'\\n\\n' ORDER BY rank) AS context FROM rl WHERE collection = 'disease' GROUP BY query_id)
        SELECT query_id, md5(context) AS context_md5, CAST(length(context) AS INT) AS n_chars FROM c""",
    "embed_cache_lru": f"""WITH r AS (SELECT {KEY} AS key, row_number() OVER (ORDER BY conv_id, turn, text) AS ord FROM conversations), p AS (SELECT *, lag(ord) OVER (PARTITION BY key ORDER BY ord) AS prev FROM r),
        d AS (SELECT a.ord, a.prev, count(DISTINCT b.key) AS between FROM p a LEFT JOIN r b ON b.ord > a.prev AND b.ord < a.ord GROUP BY a.ord, a.prev), h AS (SELECT prev IS NOT NULL AND between < {LRU_SIZE} AS hit FROM d)
        SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, least((SELECT count(DISTINCT key) FROM r), {LRU_SIZE}) AS cached, round(count(*) FILTER (hit) / greatest(count(*), 1), 4) AS hit_rate FROM h""",
    "intent_prompts": f"""WITH {QUESTIONS}, i AS (SELECT query_id, {rule("question", intent.DISEASE_WORDS, intent.SCHEME_WORDS)} AS intent FROM qs)
        SELECT query_id, md5(CASE intent WHEN 'hybrid' THEN {lit(SYSTEM_PROMPTS["hybrid"])} WHEN 'disease' THEN {lit(SYSTEM_PROMPTS["disease"])} ELSE {lit(SYSTEM_PROMPTS["scheme"])} END) AS prompt_md5 FROM i""",
    "embed_cache_stats": f"""WITH k AS (SELECT {KEY} AS key FROM conversations), c AS (SELECT count(*) AS t, count(DISTINCT key) AS m FROM k)
        SELECT t - m AS hits, m AS misses, m AS distinct_keys, round((t - m) / greatest(t, 1), 4) AS hit_rate FROM c""",
    "ttl_cache_hits": f"""WITH RECURSIVE m(key, since) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id UNION ALL SELECT key, (SELECT min(ts) FROM events e WHERE e.user_id = m.key AND e.ts >= m.since + INTERVAL {TTL} SECOND) FROM m WHERE since IS NOT NULL),
        x AS (SELECT key, count(since) AS misses FROM m GROUP BY key), n AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id) SELECT key, n - misses AS hits, misses FROM x JOIN n USING (key)""",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "kg_shortest_path": f"""WITH RECURSIVE {NODES}, {EDGES}, w(start, id, cost, path) AS (SELECT id, id, 0.0::DOUBLE, [id] FROM nodes UNION ALL SELECT start, dst, cost + CAST(weight AS DOUBLE), list_append(path, dst) FROM w JOIN edges ON src = w.id WHERE NOT list_contains(path, dst) AND len(path) < 8)
        SELECT start, id, round(min(cost), 6) AS cost FROM w GROUP BY ALL""",
    "answer_all": answer_sql(),
}
ORACLE_SQL["kg_dijkstra"] = ORACLE_SQL["kg_shortest_path"]
ORACLE_SQL["kg_enrich"] = f"""WITH RECURSIVE {NODES}, {EDGES}, {bfs(2, edges="SELECT src, dst, seq FROM edges WHERE relation <> 'treats' OR weight < 0.3")}, x AS (SELECT b.*, s.node_type AS st, t.node_type AS tt, t.name AS tn, s.name AS sn FROM b JOIN nodes s ON s.id = start JOIN nodes t ON t.id = b.id),
      asks AS (SELECT c_custkey AS query_id, ['disease', 'scheme', 'hybrid', 'greeting'][c_custkey % 4 + 1] AS intent, unnest(['n' || c_nationkey, 'n' || (c_nationkey + 1)]) AS start FROM customer),
      ctx AS (SELECT start, CASE tt WHEN 'symptom' THEN 'symptoms' WHEN 'treatment' THEN 'treatments' ELSE 'related_pests' END AS part, id, tn AS name FROM x WHERE tt = 'symptom' AND depth = 1 OR tt IN ('treatment', 'pest')
        UNION ALL SELECT id, 'applicable_schemes', start, sn FROM x WHERE st = 'scheme'),
      e AS (SELECT query_id, part, id, name FROM asks JOIN ctx USING (start) WHERE intent IN ('disease', 'hybrid') UNION SELECT query_id, 'schemes', x.start, sn FROM asks JOIN x ON asks.start = x.id WHERE st = 'scheme' AND intent IN ('scheme', 'hybrid'))
      SELECT query_id, part, count(*) AS n, md5(string_agg(id || '=' || name, ',' ORDER BY id || '=' || name)) AS items_md5 FROM e GROUP BY query_id, part"""
ORACLE_SQL["stream_response_cache"] = ORACLE_SQL["ttl_cache_hits"]
LARGE = rf"""k AS (SELECT 'part' AS category, p_name AS keyword FROM part UNION SELECT * FROM ({rows([("disease", k) for k in DISEASE_KEYWORDS] + [("scheme", k) for k in SCHEME_KEYWORDS])}) t(category, keyword)
        UNION SELECT 'benchmark', array_to_string(w[i : i + 2], ' ') FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark) WHERE len(w) >= 3))"""
ORACLE_SQL["kw_starts_with"] = f"WITH {LARGE} SELECT category, keyword FROM k WHERE starts_with(keyword, 'th')"
ORACLE_SQL["kw_count"] = f"WITH {LARGE} SELECT category, count(DISTINCT keyword) AS n_words FROM k GROUP BY category"
ORACLE_SQL["kw_automaton"] = rf"""WITH {LARGE}, p AS (SELECT category, keyword, regexp_extract_all(lower(keyword), '[\p{{L}}\p{{N}}]+') AS w FROM k), q AS (SELECT category, keyword, len(w) AS n_words, array_to_string(w, ' ') AS pattern FROM p WHERE len(w) > 0),
      d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d), s AS (SELECT DISTINCT n_words FROM q),
      one AS (SELECT doc_id, i, word AS g1, word || ' ' || lead(word) OVER o AS g2, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      g AS (SELECT doc_id, 1 AS n_words, g1 AS pattern FROM one UNION ALL SELECT doc_id, 2, g2 FROM one WHERE g2 IS NOT NULL UNION ALL SELECT doc_id, 3, g3 FROM one WHERE g3 IS NOT NULL)
      SELECT doc_id AS doc, category, keyword, count(*) AS n FROM g JOIN q USING (n_words, pattern) GROUP BY ALL"""
ORACLE_SQL["bm25_topk_blocks"] = ORACLE_SQL["bm25_topk_corpus"]
ORACLE_SQL["answer_stages"] = ORACLE_SQL["answer_all"].rsplit("SELECT query_id, true AS success", 1)[0] + """SELECT * FROM (SELECT 'classify' AS stage, (SELECT count(*) FROM q) AS rows_in, (SELECT count(*) FROM qi) AS rows_out, true AS timed
      UNION ALL SELECT 'retrieve', (SELECT count(*) FROM qi), (SELECT count(*) FROM od), true UNION ALL SELECT 'rank', (SELECT count(*) FROM od), (SELECT count(*) FROM fin), true UNION ALL SELECT 'answer', (SELECT count(*) FROM fin), (SELECT count(*) FROM ou), true)"""
ORACLE_SQL["tfidf_pipeline_topk"] = f"""WITH dw AS (SELECT doc_id AS doc, {tfidf_words("coalesce(text, '')")} AS w FROM documents), dt AS (SELECT doc, unnest({tfidf_terms("w")}) AS term FROM dw),
      tf AS (SELECT doc, term, count(*) AS tf FROM dt GROUP BY ALL), nn AS (SELECT count(*) AS n FROM documents), voc AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
      idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM voc, nn), wt AS (SELECT doc, term, tf * idf AS w FROM tf JOIN idf USING (term)), dn AS (SELECT doc, sqrt(sum(w * w)) AS dn FROM wt GROUP BY doc),
      q0 AS (SELECT item_id AS query_id, {tfidf_words("text")} AS w FROM benchmark), q1 AS (SELECT query_id, unnest({tfidf_terms("w")}) AS term FROM q0), q2 AS (SELECT query_id, term, count(*) AS qtf FROM q1 GROUP BY ALL),
      qw AS (SELECT query_id, term, qtf * idf AS qw FROM q2 JOIN idf USING (term)), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY query_id),
      sc AS (SELECT query_id, doc, round(sum(w * qw) / (any_value(dn) * any_value(qn)), 6) AS score FROM wt JOIN qw USING (term) JOIN dn USING (doc) JOIN qn USING (query_id) GROUP BY query_id, doc)
      SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank FROM sc QUALIFY rank <= 5"""
ORACLE_SQL["bucketed_upsert"] = f"""WITH {CHUNKS} SELECT chunk_id, collection, chunk_index + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS chunk_index, md5(CASE WHEN doc_id % 2 = 0 THEN reverse(content) ELSE content END) AS content_md5 FROM ci WHERE collection = 'citrus_diseases'
      UNION ALL SELECT chunk_id, collection, chunk_index, md5(content) FROM ci WHERE collection = 'government_schemes' AND doc_id % 3 = 0"""


def body_sql(kind: str, text: str) -> str:
    said = f"CAST(to_json(coalesce({text}, '')) AS VARCHAR)"
    return f"""CASE {kind} WHEN 1 THEN '{{"question": ""}}' WHEN 2 THEN '{{"user_id": "u1"}}' WHEN 3 THEN '{{"question": ' || {said} WHEN 4 THEN '{{"question": 17, "session_id": []}}' WHEN 5 THEN '{{"question": null}}'
      WHEN 6 THEN '{{"user_id": 5, "question": ' || {said} || '}}' WHEN 7 THEN '[' || {said} || ']' WHEN 8 THEN '{{"session_id": "s1", "user_id": null, "more": {{"question": 1}}, "question": ' || {said} || '}}'
      ELSE '{{"question": ' || {said} || '}}' END"""


#: From a table b with body: each body's errors as a list of field:problem.
PARSED = """j AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS js FROM b), y AS (SELECT *, json_type(js, '$.question') AS kq, json_type(js, '$.user_id') AS ku, json_type(js, '$.session_id') AS ks FROM j),
    e AS (SELECT *, list_filter(CASE WHEN js IS NULL THEN ['body:json_invalid'] WHEN json_type(js) <> 'OBJECT' THEN ['body:not_an_object'] ELSE [
      CASE WHEN kq IS NULL THEN 'question:missing' WHEN kq <> 'VARCHAR' THEN 'question:not_a_string' WHEN js ->> '$.question' = '' THEN 'question:too_short' END,
      CASE WHEN ku NOT IN ('VARCHAR', 'NULL') THEN 'user_id:not_a_string' END, CASE WHEN ks NOT IN ('VARCHAR', 'NULL') THEN 'session_id:not_a_string' END] END, lambda x: x IS NOT NULL) AS errs FROM y)"""
ORACLE_SQL["request_parse"] = f"""WITH b AS (SELECT conv_id, turn, {body_sql("(conv_id + turn) % 9", "text")} AS body FROM conversations), {PARSED}
    SELECT conv_id, turn, CASE WHEN len(errs) = 0 THEN js ->> '$.question' END AS question, CASE WHEN len(errs) = 0 THEN js ->> '$.user_id' END AS user_id, CASE WHEN len(errs) = 0 THEN js ->> '$.session_id' END AS session_id,
      array_to_string(errs, ',') AS errors FROM e"""
ORACLE_SQL["request_replies"] = f"""WITH b AS (SELECT item_id, {body_sql("item_id % 9", "text")} AS body FROM benchmark), {PARSED}, an AS ({ORACLE_SQL["answer_all"]})
    SELECT item_id AS query_id, CASE WHEN len(errs) > 0 THEN 422 ELSE 200 END AS status, CASE WHEN len(errs) = 0 THEN an.intent END AS intent, string_split(errs[1], ':')[1] AS field, string_split(errs[1], ':')[2] AS problem,
      CASE WHEN len(errs) = 0 THEN answer_md5 END AS answer_md5 FROM e LEFT JOIN an ON an.query_id = item_id"""
#: Greedy choice one at a time, each from the candidates that are left.
ORACLE_SQL["mmr"] = f"""WITH RECURSIVE {VEC}, q AS (SELECT vec_id AS query_id, v AS qv FROM vec WHERE vec_id % {EACH} = 0), d AS (SELECT query_id, qv, vec_id, v, round({l2("qv", "v")}, 6) AS distance FROM vec, q),
    c AS (SELECT *, round({cos("qv", "v")}, 12) AS near, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS nth FROM d QUALIFY nth <= 20),
    s AS (SELECT a.query_id, a.nth AS a, b.nth AS b, {cos("a.v", "b.v")} AS alike FROM c a JOIN c b USING (query_id)),
    m(query_id, n, chosen) AS (SELECT query_id, 1, [(array_agg(nth ORDER BY near DESC, nth))[1]] FROM c GROUP BY query_id
      UNION ALL SELECT query_id, n + 1, list_append(chosen, (array_agg(nth ORDER BY gain DESC, nth))[1]) FROM (
        SELECT m.query_id, n, chosen, c.nth, round(0.5 * any_value(c.near) - 0.5 * max(alike), 12) AS gain FROM m JOIN c ON c.query_id = m.query_id AND NOT list_contains(chosen, c.nth)
          JOIN s ON s.query_id = m.query_id AND s.a = c.nth AND list_contains(chosen, s.b) WHERE n < 5 GROUP BY m.query_id, n, chosen, c.nth) GROUP BY query_id, n, chosen),
    last AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1), u AS (SELECT query_id, unnest(chosen) AS nth, unnest(range(1, len(chosen) + 1)) AS rank FROM last)
    SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM u JOIN c USING (query_id, nth)"""


def split_parts(src: str, size: int) -> str:
    """The rows of ``src`` (doc_id, path, text, lo) cut at the coarsest of the separators from ``lo`` on that they have: s, i, part, g (long parts up to here)."""
    marks = {1: "E'\\n\\n'", 2: "E'\\n'", 3: "'. '", 4: "' '"}
    which = " ".join(f"WHEN lo <= {n} AND contains(text, {m}) THEN {n}" for n, m in marks.items())
    mark = "CASE s " + " ".join(f"WHEN {n} THEN {m}" for n, m in marks.items()) + " END"
    return f"""(SELECT *, sum(CASE WHEN length(part) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path ORDER BY i) AS g FROM (SELECT doc_id, path, s, unnest(ps) AS part, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT doc_id, path, s, CASE WHEN s = 5 THEN list_transform(range(1, length(text) + 1), lambda x: substr(text, x, 1)) ELSE list_filter(list_transform(string_split(text, {mark}), lambda x, j: CASE WHEN j = 1 THEN x ELSE {mark} || x END), lambda x: x <> '') END AS ps
      FROM (SELECT *, CASE {which} ELSE 5 END AS s FROM {src}))))"""


def recursive_chunks_sql(size: int = 1500, overlap: int = 300) -> str:
    """Texts cut until every part is short; then runs of short parts gathered, each chunk (f up to before n) following from the one before by sums of lengths alone."""
    return f"""WITH RECURSIVE sp(doc_id, path, text, lo) AS (SELECT doc_id, CAST([] AS BIGINT[]), text, 1 FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, list_append(path, CAST(2 * g - 1 AS BIGINT)), part, s + 1 FROM {split_parts("sp", size)} WHERE length(part) >= {size} AND s < 5),
    gr AS (SELECT doc_id, list_append(path, CAST(2 * g AS BIGINT)) AS gp, list(part ORDER BY i) AS ps FROM {split_parts("sp", size)} WHERE length(part) < {size} OR s = 5 GROUP BY doc_id, path, g),
    cu AS (SELECT *, len(ps) AS k, list_prepend(0, list_transform(range(1, len(ps) + 1), lambda x: length(array_to_string(ps[1:x], '')))) AS a FROM gr),
    ch(doc_id, gp, f, n, k, a) AS (SELECT doc_id, gp, 0::BIGINT, coalesce(list_filter(range(1, k), lambda m: a[m + 2] > {size})[1], k), k, a FROM cu
      UNION ALL SELECT doc_id, gp, f2, coalesce(list_filter(range(n + 1, k), lambda m: a[m + 2] - a[f2 + 1] > {size})[1], k), k, a
        FROM (SELECT *, list_filter(range(f, n + 1), lambda x: x = n OR (a[n + 1] - a[x + 1] <= {overlap} AND a[n + 2] - a[x + 1] <= {size}))[1] AS f2 FROM ch WHERE n < k)),
    tx AS (SELECT ch.doc_id, ch.gp, n, {strip("array_to_string(ps[f + 1:n], '')")} AS content FROM ch JOIN gr ON gr.doc_id = ch.doc_id AND gr.gp = ch.gp)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY gp, n) - 1 AS INT) AS chunk, CAST(length(content) AS INT) AS n_chars, md5(content) AS content_md5 FROM tx WHERE content <> ''"""


ORACLE_SQL["recursive_chunks"] = recursive_chunks_sql()

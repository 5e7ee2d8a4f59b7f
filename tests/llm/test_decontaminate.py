import hashlib
import re

from quern.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = split(text)
        for i in range(max(len(ws) - 9, 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + 10]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, who = split(text), set(), set()
        for k in lengths:
            for i in range(len(ws) - k + 1):
                if (found := windows.get(tuple(ws[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    who |= found
        out.append((str(doc), len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows_of(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def test_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(dc.contamination(docs, items)) == want
    assert sum(x[-1] for x in want)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, ITEM"), (3, ""), (4, None), (5, "é"), (2, "short item"), (6, "a a a")]
DOCS = [
    (1, None), (2, ""), (3, "x one TWO three-four five six seven eight nine ten eleven y"), (4, "short item short item"), (4, "short item short item"),
    (None, "é a a a a"), (7, "one two three four five six seven eight nine"), (8, "w " * 40_000 + "short. item"), (9, "short"), (10, "item"),
]


def test_edges_and_joined_form(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    assert rows_of(dc.contamination(docs(DOCS), items)) == want
    unique = [x for n, x in enumerate(DOCS) if x not in DOCS[:n]]
    assert rows_of(dc.contamination(docs(unique), items, most=2)) == brute(unique, ITEMS)
    assert rows_of(dc.contamination(docs(DOCS), items.limit(0))) == brute(DOCS, [])
    assert rows_of(dc.contamination(docs([]), items)) == []


def test_stage_leaves_no_window(spark, docs):
    nested = "one two three four five " + ITEMS[0][1].replace(" eleven", "") + " six seven eight nine ten. Clean words stay"
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminated(docs([(1, nested), (2, "clean text"), (3, "short item"), (4, None)]), items).collect()}
    assert set(got) == {1, 2, 4} and got[2].text == "clean text" and got[4].text is None
    assert split(got[1].text) == ["clean", "words", "stay"] and got[1].n_chars == len(got[1].text)


def test_stage_without_broadcast(spark, docs):
    first = ITEMS[0][1].replace(" eleven", "")
    nested = f"one two three four five {first} six seven eight nine ten. Clean words stay"
    rows = [(1, nested), (1, nested), (2, "clean text"), (3, "short item"), (4, None), (None, f"Ä {first} ö short. item"), (5, ""), (6, "--"), (7, "short a a a item b")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    of = lambda most: sorted((tuple(r) for r in dc.decontaminated(docs(rows).withColumn("text_key", dc.F.lit("own")), items, most=most).collect()), key=repr)
    assert of(2) == of(dc.MAX_BROADCAST_WINDOWS) and len(of(2)) == 8
    table, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, dc.decontaminated(table, bench, most=m).collect()), key=repr) for m in (2, dc.MAX_BROADCAST_WINDOWS))
    assert a == b and a != sorted(map(tuple, table.collect()), key=repr)


def test_items_without_an_id(spark, docs):
    items = spark.createDataFrame([(None, "short item"), (7, "short item"), (None, "other words")], "item_id long, text string")
    a, b = (rows_of(dc.contamination(docs([(1, "a short item"), (2, "b other words"), (3, "c")]), items, most=m)) for m in (dc.MAX_BROADCAST_WINDOWS, 1))
    assert a == b and [x[2:4] for x in a] == [(2, 1), (2, 0), (0, 0)]

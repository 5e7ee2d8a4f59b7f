import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import quality as q


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return q.quality(docs, labels).join(labels, "doc_id", "left").collect()


def test_held_out_accuracy(scored):
    held = [r for r in scored if r.held_out and r.quality is not None]
    assert len(held) > 500
    for label in (0, 1):
        right = [r.predicted == label for r in held if r.quality == label]
        assert sum(right) >= 0.95 * len(right), label
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in scored)


def test_scores_are_sparse_dot_products():
    weights = np.random.default_rng(0).normal(size=q.BUCKETS + 3)
    texts = ["The the THE ### the", "", None, "a" * 50_000, "x x x"]
    want = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        seen, _ = q.features(data, np.array([0, len(data)]))
        want.append(1 / (1 + np.exp(-(sum(weights[i] for i in seen.tolist()) / max(len(seen), 1) ** 0.5 + weights[q._INTERCEPT]))))
    assert np.allclose(q.scores(weights, pa.array(texts, pa.string())), want, atol=1e-6)


def test_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, "good words here " * 3 if i % 2 else "bad### bad!!") for i in range(40)] + [(None, "good"), (99, None), (98, ""), (98, ""), (97, "bad### " * 20_000)]
    got = q.quality(docs(rows), labels).collect()
    assert len(got) == len(rows) and {r.score for r in got if r.doc_id in (98, 99)} and not [r for r in got if r.doc_id is None and r.held_out]
    by = {r.doc_id: r.score for r in got}
    assert by[5] > by[4]
    assert {r.score for r in q.quality(docs(rows), labels.limit(0)).collect()} == {0.5}
    assert q.quality(docs([]), labels).collect() == []


def test_stage_keeps_rows_whole(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, "good words here " * 5 if i % 2 else "bad### bad!! " * 5) for i in range(60)]
    got = q.accepted(docs(rows), labels, docs(rows)).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(i, t, len(t)) for i, t in rows if i % 2]


def brute(docs, labels):
    """The whole query in plain Python: features by regular expressions, updates with dictionaries, scores by a sum over occurrences."""
    import math
    import re

    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \x09-\x0d]+")

    def seen(text):
        found = [m[0] for m in token.finditer((text or "").encode())]
        out = list(found) + [a + b"\0" + b for a, b in zip(found, found[1:])]
        out += ["caps" for w in found if sum(65 <= c < 91 for c in w) >= 2 and not any(97 <= c < 123 for c in w)]
        return out + ["repeat" for a, b in zip(found, found[1:]) if a == b]

    z, n = {}, {}

    def weight(f):
        a = z.get(f, 0.0)
        shrunk = math.copysign(max(abs(a) - (0 if f == "bias" else q.L1), 0), a)
        return -shrunk / ((q.BETA + math.sqrt(n.get(f, 0.0))) / q.ALPHA + q.L2)

    def dot(fs):
        return sum(map(weight, fs)) / math.sqrt(max(len(fs), 1)) + weight("bias")

    texts = dict(docs)
    for _ in range(q.EPOCHS):
        for i, label in labels:
            fs = seen(texts[i])
            gap = 1 / (1 + math.exp(-dot(fs))) - label
            x = {f: fs.count(f) / math.sqrt(max(len(fs), 1)) for f in set(fs)} | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            for f, v in x.items():
                g, old = gap * v, n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / q.ALPHA * w[f]
                n[f] = old + g * g
    return {i: 1 / (1 + math.exp(-dot(seen(t)))) for i, t in docs}


def test_whole_query_against_brute_force(spark, docs):
    rng = np.random.default_rng(11)  # no two of its features share a bucket
    good, bad = "the quiet river runs past fields and old stone".split(), "BUY now!!! ### free free ### CLICK here $$".split()
    rows = [(i, " ".join(rng.choice(good + bad[: 3 * (i % 3)] if i % 2 else bad + good[:4], 12))) for i in range(60)] + [(99, None), (98, "")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    order = [(r.doc_id, r.quality) for r in labels.selectExpr("*", "xxhash64(doc_id) h").orderBy("h").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    want = brute(rows, order)
    got = {r.doc_id: r.score for r in q.quality(docs(rows), labels).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-5
    assert len(set(got.values())) > 40


def test_copies_train_once(spark, docs):
    """A thousand rows of one labelled id are one training row."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    once = [(1, "good words"), (2, "bad### bad!!"), (3, "more good words"), (4, "bad!!")]
    a, b = (q.fitted(docs(rows), labels) for rows in (once, once + [(1, "good words")] * 1000))
    assert (a == b).all() and a.any()

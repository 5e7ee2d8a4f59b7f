"""The keyword automaton against plain searches."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import automaton as am

DOCS, WORDS = "doc long, content string", "category string, keyword string"


@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda x: bytes(b % 3 + 1 for b in x)), min_size=1, max_size=12, unique=True), st.binary(max_size=300).map(lambda x: bytes(b % 3 + 1 for b in x)))
@settings(max_examples=300, deadline=None)
def test_every_occurrence(patterns, text):
    am.STRETCH, before = 7, am.STRETCH
    try:
        end, which = am.Automaton.of(patterns).hits(np.frombuffer(text, np.uint8))
    finally:
        am.STRETCH = before
    want = sorted((i + len(p) - 1, n) for n, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(end.tolist(), which.tolist())) == want


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def brute(docs, keywords, whole=True):
    out = []
    for doc, text in docs:
        t = f" {plain(text)} "
        for category, keyword in set(keywords):
            k = plain(keyword)
            if k:
                p = f" {k} " if whole else f" {k}"
                n = sum(t.startswith(p, i) for i in range(len(t)))
                out += [(doc, category, keyword, n)] if n else []
    return sorted(out)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("most", [am.MAX_BYTES, 3000])
def test_phrases_prefixes_and_parts(spark, whole, most):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "b", "ba", "éà", "Ünd", "x1", "m-n", "z."]
    docs = [(i % 25, " ".join(rng.choices(words, k=rng.randrange(30))) or None) for i in range(40)] + [(77, ""), (78, None), (79, "a  A\ta")]
    keywords = [(rng.choice("pq"), " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for _ in range(60)] + [("p", "A"), ("q", "a"), ("p", "a"), ("p", "--"), ("p", ""), ("p", "m n")]
    got = am.dictionary_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(keywords * 2, WORDS), whole, most)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, keywords, whole)


def test_nulls_and_empty_dictionaries(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1)], "doc long, content string, category string, n int")
    assert am.dictionary_hits(docs, spark.createDataFrame([(None, "b"), ("c", None)], WORDS)).collect() == [(1, None, "b", 1)]
    assert am.dictionary_hits(docs, spark.createDataFrame([], WORDS)).count() == 0
    assert am.dictionary_hits(docs.limit(0), spark.createDataFrame([("c", "a")], WORDS)).count() == 0


def test_a_long_text_and_many_keywords(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    keywords = [("k", " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for _ in range(100_000)]
    text = rng.choices(words, k=250_000)
    held = {tuple(k.split()) for _, k in keywords}
    want = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            t = tuple(text[i : i + n])
            if t in held:
                want[" ".join(t)] = want.get(" ".join(t), 0) + 1
    got = am.dictionary_hits(spark.createDataFrame([(1, " ".join(text))], DOCS), spark.createDataFrame(keywords, WORDS))
    assert {r.keyword: r.n for r in got.collect()} == want


def test_arrays_are_within_what_the_caller_reckons_with():
    rng = random.Random(2)
    patterns = list({f" {rng.random()} ".encode() for _ in range(2000)})
    made = am.Automaton.of(patterns)
    assert made.nbytes <= am.NODE_BYTES * sum(map(len, patterns)) + 1024 * am.DENSE

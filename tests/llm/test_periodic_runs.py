"""Runs of words against brute force."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.periodic_runs import factors, periodic_runs, planted, run_digest, runs_of, without_runs, word_runs
from quern.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def brute(w, least=6, exponent=4):
    """Every stretch that keeps a period and cannot grow, with its smallest period."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            a = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - a + q >= max(least, exponent * q):
                found.setdefault((a - q, i), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 4))
@settings(max_examples=400, deadline=None)
def test_runs_of_short_words(w, exponent):
    assert runs_of(w, 2, exponent) == brute(w, 2, exponent)


@given(st.lists(st.integers(0, 1), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.integers(0, 1), max_size=9), st.integers(1, 4))
@settings(max_examples=400, deadline=None)
def test_runs_of_powers(part, times, rest, again):
    w = (part * times + rest) * again
    assert runs_of(w, 2, 2) == brute(w, 2, 2)
    assert runs_of(w) == brute(w)


@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=80))
@settings(max_examples=200, deadline=None)
def test_cutting_at_rare_words_loses_nothing(words):
    assert word_runs(words) == sorted(brute(words), key=lambda r: (r[0], r[2]))


def test_factors_start_earlier():
    w = [0, 1, 0, 1, 0, 1, 1, 0, 0, 1]
    assert factors(w) == [(0, 1, -1), (1, 1, -1), (2, 4, 0), (6, 2, 1), (8, 2, 0)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(doc_id, text):
    words = WORD.findall(text or "")
    words = [w.decode() for w in planted(doc_id, [w.encode() for w in words])]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(table)
    assert sum(r.n_runs for r in got.values()) > 10
    for row in table:
        r = got[row.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(row.doc_id, row.text)


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a b " * 9), (1, "a b " * 9), (None, "x " * 7 + "y y z"), (3, None), (4, ""), (5, " \t\x0b "), (None, None), (7, "x x x x x")]
    frame = spark.createDataFrame([(i, t, 1, 2, "p") for i, t in rows], "doc_id long, text string, start int, length int, words string")
    got = sorted(run_digest(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id, -r.n_words))
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.n_dropped) for r in got] == [
        (1, 1, 0, 18, 2, 9000, 16), (1, 1, 0, 18, 2, 9000, 16), (3, 0, None, None, None, None, 0), (4, 0, None, None, None, None, 0), (5, 0, None, None, None, None, 0), (7, 0, None, None, None, None, 0),
        (None, 1, 0, 7, 1, 7000, 6), (None, 0, None, None, None, None, 0),
    ]
    assert sorted((r.doc_id, r.text) for r in without_runs(frame).where("doc_id is not null").collect()) == [(1, "a b"), (1, "a b"), (3, ""), (4, ""), (5, ""), (7, "x x x x x")]
    assert {r.text for r in without_runs(frame).where("doc_id is null").collect()} == {"", "x y y z"}
    assert [tuple(r) for r in periodic_runs(frame).where("doc_id = 1").collect()] == [(1, 0, 18, 2)] * 2
    assert run_digest(frame.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(5)
    free = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    words = free + free[-997:] * 5 + ["end"] + ["z"] * 1000
    frame = spark.createDataFrame([(1, " ".join(words), "en", "s", 1)], DOCS)
    assert frame.first().text.__len__() > 1 << 20
    assert [tuple(r)[1:] for r in periodic_runs(frame).collect()] == [(149_003, 997 * 6, 997), (154_986, 1000, 1)]


def test_exponent_below_two_is_refused(spark, docs):
    with pytest.raises(ValueError):
        periodic_runs(docs([(1, "a")]), exponent=1)

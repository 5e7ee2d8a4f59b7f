import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import suffix_blocks as sb
from quern.llm import suffix_dedup as sd


def brute(rows):
    """By a dictionary of all 100-byte strings, over distinct (doc_id, text) in order of doc_id."""
    seen, out = set(), []
    for key, t in sorted({(float("inf") if i is None else i, t or "") for i, t in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        row = (str(None if key == float("inf") else key), len(b), sum(gone), n, hashlib.sha256(kept).hexdigest())
        out += [row] * sum((float("inf") if i is None else i, x or "") == (key, t) for i, x in rows)
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(sd.suffix_dedup(docs)) == want and sum(w[2] for w in want)


def crafted(seed, n=60):
    """Texts that share passages with edits, periods and copies."""
    rng = random.Random(seed)
    letters = lambda k, a="abcdeé ": "".join(rng.choice(a) for _ in range(k))
    pool = [letters(rng.randint(60, 400)) for _ in range(5)] + ["ab" * 150, "x" * 330, "notice of the licence, to be found everywhere " * 3]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            p = p[a : rng.randint(a, len(p))]
            if p and rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + "!" + p[k + 1 :]
            t += p + letters(rng.randint(0, 30))
        rows.append((i, t))
    return rows


def test_crafted_with_and_without_large_buckets(spark, docs, monkeypatch):
    for seed in (1, 2):
        rows = crafted(seed)
        random.Random(seed).shuffle(rows)
        want = brute(rows)
        for most in (sd.MAX_BUCKET, 2):
            assert got(sd.suffix_dedup(docs(rows).repartition(5), most)) == want, (seed, most)


def test_edges(docs):
    long = " ".join(f"word{i * i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (4, "short"), (4, "short"), (9, long), (9, long), (2, long[1000:1300]), (7, "y" * 99), (8, "y" * 100), (1, "y" * 101), (None, "y" * 200), (6, long[:150]), (6, long[100:250]), (6, "é" * 80)]
    frame = docs(rows).withColumns({c: F.lit("x") for c in ("doc", "alt", "at", "n", "gone", "packed")})
    assert got(sd.suffix_dedup(frame)) == brute(rows)
    assert got(sd.suffix_dedup(docs([]))) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(["a", "ab", "ab\0", "abcdefgh"]), st.integers(8, 130))
def test_blocks_against_brute_force(seed, alphabet, width):
    rng = random.Random(seed)
    pool = "".join(rng.choice(alphabet) for _ in range(300))
    contexts = []
    for _ in range(rng.randint(1, 25)):
        a = rng.randrange(150)
        c = pool[a : a + width + rng.randint(0, 30)]
        contexts.append((c + "z" * width)[: max(len(c), width)].encode())
    buckets = sorted(rng.randrange(3) for _ in contexts)
    bounds = np.cumsum([0, *map(len, contexts)])
    seen, want = set(), []
    for b, c in zip(buckets, contexts):
        for p in range(len(c) - width + 1):
            want.append((b, c[p : p + width]) in seen)
            seen.add((b, c[p : p + width]))
    assert sb.repeated_windows(np.frombuffer(b"".join(contexts), np.uint8), bounds, np.array(buckets), width).tolist() == want


def test_suffixes_come_out_sorted():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.tile(rng.integers(97, 99, 70, dtype=np.uint8), 6), rng.integers(97, 100, 400, dtype=np.uint8), np.full(300, 97, np.uint8)])
    starts = np.arange(len(text) - 128)
    order, _ = sb.sort_suffixes(text, starts, np.zeros(len(starts), np.int64), 128)
    heads = [text[p : p + 128].tobytes() for p in starts[order]]
    assert heads == sorted(heads)


def test_cover_has_every_difference():
    assert {(a - b) % sb.PERIOD for a in sb.COVER for b in sb.COVER} == set(range(sb.PERIOD))


def test_long_texts_by_parts(spark, docs, monkeypatch):
    """Parts of 1000 bytes: spans that a part ends, and equal ones that none does, give the same result."""
    monkeypatch.setattr(sd, "PIECE_BYTES", 1000)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef ") for _ in range(7000))
    rows = [(1, base), (2, "x" + base[500:4200] + "y" * 1300), (3, base[:50]), (4, base[3000:] + base[:3000]), (5, "short")]
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t) for _, t in rows)])
    whole, parts = sd.spans_of(data, bounds), sd.spans_by_parts(data, bounds)
    windows = lambda f: sorted((d, p) for d, a, n in zip(f[2].tolist(), f[3].tolist(), f[4].tolist()) for p in range(a, a + n))
    assert windows(parts) == windows(whole) and len(parts[0]) > len(whole[0])
    assert got(sd.suffix_dedup(docs(rows))) == brute(rows)


def test_claims_are_compared_with_bytes():
    data = np.frombuffer(b"a" * 120 + b"b" * 120, np.uint8)
    assert sd.differing(data, np.array([0, 121]), np.array([5, 125]), np.array([101, 99])).tolist() == [False, False]
    assert sd.differing(data, np.array([0, 15]), np.array([10, 20]), np.array([101, 105])).tolist() == [False, True]
    assert list(sd.claims_of(bytes(range(200)) * 4, [(300, 120, 7, 1, 500), (400, 100, 7, 1, 600)])) == [(7, 1, 500, (bytes(range(200)) * 4)[300:312]), (7, 1, 512, (bytes(range(200)) * 4)[312:500])]
    text = bytes(range(97, 123)) * 10
    import pyarrow as pa
    import zstandard

    batch = pa.RecordBatch.from_pydict({"doc": [1, 1], "alt": [0, 0], "at": pa.array([0, 5], pa.int32()), "bytes": [text[:50], text[:50]], "packed": [zstandard.ZstdCompressor().compress(text)] * 2})
    assert [b.to_pydict() for b in sd._false_claims([batch])] == [{"doc": [1], "alt": [0], "at": [5], "n": [50]}]


def test_spans_of_one_hash_that_differ(spark, docs):
    """With two bits of each span's hash most claims are false, within tasks and between them; the rows are the same."""
    for seed in (3, 4):
        rows = crafted(seed)
        rows += [(i + 500, t) for i, t in rows[:9]] + [(None, rows[5][1] + "tail"), (3, rows[7][1])]
        random.Random(seed).shuffle(rows)
        want = brute(rows)
        for most, parts in ((sd.MAX_BUCKET, 1), (2, 6)):
            assert got(sd.suffix_dedup(docs(rows).repartition(parts), most, 2)) == want, (seed, most)

"""Repeated windows of words against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import window_dedup as wd
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    """rows of (doc_id, text) -> sorted (doc_id, n_words, kept words)."""
    starts = defaultdict(lambda: wd.LAST_ID)
    split = [(wd.LAST_ID if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for a in range(len(words) - width + 1):
            key = tuple(words[a : a + width])
            starts[key] = min(i, starts[key])
    out = []
    for i, words in split:
        gone = {b for a in range(len(words) - width + 1) if starts[tuple(words[a : a + width])] < i for b in range(a, a + width)}
        out.append((i, len(words), " ".join(w for b, w in enumerate(words) if b not in gone)))
    return sorted(out)


def digests(found):
    return sorted((i, n, n - len(kept.split(" ") if kept else []), hashlib.sha256(kept.encode()).hexdigest()) for i, n, kept in found)


def got(frame):
    return sorted((wd.LAST_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = digests(brute(rows))
    assert sum(r[2] > 0 for r in want) > 50
    assert got(QUERIES["op11_window_dedup"](spark, SF)) == want


@pytest.mark.parametrize(("width", "gram", "letters"), [(13, 4, "ab"), (13, 4, "abcdefgh"), (5, 1, "abc"), (20, 3, "ab"), (3, 3, "abc"), (1, 1, "abcd")])
def test_few_letters(spark, docs, monkeypatch, width, gram, letters):
    rng = random.Random(width * gram)
    parts = ["".join(rng.choices(letters, k=40)) for _ in range(6)]
    rows = []
    for i in range(80):
        text = "".join(p[rng.randrange(20) :][: rng.randrange(40)] if rng.random() < 0.7 else "".join(rng.choices(letters, k=15)) for p in rng.choices(parts, k=rng.randrange(4)))
        rows.append((rng.choice([None, *range(60)]), " ".join(text) if text else rng.choice([None, "", " \t"])))
    rows += rows[:9]
    assert sorted((wd.LAST_ID if r.doc_id is None else r.doc_id, r.text) for r in wd.without_repeats(docs(rows), width, gram).collect()) == sorted((i, kept) for i, _, kept in brute(rows, width))


def test_clashing_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(2, "a b c d e f g h i j k l m n", 1, "x"), (1, "a b c d e f g h i j k l m", 2, "y")], "doc_id int, text string, piece int, packed string")
    assert got(wd.window_dedup(frame)) == digests([(1, 13, "a b c d e f g h i j k l m"), (2, 14, "n")])
    assert wd.window_dedup(frame.limit(0)).count() == 0
    assert wd.window_dedup(frame.where("doc_id = 2")).first().n_removed == 0


def test_long_text_and_a_passage_in_every_document(spark, docs, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    long = [f"w{rng.randrange(10**5)}" for _ in range(200_000)]
    rows = [(1, " ".join(long))] + [(i, " ".join([f"q{rng.random()}"] * 3 + passage + long[i * 50 : i * 50 + 30])) for i in range(2, 300)]
    assert len(rows[0][1]) > 1 << 20
    assert got(wd.window_dedup(docs(rows))) == digests(brute(rows))


def run_rounds(texts, pieces=3):
    """All rounds on this machine, piece by piece."""
    cut = np.array_split(np.arange(len(texts)), pieces)
    made = []
    for part in cut:
        raw = [texts[i].encode() for i in part]
        made.append(wd.Piece(part, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 13, 4, 5, 40))
    asked = []
    for _ in range(len(wd.lengths_of(13, 4)) + 2):
        rows = []
        for n, piece in enumerate(made):
            piece.begin()
            rows += piece.parts(n).to_pylist()
        asked.append(sum(r["n"] for r in rows))
        for number in range(5):
            some = [r for r in rows if r["range"] == number]
            for n, bits in wd.answers(some, number, 40, made[0].full) if some else ():
                made[n].__dict__.setdefault("said", {})[number] = bits
        for piece in made:
            piece.end(piece.__dict__.pop("said", {}))
    return made, asked


def test_only_what_repeats_is_extended():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = [" ".join(word() for _ in range(900)) for _ in range(9)]
    texts[7] = " ".join(texts[7].split()[:100] + texts[2].split()[300:350] + texts[7].split()[150:])
    made, asked = run_rounds(texts)
    assert asked[0] > 1000 and all(n <= 2 * 38 for n in asked[1:])  # two documents have each of the passage's 38 windows
    assert [int((np.cumsum(p.gone[:-1]) > 0).sum()) for p in made] == [0, 0, 50]


def test_packed_numbers_come_back():
    values = np.array([0, 5, 2**63, 2**64 - 1], np.uint64)
    assert (wd.unpacked(wd.packed(values), np.uint64) == values).all()
    assert (wd.unpacked(wd.packed(values.view(np.int64)), np.int64) == values.view(np.int64)).all()
    assert pa.array(wd.unpacked(wd.packed(np.zeros(0, np.uint64)), np.uint64)).to_pylist() == []

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bb.parse_ranks(bb.read_ranks(PATH))
VOCAB = bb.Vocabulary(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def want(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha(LIBRARY.decode_bytes(ids))


def check(frame, rows):
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame.collect()) == sorted((str(i), *want(t)) for i, t in rows)


def test_against_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(bb.encode(docs, PATH, public_tokenizers.PATTERN), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "aaaaaaa" * 99 + " "), (3, " \n\n  x"), (None, "it's 12345 ½²Ⅷ 日本語 <|endoftext|>"), (4, "\x1c\x1d\x85\xa0 　z"), (5, "ab" * 100_000), (5, "ab")]
    check(bb.encode(docs(rows), PATH, public_tokenizers.PATTERN), rows)
    check(bb.encode(docs([]), PATH, public_tokenizers.PATTERN), [])


def test_ids_decode(docs):
    rows = [(1, "Größe, niño; 12"), (2, ""), (3, "the the")]
    out = bb.decode(bb.encode(docs(rows), PATH, public_tokenizers.PATTERN, ids=True), PATH).collect()
    assert {r.doc_id: (r.ids, bytes(r.bytes).decode()) for r in out} == {i: (LIBRARY.encode_ordinary(t), t) for i, t in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=40), min_size=1, max_size=8))
def test_replay_is_lowest_rank_first(words):
    words = [w.encode() for w in words]
    ids, first = bb.replay(words, VOCAB)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [bb.lowest_first(w, RANKS) for w in words]


@pytest.mark.parametrize("words", [[b"abab", b"ababab", b"aba"], [b"aaaa", b"a", b"aaaaa"]])
def test_replay_where_a_merge_makes_a_lower_rank(words):
    ranks = {bytes([i]): i for i in range(256)} | {b"aba": 256, b"ab": 257, b"abab": 258, b"aaa": 259, b"aa": 260}
    ids, first = bb.replay(words, bb.Vocabulary(ranks))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [bb.lowest_first(w, ranks) for w in words]


def test_a_text_over_a_block(monkeypatch):
    monkeypatch.setattr(bb, "BLOCK_BYTES", 10)
    coder = bb.Encoder(RANKS, public_tokenizers.PATTERN)
    text = "it's a long text, of 12345 words; é and so on"
    (places,), decimal, raw = coder.encode([text])
    assert b",".join(decimal[places]) == ",".join(map(str, LIBRARY.encode_ordinary(text))).encode() and b"".join(raw[places]) == text.encode()

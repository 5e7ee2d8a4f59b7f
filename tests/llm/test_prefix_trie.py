"""Prefix tries against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import prefix_trie as pt
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, graft=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(found)] for c, found in convs.items()}
    members, sequence = defaultdict(list), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        sequence[c] = convs.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(sequence[c]) + 1):
            members[tuple(sequence[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    out = []
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(sequence[c]) == len(node))))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(frame):
    assert frame.columns == pt.OUT
    return sorted(tuple(r) for r in frame.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, SF)) == brute(rows)


def made(seed, n=160, roles=("user", "assistant", None), texts=("", "a", "bb", "é☃", None)):
    """Conversations with a hot first turn, many copies, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([None, *range(0, 320, 1), -101, -100, -7, 10**12])
        turns = [(t, rng.choice(roles), rng.choice(texts)) for t in [0, *rng.choices([None, 0, 1, 2, 5], k=rng.randrange(7))]]
        if rng.random() < 0.5:
            turns = [(0, "user", "hello"), (1, "assistant", "hi"), (2, "user", "bye")]
        rows += [(c, *t) for t in turns]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, pt.LIMIT), (2, 40), (3, 7), (4, 0), (5, 15)])
def test_light_and_heavy_nodes(spark, monkeypatch, seed, limit):
    rows = made(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", p1 string, depth int")
    assert got(pt.prefix_trie(pt.grafted(frame), limit)) == brute(rows)
    if seed < 3:
        assert got(pt.prefix_trie(pt.sequences(frame), limit)) == brute(rows, graft=False)


def test_long_conversations_texts_and_end_lists(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(700)] + [(c, 0, "user", "x" * (1 << 20)) for c in range(200, 206)]
    rows += [(c, 0, "user", "same") for c in range(1000, 6000)]
    assert got(pt.prefix_trie(pt.sequences(spark.createDataFrame(rows, SCHEMA)), 500)) == brute(rows, graft=False)


def test_blocks_hold_whole_shards(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    convs = np.sort(rng.choice(1000, 40, replace=False))
    rows = [{"conv_id": c, "total": 2, "depth": d, "size": 1, "h1": int(c) % (3 + 4 * d) + 10 * d, "h2": 0, "p1": 0, "p2": 0, "s1": int(c) // 100, "s2": 0} for c in convs for d in (1, 2)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist(rows)
    whole = pt._trie({c: batch.column(c).to_numpy() for c in batch.schema.names}).to_pylist()
    cut = [r for part in pt._shards([batch.slice(i, 3) for i in range(0, batch.num_rows, 3)]) for r in part.to_pylist()]
    key = lambda r: (r["conv_id"], r["depth"])
    assert sorted(cut, key=key) == sorted(whole, key=key)


def test_louds_bits():
    louds = pt.Louds.of_degrees(np.array([1, 2, 0, 1, 0]), np.array([0, 1, 3, 4]))
    assert louds.bits.astype(int).tolist() == [1, 0, 1, 1, 0, 0, 1, 0, 0]
    assert louds.degrees().tolist() == [2, 0, 1, 0]
    assert louds.parents().tolist() == [-1, 0, 0, 2]
    assert louds.rolled_up(np.array([1, 10, 100, 1000])).tolist() == [1111, 10, 1100, 1000]


def test_no_conversations(spark):
    assert got(pt.prefix_trie(pt.grafted(spark.createDataFrame([], SCHEMA)))) == []
    assert got(pt.prefix_trie(pt.grafted(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)))) == []

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import simhash as sh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc_id -> smallest reachable, by all pairs."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    want = brute_components(prints)
    got = sh.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def crafted(n=120, seed=5):
    """Chains and clusters of fingerprints 0 to 4 bits apart."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(8)]
    while len(out) < n:
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 2, 3, 4])):
            x ^= 1 << b
        out.append(x)
    return out


def test_groups_and_keys_find_the_same_components(spark):
    prints = dict(enumerate(crafted()))
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in prints.items()]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    want = brute_components(prints)
    by_print = {}
    for i, p in prints.items():
        by_print.setdefault(p, want[i])
    for most in (sh.MAX_GROUP, 2, 0):
        got = {int(np.int64(r.fp).astype(np.uint64)): r.component_id for r in sh.classes(frame, most).collect()}
        assert got == by_print, most


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 150))
def test_bit_sliced_distances(seed, n):
    prints = np.array(crafted(n, seed), np.uint64)
    planes = sh.bit_planes(prints)
    alive = np.packbits(np.arange(planes.shape[1] * 64) < len(prints), bitorder="little").view(np.uint64)
    near = np.unpackbits(sh.within_radius(planes, int(prints[0]), alive).view(np.uint8), bitorder="little")[: len(prints)]
    assert near.tolist() == [int((int(p) ^ int(prints[0])).bit_count() <= 2) for p in prints]


def test_edges(docs):
    rows = [(5, None), (3, ""), (4, " \n"), (9, "one"), (8, "ONE"), (None, "one"), (7, "a b"), (7, "a b"), (1, "é É " * 3000), (2, "x" * 300_000)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in sh.near_duplicates(docs(rows)).collect())
    want = sorted((str(i), f"{brute_print(t):016x}", {5: 3, 3: 3, 4: 3, 9: 8, 8: 8, None: 8}.get(i, i)) for i, t in rows)
    assert got == want
    assert sh.near_duplicates(docs([])).collect() == []


def test_stage_keeps_one_of_each_group(docs):
    rows = [(5, None), (3, ""), (9, "one"), (8, "ONE"), (7, "a b"), (7, "a b"), (None, "all alone here"), (None, "some other words")]
    assert sorted(str(r.doc_id) for r in sh.deduplicated(docs(rows)).collect()) == ["3", "7", "8", "None", "None"]


def test_a_long_chain_settles(spark):
    """A path of links, one bit apart, through 600 fingerprints: as many rounds as it takes."""
    prints, x, rng = [0], 0, random.Random(9)
    while len(prints) < 600:
        x ^= 1 << rng.randrange(64)
        if x not in prints:
            prints.append(x)
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "doc_id long, fp long")
    for most in (sh.MAX_GROUP, 0):
        assert {r.component_id for r in sh.classes(frame, most).collect()} == {0}


def test_large_group_shares_two_bands(spark):
    """3000 fingerprints that differ in 12 bits alone: one group, cut into subgroups, against all pairs by union of one- and two-bit neighbours."""
    rng = random.Random(3)
    low = rng.sample(range(1 << 24), 3000)
    prints = {i: 0xABCD_0000_0000_0000 | v for i, v in enumerate(low)}
    parent = {p: p for p in prints.values()}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    flips = [1 << a | 1 << b for a in range(24) for b in range(a, 24)]
    for p in list(parent):
        for f in flips:
            if (q := p ^ f) in parent:
                x, y = find(p), find(q)
                parent[max(x, y)] = min(x, y)
    first = {}
    for i, p in prints.items():
        first.setdefault(find(p), i)
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in prints.items()], "doc_id long, fp long")
    for most in (100, sh.MAX_GROUP):
        got = {int(np.int64(r.fp).astype(np.uint64)): r.component_id for r in sh.classes(frame, most).collect()}
        assert got == {p: first[find(p)] for p in prints.values()}


def test_hot_fingerprints_join_alike(docs, monkeypatch):
    rows = [(i, "same words in all of these") for i in range(30)] + [(100 + i, f"other words number {i} stand here") for i in range(20)]
    want = sorted(map(str, sh.near_duplicates(docs(rows)).collect()))
    monkeypatch.setattr("quern.llm.common.HOT_LEAST", 5)
    assert sorted(map(str, sh.near_duplicates(docs(rows)).collect())) == want


def test_long_texts_in_parts(monkeypatch):
    texts = [("one two three four five six seven " * 300).strip() + " end", "x" * 500, "a b", " ".join("abc"[i % 3] * (i % 50 + 1) for i in range(400)), " \n" * 90 + "a" + "\t " * 90 + "b c", ""]
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(sh, "PART_BYTES", size)
        assert [sh.fingerprint_of(t.encode()) for t in texts] == [brute_print(t) for t in texts], size

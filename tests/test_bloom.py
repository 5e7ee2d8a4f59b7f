"""Bit pages, sequential adding and large filters, against a filter of Python sets."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import bloom, graph


def bits_of(item, m, k):
    h = lambda f: int(f(item.encode()).hexdigest(), 16)
    return {(h(hashlib.md5) + i * h(hashlib.sha1)) % m for i in range(k)}


def items_of(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "ord long, item string").repartition(3)


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "item string")


def members(pages):
    """The set bits of pages, byte by byte from the lowest bit."""
    return {r.page * bloom.PAGE_BITS + 8 * at + b for r in pages.collect() for at, byte in enumerate(r.bitmap) for b in range(8) if byte >> b & 1}


#: Beyond 2**31 bits and 2**32 bits, and filter 17 of the default growing filter.
LARGE = [2**31 - 1, 2**31, 2**33 + 9, bloom.scalable_filter(most=18)[17][3], 2**47]


@pytest.mark.parametrize("bits", [7, 71888, *LARGE])
def test_bits_and_pages(spark, bits):
    names = [f"item {i} é" for i in range(40)]
    want = set().union(*(bits_of(x, bits, 5) for x in names))
    assert {r.bit for r in bloom.filter_bits(frame(spark, names), bits, 5).collect()} == want
    pages = bloom.filter_pages(frame(spark, names), bits, 5)
    assert members(pages) == want
    assert bloom.set_bits(pages).first().filled == len(want)
    probes = [*names, *(f"other {i}" for i in range(60))]
    said = {x: bits_of(x, bits, 5) <= want for x in probes}
    for most in (bloom.MAX_PAGE_BYTES, 0):
        assert {r.item: r.maybe for r in bloom.page_membership(frame(spark, probes), pages, bits, 5, most).collect()} == said


def test_too_many_bits_are_refused(spark):
    with pytest.raises(ValueError):
        bloom.filter_bits(frame(spark, ["x"]), 2**47 + 1, 3)


def test_no_shuffle_of_probes(spark):
    pages = bloom.filter_pages(frame(spark, ["a", "b"]), 10**5, 3)
    plan = bloom.page_membership(frame(spark, ["a", "c"]), pages, 10**5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_probes_keep_their_columns_rows_and_nulls(spark):
    probes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("q", 4, None)], "item string, page int, bitmap string")
    pages = bloom.filter_pages(frame(spark, ["a", "b"]), 10**5, 3)
    for most in (bloom.MAX_PAGE_BYTES, 0):
        got = bloom.page_membership(probes, pages, 10**5, 3, most)
        assert got.columns == ["item", "page", "bitmap", "maybe"]
        assert sorted((r.page, r.bitmap, r.item, bool(r.maybe)) for r in got.collect()) == [(1, "x", "a", True), (2, "y", "a", True), (3, "z", None, False), (4, None, "q", False)]
    assert not any(r.maybe for r in bloom.page_membership(probes, bloom.cleared(pages), 10**5, 3).collect())


def test_merged_pages(spark):
    one, two = (bloom.filter_pages(frame(spark, names), 10**6, 4) for names in (["a", "b"], ["b", "c"]))
    assert members(bloom.merged_pages(one, two)) == members(bloom.filter_pages(frame(spark, ["a", "b", "c"]), 10**6, 4))


@pytest.mark.parametrize(("bits", "hashes"), [(40, 2), (300, 3), (5000, 5), (2**33, 4)])
def test_add_if_new(spark, bits, hashes):
    names = [f"n{i * i % 150}" for i in range(200)]
    held, want = set(), []
    for x in names:
        want.append(not bits_of(x, bits, hashes) <= held)
        held |= bits_of(x, bits, hashes)
    got = bloom.add_if_new(items_of(spark, names), bits, hashes)
    assert [r.is_new for r in got.orderBy("ord").collect()] == want
    assert 0 < sum(want) < len(set(names)) or bits > 1000


@pytest.mark.parametrize(("n", "p", "count"), [(10, 0.2, 230), (10, 0.01, 30), (7, 0.1, 7), (5, 0.5, 0)])
def test_growing_filter_adds_what_is_new(spark, n, p, count):
    names = [f"n{i * 7 % 190}" for i in range(count)]
    filters, want = [], []
    for x in names:
        if any(bits_of(x, m, k) <= held for held, m, k, _ in filters):
            want.append((False, None))
            continue
        if not filters or filters[-1][3][0] >= n * 2 ** (len(filters) - 1):
            _, _, _, m, k = bloom.scalable_filter(n, p, most=len(filters) + 1)[-1]
            filters.append((set(), m, k, [0]))
        filters[-1][0].update(bits_of(x, filters[-1][1], filters[-1][2]))
        filters[-1][3][0] += 1
        want.append((True, len(filters) - 1))
    got = bloom.scalable_add_if_new(items_of(spark, names), n, p)
    assert [(r.is_new, r.filter) for r in got.orderBy("ord").collect()] == want


def test_growing_filter_reads_an_arrival_in_few_rounds(spark, monkeypatch):
    read, real = [], bloom.add_if_new
    monkeypatch.setattr(bloom, "add_if_new", lambda items, *a: read.append(items.count()) or real(items, *a))
    got = bloom.scalable_add_if_new(items_of(spark, [f"n{i}" for i in range(400)]), 10, 0.05)
    assert got.count() == 400 and len(read) == 6
    assert sum(read) <= 2 * 400


@pytest.mark.parametrize("most", [bloom.PAGE_BITS, 0])
def test_in_any_of_several_filters(spark, most):
    names, sizes = [f"n{i}" for i in range(60)] + [None], [(300, 3), (5000, 5)]
    held = [[f"n{i}" for i in range(0, 20, 2)], [f"n{i}" for i in range(1, 20, 2)]]
    filters = [bloom.Filter(m, k, bloom.filter_pages(frame(spark, h), m, k)) for h, (m, k) in zip(held, sizes)]
    sets = [set().union(*(bits_of(x, m, k) for x in h)) for h, (m, k) in zip(held, sizes)]
    want = {x: x is not None and any(bits_of(x, m, k) <= s for s, (m, k) in zip(sets, sizes)) for x in names}
    assert {r.item: r.maybe for r in bloom.in_any(frame(spark, names), filters, most).collect()} == want


def test_digests_fold_alike_in_numpy(spark):
    for bits in (40, 2**31 - 1, 2**33, bloom.MOST_BITS):
        x = hashlib.sha1(b"x").digest()
        assert bloom._folded(pd.Series([x, x]), bits).tolist() == [int.from_bytes(x, "big") % bits] * 2


def test_membership_in_a_growing_filter_joins_no_probes(spark):
    names = [f"n{i}" for i in range(100)]
    got = bloom.scalable_membership(frame(spark, [*names, "a", "a", None]), items_of(spark, names).withColumn("ord", F.col("ord") + 1), 10, 0.01)
    assert "Join" not in got._jdf.queryExecution().toString()
    held = {r.item: r.maybe for r in got.collect()}
    assert len(held) == got.count() == 102 and all(held[x] for x in names) and not held[None]


def test_dedup_statistics(spark):
    row = bloom.dedup_stats(items_of(spark, ["a", "b", "a", "c", "b"]), 100, 0.01).first()
    assert (row.offered, row.refused, row.elements_added, row.size_bits, row.hash_count) == (5, 2, 3, 959, 7)
    assert row.fill_ratio == round(len(set().union(*(bits_of(x, 959, 7) for x in "abc"))) / 959, 4)


@pytest.mark.parametrize("high", [0, 1_500_000_000])
def test_search_both_ways_with_large_edge_numbers(spark, high):
    """An edge goes before a reversed one, whatever their numbers."""
    nodes = spark.createDataFrame([(x, "t") for x in "abcd"], "id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "r", high + 9), ("c", "a", "r", high + 1), ("b", "d", "r", high + 8), ("d", "c", "r", high + 2)], "src string, dst string, relation string, seq int")
    got = graph.bfs(nodes, edges, spark.createDataFrame([("a",)], "start string"), 2, direction="both")
    assert {r.id: r.path for r in got.collect()} == {"b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}
    big = edges.withColumn("seq", F.col("seq").cast("long") + 5_000_000_000)
    assert {r.id: r.path for r in graph.bfs(nodes, big, spark.createDataFrame([("a",)], "start string"), 2, direction="both").collect()}["d"] == ["a", "b", "d"]

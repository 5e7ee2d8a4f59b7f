"""Bloom filters as sets of bits. Deduplication is exact by default; these reproduce the sketch bit by bit.

Bit i of an item is (md5 + i * sha1) mod m. The digests do not fit a number type, so they are folded to their remainder 32 or, for filters of 2**31 bits and more, 16 bits at a time.
A filter is a table of its set bits, or one of bit pages: 32,768 bits each, built and merged by Spark's bitmap aggregates, and tested where the probes are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import settled, written

#: Bits of a page, and the bytes of pages that :func:`page_membership` broadcasts at most.
PAGE_BITS, MAX_PAGE_BYTES = 32_768, 256 << 20
#: Bytes of filters that each Python worker holds at most in :func:`in_any`.
MAX_HELD_BYTES = 64 << 20
#: Above this a remainder times 2**16 does not fit 63 bits.
MOST_BITS = 2**47


def optimal_bits(n: int, p: float) -> int:
    return math.ceil(-n * math.log(p) / math.log(2) ** 2)


def optimal_hashes(bits: int, n: int) -> int:
    return max(1, round(bits / n * math.log(2)))


def folded(digest: Column, pieces: int, bits: int) -> Column:
    """The number of a hex digest of ``pieces`` times 8 digits, modulo ``bits``."""
    if not 0 < bits <= MOST_BITS:
        raise ValueError(f"a filter has 1 to {MOST_BITS} bits")
    digits = 8 if bits < 2**31 else 4  # a remainder times 16**digits has to fit
    out = F.lit(0).cast("long")
    for i in range(0, 8 * pieces, digits):
        out = (out * F.lit(16**digits % bits) + F.conv(F.substring(digest, 1 + i, digits), 16, 10).cast("long")) % bits
    return out


def positions(item: Column, bits: int, hashes: int) -> Column:
    both = F.array(F.struct(folded(F.md5(item), 4, bits).alias("h1"), folded(F.sha1(item), 5, bits).alias("h2")))  # in the plan once, not once a hash
    return F.flatten(F.transform(both, lambda h: F.array(*[(h["h1"] + i * h["h2"]) % bits for i in range(hashes)])))


def filter_bits(items: DataFrame, bits: int, hashes: int) -> DataFrame:
    """bit: the set bits of a filter of all ``item``s. At most ``bits`` rows; made distinct a partition before the shuffle."""
    return items.select(F.explode(positions(F.col("item"), bits, hashes)).alias("bit")).distinct()


def membership(probes: DataFrame, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """item, maybe: whether all of an item's bits are set."""
    each = probes.select("item").distinct().withColumn("bit", F.explode(F.array_distinct(positions(F.col("item"), bits, hashes))))
    hits = each.join(filter_.select("bit", F.lit(1).alias("set")), "bit", "left")
    return hits.groupBy("item").agg((F.count("set") == F.count(F.lit(1))).alias("maybe"))


def filter_pages(items: DataFrame, bits: int, hashes: int) -> DataFrame:
    """page, bitmap: the filter of all ``item``s as pages of PAGE_BITS bits, those without a set bit left out. A task sends a page once, however many items set bits in it."""
    set_ = items.select(F.explode(positions(F.col("item"), bits, hashes)).alias("bit"))
    return set_.groupBy(F.floor(F.col("bit") / PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))


def merged_pages(one: DataFrame, *more: DataFrame) -> DataFrame:
    """The pages of a filter of what any of the filters holds; all have to be of one size and number of hashes."""
    return reduce(DataFrame.unionByName, more, one).groupBy("page").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def set_bits(pages: DataFrame) -> DataFrame:
    """filled: how many bits are set."""
    return pages.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("filled"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit % PAGE_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))


def page_membership(probes: DataFrame, pages: DataFrame, bits: int, hashes: int, most: int = MAX_PAGE_BYTES) -> DataFrame:
    """``probes`` with maybe: whether all bits of their ``item`` are set in the filter of these pages.

    Pages of up to ``most`` bytes in all are broadcast, once for all hashes, and no probe is shuffled. Beyond that each probe's distinct bits meet the pages in a shuffle.
    """
    pages = settled(pages)
    names = probes.columns
    found = probes.withColumn("_bits", positions(F.col("item"), bits, hashes))
    if pages.count() * (PAGE_BITS // 8) <= most:
        found = found.withColumn("maybe", F.lit(True))
        for i in range(hashes):
            bit = F.col("_bits")[i]
            found = found.withColumn("_page", F.floor(bit / PAGE_BITS)).join(F.broadcast(pages.select(F.col("page").alias("_page"), F.col("bitmap").alias("_bitmap"))), "_page", "left")
            found = found.withColumn("maybe", F.col("maybe") & _is_set(F.col("_bitmap"), bit)).drop("_page", "_bitmap")
        return found.select(*names, "maybe")
    each = found.select("item").distinct().select("item", F.explode(F.array_distinct(positions(F.col("item"), bits, hashes))).alias("_bit")).withColumn("_page", F.floor(F.col("_bit") / PAGE_BITS))
    hits = each.join(pages.select(F.col("page").alias("_page"), F.col("bitmap").alias("_bitmap")), "_page", "left")
    said = hits.groupBy(F.col("item").alias("_item")).agg(F.min(_is_set(F.col("_bitmap"), F.col("_bit"))).alias("maybe"))
    return probes.join(said, F.col("item").eqNullSafe(F.col("_item"))).select(*names, "maybe")


@dataclass
class Filter:
    """A filter of ``bits`` bits as pages (page, bitmap)."""

    bits: int
    hashes: int
    pages: DataFrame


def _folded(digests: pd.Series, bits: int) -> np.ndarray:
    """:func:`folded` of whole columns of binary digests."""
    size, top = (4, 2**32) if bits < 2**31 else (2, 2**16)
    pieces = np.frombuffer(b"".join(digests), f">u{size}").reshape(len(digests), -1).astype(np.int64)
    out = np.zeros(len(digests), np.int64)
    for i in range(pieces.shape[1]):
        out = (out * (top % bits) + pieces[:, i]) % bits
    return out


def in_any(probes: DataFrame, filters: list[Filter], most: int = MAX_HELD_BYTES) -> DataFrame:
    """``probes`` with maybe: whether any of the filters has all bits of their ``item``.

    Filters of up to ``most`` bytes in all go to the tasks as bit sets, and no probe is shuffled; an item leaves a filter at the first bit that is not set. Beyond that it is :func:`page_membership`, a filter at a time.
    """
    if sum(-(-f.bits // PAGE_BITS) * (PAGE_BITS // 8) for f in filters) > most:
        out = probes.withColumn("maybe", F.lit(False))
        for f in filters:
            out = page_membership(out.withColumnRenamed("maybe", "_before"), f.pages, f.bits, f.hashes).withColumn("maybe", F.col("maybe") | F.col("_before")).drop("_before")
        return out
    if not filters:
        return probes.withColumn("maybe", F.lit(False))
    held = []
    for f in filters:
        table = np.zeros((-(-f.bits // PAGE_BITS), PAGE_BITS // 8), np.uint8)
        for page, bitmap in f.pages.where("page is not null").select("page", "bitmap").collect():  # MAX_HELD_BYTES at most
            table[page] = np.frombuffer(bitmap, np.uint8)
        held.append((f.bits, f.hashes, table.reshape(-1)))
    shared = probes.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def maybe(md5s: pd.Series, sha1s: pd.Series) -> pd.Series:
        out = np.zeros(len(md5s), bool)
        left = np.flatnonzero(md5s.notna().to_numpy())  # in no filter so far
        for bits, hashes, table in reversed(shared.value):  # the largest first
            if not len(left):
                break
            at, h1, h2 = left, _folded(md5s.iloc[left], bits), _folded(sha1s.iloc[left], bits)
            for i in range(hashes):
                bit = (h1 + i * h2) % bits
                on = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                at, h1, h2 = at[on], h1[on], h2[on]
            out[at] = True
            left = left[~out[left]]
        return pd.Series(out)

    return probes.withColumn("maybe", maybe(F.unhex(F.md5("item")), F.unhex(F.sha1("item"))))


def add_if_new(items: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``items`` (item, ord: a number of its own for each, in order of arrival) with is_new: whether a filter that starts empty, and takes each item in turn, did not hold it yet.

    An item that is refused would have set no bit that is not set, so after any number of arrivals the set bits are those of all items so far, refused or not. So an item
    is new if and only if it is the earliest of all that have one of its bits: a grouped minimum for each bit replaces the replay, false positives included.
    """
    setters = items.select("ord", F.explode(positions(F.col("item"), bits, hashes)).alias("bit")).groupBy("bit").agg(F.min("ord").alias("ord"))
    new = setters.select("ord").distinct().withColumn("_new", F.lit(True))
    return items.join(new, "ord", "left").select(*items.columns, F.coalesce("_new", F.lit(False)).alias("is_new"))


def dedup_stats(items: DataFrame, n: int, p: float) -> DataFrame:
    """offered, refused and a filter's statistics once it has been offered the ``items`` (item, ord) in turn; elements_added counts what it took as new."""
    bits = optimal_bits(n, p)
    hashes = optimal_hashes(bits, n)
    taken = add_if_new(items, bits, hashes).agg(F.count(F.lit(1)).alias("offered"), F.count(F.when(~F.col("is_new"), 1)).alias("refused"), F.count(F.when(F.col("is_new"), 1)).alias("elements_added"))
    ratio = F.col("filled") / F.lit(bits)
    return taken.join(set_bits(filter_pages(items, bits, hashes)), F.lit(True)).select(
        "offered", "refused", F.lit(bits).alias("size_bits"), F.lit(math.ceil(bits / 8)).alias("size_bytes"), F.lit(hashes).alias("hash_count"), "elements_added",
        F.round(ratio, 4).alias("fill_ratio"), F.round(F.pow(ratio, F.lit(hashes)), 6).alias("estimated_fp_rate"), F.lit(float(p)).alias("target_fp_rate"),
    )


def cleared(pages: DataFrame) -> DataFrame:
    """The filter with no bit set."""
    return pages.limit(0)


def stats(items: DataFrame, n: int, p: float) -> DataFrame:
    """size_bits, size_bytes, hash_count, elements_added, fill_ratio, estimated_fp_rate, target_fp_rate of a filter of distinct items."""
    bits = optimal_bits(n, p)
    hashes = optimal_hashes(bits, n)
    distinct = items.select("item").distinct()
    filled = filter_bits(distinct, bits, hashes).agg(F.count(F.lit(1)).alias("filled"))
    added = distinct.agg(F.count(F.lit(1)).alias("elements_added"))
    ratio = F.col("filled") / F.lit(bits)
    return filled.join(added, F.lit(True)).select(
        F.lit(bits).alias("size_bits"), F.lit(math.ceil(bits / 8)).alias("size_bytes"), F.lit(hashes).alias("hash_count"), "elements_added",
        F.round(ratio, 4).alias("fill_ratio"), F.round(F.pow(ratio, F.lit(hashes)), 6).alias("estimated_fp_rate"), F.lit(float(p)).alias("target_fp_rate"),
    )


def scalable_filter(n: int = 1000, p: float = 0.01, growth: int = 2, tightening: float = 0.5, most: int = 40) -> list[tuple[int, int, float, int, int]]:
    """(filter, capacity, rate, bits, hashes) of the first ``most`` filters."""
    out = []
    for j in range(most):
        capacity, rate = n * growth**j, p * tightening**j
        bits = optimal_bits(capacity, rate)
        out.append((j, capacity, rate, bits, optimal_hashes(bits, capacity)))
    return out


def arrivals(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` with ord: their number from 1 in the given order, without gaps. Rows are written down and sorted by ranges; each range is offset by the counts before it."""
    ranged = settled(written(items, "arrivals").orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    offsets, total = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += n
    before = items.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return ranged.join(F.broadcast(before), "_part").withColumn("ord", F.col("_before") + F.col("_row") + 1).drop("_at", "_part", "_row", "_before")


def scalable_bits(items: DataFrame, n: int = 1000, p: float = 0.01, growth: int = 2, tightening: float = 0.5) -> DataFrame:
    """filter, bit: the set bits of each filter of ``items`` (item, ord), with its own size and hashes."""
    assigned = scalable_assignment(items, n, growth)
    last = assigned.agg(F.max("filter")).first()[0]
    if last is None:
        return assigned.select("filter", F.lit(None).cast("long").alias("bit"))
    found = [filter_bits(assigned.where(F.col("filter") == j), bits, hashes).select(F.lit(j).alias("filter"), "bit") for j, _, _, bits, hashes in scalable_filter(n, p, growth, tightening, last + 1)]
    return reduce(DataFrame.unionByName, found)


def scalable_membership(probes: DataFrame, items: DataFrame, n: int = 1000, p: float = 0.01, growth: int = 2, tightening: float = 0.5) -> DataFrame:
    """item, maybe: whether any of the filters of ``items`` (item, ord) has all of its bits."""
    assigned = settled(scalable_assignment(items, n, growth))
    last = assigned.agg(F.max("filter")).first()[0]
    sizes = [] if last is None else scalable_filter(n, p, growth, tightening, last + 1)
    filters = [Filter(bits, hashes, filter_pages(assigned.where(F.col("filter") == j), bits, hashes)) for j, _, _, bits, hashes in sizes]
    return in_any(probes.select("item"), filters).distinct()  # one answer an item


def scalable_assignment(items: DataFrame, n: int = 1000, growth: int = 2) -> DataFrame:
    """``items`` (item, ord: arrival from 1 without gaps) with the number of the filter that takes each.

    With growth g filters 0..j hold n (g**(j+1) - 1) / (g - 1) items, so the number is a logarithm; no window is needed.
    """
    if growth == 1:
        return items.withColumn("filter", F.floor((F.col("ord") - 1) / n).cast("int"))
    return items.withColumn("filter", F.floor(F.log((F.col("ord") - 1) * (growth - 1) / n + 1) / math.log(growth) + 1e-12).cast("int"))


def scalable_add_if_new(items: DataFrame, n: int = 1000, p: float = 0.01, growth: int = 2, tightening: float = 0.5) -> DataFrame:
    """``items`` (item, ord) with is_new and filter (the number of the filter that took it, null if refused), of a growing filter that takes each item in turn.

    Round j takes what arrives after filter j - 1 was full, tests it against the filters before, and fills filter j with the rest as :func:`add_if_new` says, up to the arrival that makes ``n * growth**j``
    items new. It reads arrivals of twice that number, then of twice as many again as long as these don't fill it, so an item is in few rounds. There are as many rounds as filters, so a logarithm of the items (growth 2 or more).
    """
    names = items.columns
    items = written(items, "arrivals")
    low, high = items.agg(F.min("ord"), F.max("ord")).first()
    done, filters, j, width = [], [], 0, 2 * n
    after = 0 if low is None else low - 1  # the last arrival that is judged
    while high is not None and after < high:
        _, capacity, _, bits, hashes = scalable_filter(n, p, growth, tightening, j + 1)[-1]
        window = in_any(items.where((F.col("ord") > after) & (F.col("ord") <= after + width)), filters)
        window = written(window, "arrivals")
        tried = add_if_new(window.where("not maybe").select(*names), bits, hashes)
        tried = written(tried.select(*names, "is_new").unionByName(window.where("maybe").select(*names, F.lit(False).alias("is_new"))), "arrivals")
        last = _nth(tried.where("is_new"), capacity)
        if last is None and after + width < high:
            width *= 2
            continue
        now = tried if last is None else tried.where(F.col("ord") <= last)
        done.append(now.select(*names, "is_new", F.when(F.col("is_new"), j).alias("filter")))
        if last is None:
            break
        filters.append(Filter(bits, hashes, settled(filter_pages(now.where("is_new"), bits, hashes))))
        after, j, width = last, j + 1, 2 * capacity * growth
    return reduce(DataFrame.unionByName, done) if done else items.select(*names, F.lit(None).cast("boolean").alias("is_new"), F.lit(None).cast("int").alias("filter"))


#: Arrivals that are counted together to find the one of a number.
SPAN = 1 << 14


def _nth(rows: DataFrame, n: int) -> int | None:
    """The n-th smallest ``ord``, which no two rows share; None of fewer rows. Spans of ord are counted, then one of them is sorted."""
    spans = sorted(tuple(r) for r in rows.groupBy(F.floor(F.col("ord") / SPAN).alias("span")).count().collect())
    for span, count in spans:
        if n <= count:
            inside = rows.where(F.floor(F.col("ord") / SPAN) == span).select("ord").collect()  # SPAN at most
            return sorted(r.ord for r in inside)[n - 1]
        n -= count
    return None

"""Large keyword dictionaries: one pass over each text with a multi-pattern automaton, whatever the number of keywords.

Keywords and phrases become a trie over bytes, laid out in flat arrays level by level: sorted edges, failure links, output links. The arrays are broadcast; their size is measured, and a dictionary
whose arrays would be larger than ``MAX_BYTES`` is dealt out by hash to as many automata as it takes, each of which reads the texts once.
A task walks the automaton over many stretches of text at once: a state depends on no more bytes than the longest keyword has, so each stretch starts that much earlier.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of one automaton's arrays, and a bound on those that a byte of a keyword takes there.
MAX_BYTES, NODE_BYTES = 256 << 20, 40
#: Text that is walked at once, and the length of a stretch.
PIECE_BYTES, STRETCH = 4 << 20, 1024
#: Nodes next to the root whose every step is looked up in one table.
DENSE = 4096


@dataclass
class Automaton:
    """Node 0 is the root; node i + 1 is the child at the end of edge i."""

    first: np.ndarray  # first edge of each node, and the number of edges
    label: np.ndarray  # byte of each edge; a node's are sorted
    fail: np.ndarray
    pattern: np.ndarray  # of the pattern that ends in a node, or -1
    output: np.ndarray  # the node itself or the next one along its failure links where a pattern ends, or -1
    longest: int
    near: np.ndarray  # where the first nodes go on each byte

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.first, self.label, self.fail, self.pattern, self.output, self.near))

    @classmethod
    def of(cls, patterns: list[bytes]) -> Automaton:
        """Of distinct patterns, none of them empty or with a zero byte (which pads the texts)."""
        data = np.frombuffer(b"".join(patterns), np.uint8)
        size = np.fromiter(map(len, patterns), np.int64, len(patterns))
        start = np.cumsum(size) - size
        at = np.zeros(len(patterns), np.int64)  # each pattern's node so far
        keys, levels, nodes = [np.zeros(0, np.int64)], [0, 1], 1
        for depth in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > depth)
            found, which = np.unique(at[live] << 8 | data[start[live] + depth], return_inverse=True)
            at[live] = nodes + which
            keys.append(found)
            nodes += len(found)
            levels.append(nodes)
        edges = np.concatenate(keys)  # parents are numbered level by level, so all edges are sorted
        first = np.searchsorted(edges >> 8, np.arange(nodes + 1)).astype(np.int32)
        pattern = np.full(nodes, -1, np.int32)
        pattern[at] = np.arange(len(patterns))
        made = cls(first, (edges & 255).astype(np.uint8), np.zeros(nodes, np.int32), pattern, np.where(pattern >= 0, np.arange(nodes), -1).astype(np.int32), int(size.max(initial=0)), np.zeros((0, 256), np.int32))
        for a, b in zip(levels[1:], levels[2:]):
            node = np.arange(a, b)
            parent = edges[node - 1] >> 8
            if a > 1:
                made.fail[node] = made.step(made.fail[parent].astype(np.int64), made.label[node - 1])
            bare = node[pattern[node] < 0]
            made.output[bare] = made.output[made.fail[bare]]
        near = min(nodes, DENSE)
        made.near = made.step(np.repeat(np.arange(near), 256), np.tile(np.arange(256), near)).astype(np.int32).reshape(near, 256)
        return made

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children, or -1."""
        low, high = self.first[node].astype(np.int64), self.first[node + 1].astype(np.int64)
        out = np.full(len(node), -1, np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return out
            middle = (low[live] + high[live]) >> 1
            label = self.label[middle]
            same = label == byte[live]
            out[live[same]] = middle[same] + 1
            low[live] = np.where(label < byte[live], middle + 1, np.where(same, high[live], low[live]))
            high[live] = np.where(label > byte[live], middle, high[live])

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each node goes on a byte: down, or along failure links until there is a way down or the root."""
        out = self.child(node, byte)
        lost = np.flatnonzero((out < 0) & (node > 0))
        node = node.copy()
        while len(lost):
            node[lost] = self.fail[node[lost]]
            out[lost] = self.child(node[lost], byte[lost])
            lost = lost[(out[lost] < 0) & (node[lost] > 0)]
        return np.maximum(out, 0)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last byte, pattern) of every occurrence."""
        length = max(STRETCH, 4 * self.longest)
        n = -(-len(data) // length)
        padded = np.zeros(self.longest + n * length, np.uint8)
        padded[self.longest : self.longest + len(data)] = data
        node, lanes = np.zeros(n, np.int64), np.arange(n) * length
        ends, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(self.longest + length if n else 0):
            byte, far = padded[lanes + at], np.flatnonzero(node >= len(self.near))
            there = self.step(node[far], byte[far]) if len(far) else None
            node = self.near[np.minimum(node, len(self.near) - 1), byte].astype(np.int64)
            if there is not None:
                node[far] = there
            if at >= self.longest:
                found = self.output[node]
                here = np.flatnonzero(found >= 0)
                if len(here):
                    ends.append(lanes[here] + at - self.longest)
                    nodes.append(found[here].astype(np.int64))
        end, node = np.concatenate(ends), np.concatenate(nodes)
        all_ends, patterns = [end[:0]], [node[:0]]
        while len(node):
            all_ends.append(end)
            patterns.append(self.pattern[node].astype(np.int64))
            node = self.output[self.fail[node]].astype(np.int64)
            end, node = end[node >= 0], node[node >= 0]
        return np.concatenate(all_ends), np.concatenate(patterns)


def spaced(text: Column, whole: bool = True) -> Column:
    """Lowered runs of letters and numbers, a blank before each and (``whole``) one after the last."""
    words = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" " if whole else "")))


@dataclass
class _Dictionary:
    automaton: Automaton
    categories: pa.Array  # of all keywords, those of one pattern side by side
    keywords: pa.Array
    first: np.ndarray  # first keyword of each pattern, and their number


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Bytes, bounds and rows of slices of whole texts, of PIECE_BYTES or a little more."""
    text = batch.column("_text").cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    part = (bounds[1:] - bounds[0]) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(text)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], batch.slice(a, b - a)


def dictionary_hits(docs: DataFrame, keywords: DataFrame, whole: bool = True, most: int = MAX_BYTES) -> DataFrame:
    """doc, category, keyword, n: how often each keyword of (category, keyword) stands in each text of (doc, content); rows without a hit are left out.

    A keyword's words have to stand side by side, whatever is between them but letters and numbers; with ``whole=False`` the last one may be the beginning of a longer word. Case
    does not count. Repeated keywords count once a category; keywords without a letter or number never hit. Rows of one doc are judged each on its own.
    """
    listed = keywords.select(F.col("category").cast("string").alias("category"), F.col("keyword").cast("string").alias("keyword"), spaced(F.col("keyword"), whole).alias("pattern")).where("pattern is not null").distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size * NODE_BYTES // most))
    rows = docs.select("doc", F.coalesce(spaced(F.col("content")), F.lit("")).alias("_text"))
    kind = docs.schema["doc"].dataType
    schema = StructType([StructField("doc", kind), StructField("category", StringType()), StructField("keyword", StringType()), StructField("n", LongType())])
    return reduce(DataFrame.unionByName, [_hits_of(rows, listed.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == n), schema) for n in range(parts)])


def dictionary_of(listed: DataFrame) -> _Dictionary:
    """The automaton of the patterns in ``listed`` (category, keyword, pattern), which is bounded by the caller."""
    table = listed.toArrow().sort_by([("pattern", "ascending"), ("category", "ascending"), ("keyword", "ascending")])
    patterns = [p.encode() for p in table.column("pattern").to_pylist()]
    fresh = [i for i, p in enumerate(patterns) if not i or p != patterns[i - 1]]
    return _Dictionary(Automaton.of([patterns[i] for i in fresh]), table.column("category").combine_chunks(), table.column("keyword").combine_chunks(), np.array([*fresh, len(patterns)]))


def _hits_of(rows: DataFrame, listed: DataFrame, schema: StructType) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(dictionary_of(listed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n_patterns = len(known.first) - 1
        for batch in batches:
            for data, bounds, part in _pieces(batch):
                end, pattern = known.automaton.hits(data)
                doc = np.searchsorted(bounds, end, side="right") - 1
                found, n = np.unique(doc * max(n_patterns, 1) + pattern, return_counts=True)
                doc, pattern = found // max(n_patterns, 1), found % max(n_patterns, 1)
                many = known.first[pattern + 1] - known.first[pattern]  # keywords of the pattern
                word = np.repeat(known.first[pattern], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(np.repeat(doc, many))), known.categories.take(pa.array(word)), known.keywords.take(pa.array(word)), pa.array(np.repeat(n, many))], schema.names)

    return rows.mapInArrow(run, schema)

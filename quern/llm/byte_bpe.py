"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its documents in blocks of some 8 MB. Each distinct piece (match of the split pattern) of a block stands
once in one long array of byte tokens. An inverted index maps each mergeable pair, by the rank of the token it makes,
to the positions where the pair starts; ranks are replayed in ascending order, each over all its positions at once,
and only the pairs beside a merged position are looked up anew. Documents are then spelled with the finished pieces.

The result equals that of an encoder that takes the lowest rank in each piece, leftmost first. The two orders could
differ only where a merge makes a pair of a lower rank than its own; pieces where that happens are encoded one by one
(:func:`lowest_first`). A piece that is itself a token is that token.

Replay over the distinct pieces of the whole corpus was built twice and measured: a text's numbers of pieces have to be written and shuffled back to
their ids, which takes over twice the disk that there is for the same ids (README). Pieces do not touch each other, so a block's merges are the corpus' merges.

Pieces of earlier blocks are kept by the worker process (``MAX_PIECES`` of them), so a task's cost follows its new pieces.

Defined cases: null text is empty and has no ids; repeated rows come out as often as they go in; a very long text is a
block of its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, runs

BLOCK_BYTES = 8 << 20
#: Pieces that a worker process keeps from block to block.
MAX_PIECES = 250_000
_NONE = np.int32(2**31 - 1)

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, for the driver to broadcast; it holds a token and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def lowest_first(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One piece by the plain rule: merge the leftmost pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == _NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes_to_token = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        codes, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    codes.append(left * self.size + right)
                    made.append(rank)
        order = np.argsort(codes)
        self.pair_codes = np.array(codes, np.int64)[order]
        self.pair_ranks = np.array(made, np.int32)[order]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or _NONE."""
        codes = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_ranks[at], _NONE)


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words on end, and n + 1 offsets."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    token = np.append(vocab.bytes_to_token[np.frombuffer(b"".join(words), np.uint8)], np.int32(0))
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    ends = np.cumsum(sizes)
    after[ends - 1] = n  # position n stands for no neighbour
    before[ends - sizes] = n
    rank_at = np.full(n + 1, _NONE, np.int32)
    inner = np.flatnonzero(after[:n] < n)
    byte_rank = vocab.pair_rank(np.repeat(vocab.bytes_to_token, 256), np.tile(vocab.bytes_to_token, 256))
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    rank_at[inner] = byte_rank[raw[inner] * 256 + raw[inner + 1]]

    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            if rank in index:
                index[rank].append(positions[a:b])
            else:
                index[rank] = [positions[a:b]]
                heapq.heappush(waiting, rank)

    first = np.flatnonzero(rank_at != _NONE)
    if len(first):
        enter(first, rank_at[first])
    odd = np.zeros(len(words), bool)
    dead = np.zeros(n + 1, bool)
    while waiting:
        rank = heapq.heappop(waiting)
        lists = index.pop(rank)
        p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        p = p[rank_at[p] == rank]
        if not len(p):
            continue
        chained = after[p[:-1]] == p[1:]
        if chained.any():  # of overlapping pairs, every other one from the left
            run = np.concatenate(([0], np.cumsum(~chained)))
            p = p[runs(np.bincount(run)) % 2 == 0]
        q = after[p]
        r = after[q]
        beside = r[:-1] == p[1:]
        if beside.any():  # the left one would be merged before the right one: the pair it makes meanwhile
            meanwhile = vocab.pair_rank(np.full(int(beside.sum()), rank), token[p[1:][beside]]) < rank
            odd[owner[p[1:][beside][meanwhile]]] = True
        token[p] = rank
        dead[q] = True
        rank_at[q] = _NONE
        after[p] = r
        before[r] = p
        left = before[p]
        has_left, has_right = left < n, r < n
        at = np.concatenate((left[has_left], p))
        made = np.concatenate((vocab.pair_rank(token[left[has_left]], token[p[has_left]]), np.full(len(p), _NONE, np.int32)))
        made[len(at) - len(p) :][has_right] = vocab.pair_rank(token[p[has_right]], token[r[has_right]])
        rank_at[at] = made
        some = made != _NONE
        if some.any():
            at, made = at[some], made[some]
            if (made < rank).any():
                odd[owner[at[made < rank]]] = True
            enter(at, made)
    kept = ~dead[:n]
    ids, counts = token[:n][kept], np.bincount(owner[kept], minlength=len(words)) if n else np.zeros(len(words), np.int64)
    if odd.any():
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in np.flatnonzero(odd).tolist():
            parts[w] = np.array(lowest_first(words[w], vocab.ranks), np.int32)
        ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return ids.astype(np.int32), np.concatenate(([0], np.cumsum(counts)))


class _Index(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Known pieces and what they are spelled with."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocab, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        self.index, self.decimal, self.raw = _Index(), [], []
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Spell the pieces that the index has got since."""
        known = len(self.decimal)
        new = [p.encode() for p in list(self.index)[known:]]
        if not new:
            return
        whole = [self.vocab.ranks.get(p) for p in new]
        todo = [i for i, w in enumerate(whole) if w is None]
        ids, first = replay([new[i] for i in todo], self.vocab) if todo else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        spelled = [[w] if w is not None else None for w in whole]
        flat = ids.tolist()
        for i, a, b in zip(todo, first[:-1].tolist(), first[1:].tolist()):
            spelled[i] = flat[a:b]
        tokens = self.vocab.tokens
        self.decimal += [",".join(map(str, s)).encode() for s in spelled]
        self.raw += [b"".join([tokens[t] for t in s]) for s in spelled]
        counts = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.ids = np.concatenate((self.ids, np.fromiter((t for s in spelled for t in s), np.int32, int(counts.sum()))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each text the places of its pieces; all pieces' decimal ids and bytes."""
        if len(self.index) > MAX_PIECES:
            self.clear()
        at = self.index.__getitem__
        places = []
        for text in texts:
            if text and len(text) > BLOCK_BYTES:  # no list of all its pieces
                places.append(np.fromiter((at(m[0]) for m in self.pattern.finditer(text)), np.int32))
                continue
            found = self.pattern.findall(text) if text else []
            places.append(np.fromiter(map(at, found), np.int32, len(found)))
        self.learn()
        return places, np.array(self.decimal, object), np.array(self.raw, object)


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(raw: bytes, pattern: str) -> Encoder:
    key = (hash(raw), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(parse_ranks(raw), pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, digests of the ids and of the bytes they decode to; the ids too on demand."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value, pattern)
        for batch in batches:
            for block in pieces(batch, "text", BLOCK_BYTES):
                places, decimal, raw = coder.encode(block.column("text").to_pylist())
                counts = np.diff(coder.first)
                sizes = np.array([counts[p].sum() for p in places], np.int64)
                cols = [
                    block.column("doc_id"),
                    pa.array(sizes),
                    pa.array([hashlib.sha256(b",".join(decimal[p].tolist())).hexdigest() for p in places], pa.string()),
                    pa.array([hashlib.sha256(b"".join(raw[p].tolist())).hexdigest() for p in places], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    flat = [coder.ids[np.repeat(coder.first[p], counts[p]) + runs(counts[p])] for p in places]
                    cuts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                    cols.append(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int32), *flat]))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, SCHEMA + ", ids array<int>" * ids)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with ids) with the column ``bytes`` that the ids spell; null ids spell null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("binary")
    def spell(column):
        tokens = {rank: token for token, rank in parse_ranks(shared.value).items()}
        return column.map(lambda ids: None if ids is None else b"".join([tokens[int(i)] for i in ids]))

    return encoded.withColumn("bytes", spell("ids"))

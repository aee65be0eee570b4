"""Byte-level BPE by a rank file: encoding and decoding.

A text is cut by the split pattern, and each match is merged separately: of all neighbouring
tokens the pair with the lowest rank, and of equal ranks the leftmost, becomes one token, until
no pair has a rank. A segment tree over the byte positions of a match keeps the leftmost minimum:
leaf i holds the rank of the pair that starts at position i, inner nodes the smaller child. A
merge changes three leaves (the merged position, its dead right half, its left neighbour), so it
costs a logarithmic number of point updates. Short matches are merged many at a time, one tree a
row; long ones alone.

Text between two blanks recurs, and no match crosses the place before a blank that a non-blank
follows. Texts are therefore cut there, and a bounded cache per worker keeps the ids of such
chunks; it changes no result.

Defined results: null and empty texts have no ids; decoding an empty or null list gives empty
bytes, and ids that are null or not in the file give no bytes. Texts are never shortened.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from quizloom.llm.chunks import ChunkCache, gather, ids_of_texts
from quizloom.llm.tables import cut_batch

NONE = np.int64(1) << 60
SHORT_BYTES = 64
CACHED_CHUNKS = 1 << 19
SLICE_CHARS = 1 << 20
# Leaves of the trees that are merged together.
CELLS = 1 << 19
# Text whose ids leave a task together.
BATCH_BYTES = 4 << 20
_BREAK = re.compile(r"(?= \S)")


class PairRanks:
    """Rank of two neighbouring ids, which is the id of their union; an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.of = {
            (ranks[token[:cut]] << 32) | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks
        }
        bits = max(4, (2 * len(self.of)).bit_length())
        self._mask, self._shift = (1 << bits) - 1, np.uint64(64 - bits)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NONE, np.int64)
        keys = np.fromiter(self.of.keys(), np.int64, len(self.of))
        values = np.fromiter(self.of.values(), np.int64, len(self.of))
        place = self._home(keys)
        while len(keys):
            free = self._keys[place] < 0
            _, first = np.unique(place, return_index=True)
            taken = np.zeros(len(keys), bool)
            taken[first] = free[first]
            self._keys[place[taken]], self._ranks[place[taken]] = keys[taken], values[taken]
            keys, values, place = keys[~taken], values[~taken], (place[~taken] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where a pair has no rank, or an id is negative."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), (left << 32) | right)
        found, place = np.full(len(keys), NONE), self._home(keys)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            at = place[open_]
            there = self._keys[at]
            hit = there == keys[open_]
            found[open_[hit]] = self._ranks[at[hit]]
            open_ = open_[~hit & (there >= 0)]
            place[open_] = (place[open_] + 1) & self._mask
        return found


def merge_many(pieces: list[bytes], pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each has. A segment tree per row."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    n, width = len(pieces), 1 << max(1, int(sizes.max() - 1).bit_length())
    depth = width.bit_length() - 1
    column = np.arange(width)
    inside = column < sizes[:, None]
    ids = np.full((n, width), -1, np.int64)
    ids[inside] = pairs.single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.where(column + 1 < sizes[:, None], column + 1, -1)
    before = np.where(inside, column - 1, -1)
    tree = np.full((n, 2 * width), NONE, np.int64)
    rank = pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width:-1] = np.where(rank < NONE, (rank << depth) | column[:-1], NONE)
    for level in range(depth - 1, -1, -1):
        low = 1 << level
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        best = tree[rows, 1]
        at, merged = best & (width - 1), best >> depth
        dead = after[rows, at]
        right, left = after[rows, dead], before[rows, at]
        ids[rows, at], ids[rows, dead] = merged, -1
        after[rows, at] = right
        has = right >= 0
        before[rows[has], right[has]] = at[has]
        right_id = np.where(has, ids[rows, right], -1)
        left_id = np.where(left >= 0, ids[rows, left], -1)
        new = pairs(np.concatenate([merged, left_id]), np.concatenate([right_id, merged]))
        start = np.concatenate([at, left])
        value = np.where(new < NONE, (new << depth) | start, NONE)
        # A missing left neighbour writes the dead leaf a second time.
        row3 = np.concatenate([rows, rows, rows])
        leaf = np.concatenate([at, dead, np.where(left >= 0, left, dead)]) + width
        tree[row3, leaf] = np.concatenate([value[:len(rows)], np.full(len(rows), NONE), value[len(rows):]])
        for _ in range(depth):
            leaf >>= 1
            tree[row3, leaf] = np.minimum(tree[row3, 2 * leaf], tree[row3, 2 * leaf + 1])
        rows = rows[tree[rows, 1] < NONE]
    alive = ids >= 0
    return ids[alive], alive.sum(axis=1)


def merge_one(piece: bytes, pairs: PairRanks) -> list[int]:
    """Ids of one long piece, by the same tree in plain lists."""
    size = len(piece)
    width = 1 << max(1, (size - 1).bit_length())
    depth, none, of = width.bit_length() - 1, int(NONE), pairs.of
    ids = [int(i) for i in pairs.single[np.frombuffer(piece, np.uint8)]]
    after, before = [*range(1, size), -1], list(range(-1, size - 1))

    def leaf_of(i: int, j: int) -> int:
        rank = of.get((ids[i] << 32) | ids[j])
        return none if rank is None else (rank << depth) | i

    tree = [none] * (2 * width)
    tree[width:width + size - 1] = [leaf_of(i, i + 1) for i in range(size - 1)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: int) -> None:
        node = i + width
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < none:
        at, merged = tree[1] & (width - 1), tree[1] >> depth
        dead, left = after[at], before[at]
        right = after[dead]
        ids[at], ids[dead], after[at] = merged, -1, right
        if right >= 0:
            before[right] = at
        update(dead, none)
        update(at, leaf_of(at, right) if right >= 0 else none)
        if left >= 0:
            update(left, leaf_of(left, at))
    return [i for i in ids if i >= 0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Ranks and pattern of a tokenizer, and the worker's cache of chunks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = PairRanks(self.ranks)
        self._split = regex.compile(pattern).findall
        self._cache = ChunkCache(self._learn, CACHED_CHUNKS)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # Runs of ids lie in ``pools`` in the order in which pieces are merged.
        pools, starts, sizes, filled = [whole], np.arange(len(pieces)), np.ones(len(pieces), np.int64), len(pieces)
        open_ = np.flatnonzero(whole < 0)
        widths = np.ceil(np.log2(np.maximum(lengths[open_], 2))).astype(np.int64)
        for bits in np.unique(widths).tolist():
            same = open_[widths == bits]
            step = max(1, CELLS >> bits) if (1 << bits) <= SHORT_BYTES else 1
            for first in range(0, len(same), step):
                chosen = same[first:first + step]
                if (1 << bits) > SHORT_BYTES:
                    ids = np.array(merge_one(pieces[int(chosen[0])], self.pairs), np.int64)
                    count = np.array([len(ids)])
                else:
                    ids, count = merge_many([pieces[i] for i in chosen.tolist()], self.pairs)
                pools.append(ids)
                starts[chosen], sizes[chosen] = filled + np.cumsum(count) - count, count
                filled += len(ids)
        return gather(np.concatenate(pools).astype(np.int32), starts, sizes), sizes

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self._split(c) for c in chunks]
        ids, sizes = self.merge([p.encode() for pieces in split for p in pieces])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(ends)

    @staticmethod
    def _chunks(text: str) -> Iterator[list[str]]:
        """Slices end where no match of the pattern crosses."""
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > SLICE_CHARS:
                place = _BREAK.search(text, start + SLICE_CHARS)
                end = place.start() if place else end
            yield [c for c in _BREAK.split(text[start:end]) if c]
            start = end

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        return ids_of_texts(texts, self._chunks, self._cache)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def encode_rows(
    df: DataFrame, text: str, path: str, pattern: str, *, ids: str = "ids", decoded: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Adds the ids of the text to every row, and, under the name ``decoded``, the bytes decoded
    from them. ``path`` has to be readable on every worker."""
    new = [ids, decoded] if decoded else [ids]
    kept = [c for c in df.columns if c not in new and (keep_text or c != text)]
    fields = [df.schema[c] for c in kept] + [StructField(ids, ArrayType(IntegerType()))]
    fields += [StructField(decoded, BinaryType())] if decoded else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, token = encoder(path, pattern), token_bytes(path)
        for batch in batches:
            for part in cut_batch(batch, text, BATCH_BYTES):
                found = own.encode_all(t.as_py() or "" for t in part[text])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = [part[c] for c in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32())))
                if decoded:
                    columns.append(pa.array([decode_ids(one.tolist(), token) for one in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=kept + new)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(encode, StructType(fields))


def decode_ids(ids: Iterable[int], token: dict[int, bytes]) -> bytes:
    return b"".join([token.get(i, b"") for i in ids])


def decode(ids: Column, path: str) -> Column:
    """Bytes of a list of ids."""

    @F.arrow_udf(BinaryType())
    def texts(lists: pa.Array) -> pa.Array:
        token = token_bytes(path)
        values = (one.values.to_pylist() if one.is_valid else () for one in lists)
        return pa.array([decode_ids(one, token) for one in values], pa.binary())

    return texts(ids)

"""Ids of texts by their parts between blanks, each distinct part looked up once a batch.

Arrow cuts the texts of a batch at blanks and numbers the distinct parts, so that only those become
Python strings. A chunk is a part together with all parts behind it that do not begin a chunk of
their own; ids of chunks met before come from two generations of a bounded table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quizloom.llm.chunks import gather

Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Generation:
    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.chars = self.filled = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.places), len(self.places) + len(chunks)
        total = self.filled + len(ids)
        if total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * total)
        if last > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * last), np.resize(self.sizes, 2 * last)
        self.pool[self.filled:total] = ids
        self.starts[first:last] = np.cumsum(sizes) - sizes + self.filled
        self.sizes[first:last] = sizes
        self.filled = total
        self.chars += sum(map(len, chunks))
        self.places.update(zip(chunks, range(first, last)))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        sizes = self.sizes[places]
        return gather(self.pool, self.starts[places], sizes), sizes


class ChunkTable:
    """``learn`` gives the ids of new chunks in a row, and how many each has. Between batches a
    table beyond its bounds becomes the old one, whose chunks are taken over when they are met."""

    def __init__(self, learn: Learn, most_chunks: int, most_chars: int):
        self._learn, self._most = learn, (most_chunks, most_chars)
        self._now, self._old = _Generation(), _Generation()

    def trim(self) -> None:
        if len(self._now.places) > self._most[0] or self._now.chars > self._most[1]:
            self._old, self._now = self._now, _Generation()

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where distinct chunks stand; holds until the next ``trim``."""
        known, old = self._now.places, self._old.places
        found = list(map(known.get, chunks))
        if None in found:
            new = [c for c, place in zip(chunks, found) if place is None]
            moved = [c for c in new if c in old]
            if moved:
                self._now.add(moved, *self._old.ids(np.array([old[c] for c in moved], np.int64)))
                new = [c for c in new if c not in old]
            if new:
                self._now.add(new, *self._learn(new))
            found = list(map(known.get, chunks))
        return np.array(found, np.int64)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._now.ids(places)


def ids_of_column(
    texts: pa.Array, table: ChunkTable, mark: str = " ", begins: Callable[[pa.Array], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each has; null texts have none.

    Texts are cut at ``mark``, which goes. ``begins`` says of parts behind a mark whether they begin
    a chunk, that is whether the text may be cut there; by default all do."""
    table.trim()
    lists = pc.split_pattern(pc.fill_null(texts, ""), mark)
    coded = lists.flatten().dictionary_encode()
    codes, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    open_ = begins(coded.dictionary) if begins else np.ones(len(parts), bool)
    counts = np.diff(lists.offsets.to_numpy())
    heads = np.zeros(len(codes) + 1, bool)  # first parts of texts, and the end
    heads[np.concatenate([[0], np.cumsum(counts)])] = True
    cut = heads.copy()
    cut[:-1] |= open_[codes]
    starts = np.flatnonzero(cut)
    ends, starts = starts[1:], starts[:-1]
    single = ends - starts == 1
    single_codes = codes[starts[single]]
    used = np.zeros(len(parts), bool)
    used[single_codes] = True
    used = np.flatnonzero(used)
    of_part = np.zeros(len(parts), np.int64)
    of_part[used] = table.places(parts if len(used) == len(parts) else [parts[i] for i in used.tolist()])
    chosen = np.empty(len(starts), np.int64)
    chosen[single] = of_part[single_codes]
    joined = ["".join([parts[c] for c in codes[a:b].tolist()]) for a, b in zip(starts[~single].tolist(), ends[~single].tolist())]
    distinct = dict.fromkeys(joined)
    places = dict(zip(distinct, table.places(list(distinct)).tolist()))
    chosen[~single] = [places[c] for c in joined]
    ids, sizes = table.ids(chosen)
    chunks = np.add.reduceat(cut[:-1].astype(np.int64), np.cumsum(counts) - counts) if len(counts) else counts
    ends_of = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *chunks.tolist()])]
    return ids, np.diff(ends_of)

"""A worker's bounded cache of the ids of recurring chunks of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` at ``starts`` of ``sizes`` entries, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class ChunkCache:
    """``learn`` gives the ids of new chunks in a row, and how many each has. Beyond ``limit``
    chunks everything is forgotten and learnt again when it is met."""

    def __init__(self, learn: Learn, limit: int):
        self._learn, self._limit = learn, limit
        self._forget()

    def _forget(self) -> None:
        self._codes: dict[str, int] = {}
        self._pool, self._filled = np.zeros(1 << 16, np.int32), 0
        self._starts, self._sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, chunks: list[str]) -> None:
        ids, sizes = self._learn(chunks)
        first, last = len(self._codes), len(self._codes) + len(chunks)
        total = self._filled + len(ids)
        if total > len(self._pool):
            self._pool = np.resize(self._pool, 2 * total)
        if last > len(self._starts):
            self._starts = np.resize(self._starts, 2 * last)
            self._sizes = np.resize(self._sizes, 2 * last)
        self._pool[self._filled:total] = ids
        self._starts[first:last] = np.cumsum(sizes) - sizes + self._filled
        self._sizes[first:last] = sizes
        self._filled = total
        self._codes.update(zip(chunks, range(first, last)))

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        new = [c for c in dict.fromkeys(chunks) if c not in self._codes]
        if new:
            if len(self._codes) + len(new) > self._limit:
                self._forget()
                new = list(dict.fromkeys(chunks))
            self._add(new)
        codes = np.fromiter(map(self._codes.__getitem__, chunks), np.int64, len(chunks))
        sizes = self._sizes[codes]
        return gather(self._pool, self._starts[codes], sizes), sizes


# Chunks that are looked up together.
TOGETHER = 1 << 17


def ids_of_texts(
    texts: Iterable[str], chunks_of: Callable[[str], Iterator[list[str]]], cache: ChunkCache,
    together: int = TOGETHER,
) -> list[np.ndarray]:
    """Ids of each text. ``chunks_of`` gives a text's chunks in lists of bounded size; those of
    many texts are looked up together, so that new ones are learnt many at a time."""
    parts: list[list[np.ndarray]] = []
    waiting: list[str] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        ids, sizes = cache.ids(waiting)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first = 0
        for text, count in owners:
            parts[text].append(ids[ends[first]:ends[first + count]])
            first += count
        waiting.clear()
        owners.clear()

    for number, text in enumerate(texts):
        parts.append([])
        for chunks in chunks_of(text):
            waiting += chunks
            owners.append((number, len(chunks)))
            if len(waiting) >= together:
                flush()
    flush()
    none = np.zeros(0, np.int32)
    return [p[0] if len(p) == 1 else np.concatenate([none, *p]) for p in parts]

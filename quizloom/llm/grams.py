"""Hashed words and parts of words of many texts at once.

A word is a run of ASCII letters, ASCII digits and characters beyond ASCII, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, np.uint64(0x100000001B3), np.uint64), dtype=np.uint64)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SLICE_CHARS = 1 << 21


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each hash, of 2 ** bits."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * _FACTOR
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTOR
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def slices(texts: Iterable[str], most: int = SLICE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and stretches of them, about ``most`` characters together. A longer text
    is cut at blanks."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for number, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > most:
                blank = text.find(" ", start + most)
                end = blank if blank >= 0 else end
            owners.append(number)
            parts.append(text[start:end])
            size += end - start
            if size >= most:
                yield owners, parts
                owners, parts, size = [], [], 0
            start = end
            if start >= len(text):
                break
    if parts:
        yield owners, parts


@dataclass
class Words:
    """Words of texts, end to end. ``data`` are their bytes without what stands between them, and
    ``sizes`` the bytes of each word; ``counts`` are the words of each text."""

    data: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\x00".join([*parts, b""]), np.uint8)
        inside = _IN_WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        first, last = edge[::2], edge[1::2]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        counts = np.diff(np.searchsorted(first, ends, "left"), prepend=0)
        return cls(data[inside], last - first, counts)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def place(self) -> np.ndarray:
        """Of each byte in its word."""
        return np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first bytes."""
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        place = self.place()
        terms = (self.data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & (len(_POWERS) - 1)]
        if first_bytes is not None:
            terms[place >= first_bytes] = 0
        return np.add.reduceat(terms, self.starts)

"""Fill-in-middle transformation by piece tables.

Text is never moved before it is written out. The texts of a batch lie end to end in one buffer of
UTF-8 bytes, the sentinels in another, and both stay as they are; a document is a row of
descriptors (buffer, start, length) in reading order. Cutting splits descriptors. An
arrangement permutes a document's pieces and puts sentinels between them; its inverse takes the
sentinels out and puts the pieces back. Hashes run over the bytes that descriptors point at, one
descriptor after the other, and writing out copies each byte once.

A unit is a run of ``[A-Za-z]`` or any other code point. A document of n units is cut after
the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units into prefix, middle and
suffix. It stays plain if it is empty, holds a sentinel, or ``h3 % 100`` is not below ``rate``; else it
becomes suffix, prefix, middle (spm) if ``h4 % 100`` is below ``spm_rate``, or prefix, suffix,
middle (psm). h1 to h4 are the first four groups of eight hexadecimal digits of the SHA-256 of
``<seed>:<key>``.

Defined results: a null text is empty, so plain with no units. Equal keys get equal numbers, and a
null key counts as an empty one, so results hang on key and text alone. Cuts may be equal or at an
end: pieces may be empty. Texts are never shortened; of one longer than a block only the blocks
that hold a cut are searched for it. Restoring a null text gives an empty one; a form that is neither
psm nor spm gives the text as it is; and a psm or spm text without its sentinels in their
order is an error. A column of the name of an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quizloom.llm.tables import column, cut_batch, for_arrow

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
# The order of a document's pieces (0 prefix, 1 middle, 2 suffix) and the sentinel before each.
ARRANGEMENTS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
RATE, SPM_RATE = 90, 20
NUMBERS = ("h1", "h2", "h3", "h4")
BATCH_BYTES = 4 << 20
BLOCK = 1 << 16


class Buffers:
    """The bytes that descriptors point at: buffer 0 is text, buffer 1 the sentinels."""

    def __init__(self, text: memoryview):
        sentinels = b"".join(SENTINELS)
        self.views = (text, memoryview(sentinels))
        self.sentinel = {s: (1, sentinels.index(s), len(s)) for s in SENTINELS}

    def hash(self, table: list[tuple[int, int, int]]) -> str:
        """SHA-256 of a document, read descriptor by descriptor."""
        running = hashlib.sha256()
        for buffer, start, length in table:
            running.update(self.views[buffer][start:start + length])
        return running.hexdigest()

    def write(self, table: list[tuple[int, int, int]]) -> bytes:
        return b"".join([self.views[buffer][start:start + length] for buffer, start, length in table])


def split(table: list[tuple[int, int, int]], place: int) -> int:
    """Splits the descriptor that holds byte ``place`` of the document, if it is inside one, and
    returns the number of the descriptor that starts there."""
    at = 0
    for number, (buffer, start, length) in enumerate(table):
        if place <= at:
            return number
        if place < at + length:
            cut = place - at
            table[number:number + 1] = [(buffer, start, cut), (buffer, start + cut, length - cut)]
            return number + 1
        at += length
    return len(table)


def cut(table: list[tuple[int, int, int]], places: list[int]) -> list[list[tuple[int, int, int]]]:
    """The descriptors between ascending places, of which some may be empty."""
    numbers = [split(table, place) for place in places]
    return [table[a:b] for a, b in zip([0, *numbers], [*numbers, len(table)])]


def arrange(buffers: Buffers, pieces: list[list[tuple[int, int, int]]], form: str) -> list[tuple[int, int, int]]:
    """Prefix, middle and suffix in the order of the form, with sentinels."""
    table = []
    for sentinel, piece in ARRANGEMENTS[form]:
        table.append(buffers.sentinel[sentinel])
        table += pieces[piece]
    return table


def restore(buffers: Buffers, table: list[tuple[int, int, int]], text: bytes, form: str) -> list[tuple[int, int, int]]:
    """The inverse: the descriptors of a written document ``text`` cut at its sentinels, put
    back in their first order without them."""
    ends, pieces, at = [], [], 0
    for sentinel, _ in ARRANGEMENTS[form]:
        place = text.find(sentinel, at)
        if place < 0 or (not ends and place):
            raise ValueError(f"a document of form {form} lacks {sentinel.decode()}")
        at = place + len(sentinel)
        ends += [place, at]
    pieces = cut(table, ends)[2::2]
    order = [piece for _, piece in ARRANGEMENTS[form]]
    return [d for piece in range(3) for d in pieces[order.index(piece)]]


class Units:
    """Units and code points of texts that lie end to end, counted by block."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """``ends`` are the places between texts, 0 and the end included."""
        letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
        self._point = (data & 0xC0) != 0x80
        self._unit = self._point.copy()
        self._unit[1:] &= ~(letter[1:] & letter[:-1])
        self._unit[ends[:-1][np.diff(ends) > 0]] = True
        self._ends = ends
        # Running counts at the ends of blocks.
        blocks = np.arange(0, len(data), BLOCK)
        self._units, self._points = (
            np.concatenate([[0], np.cumsum(np.add.reduceat(mask, blocks, dtype=np.int64))])
            if len(data) else np.zeros(1, np.int64)
            for mask in (self._unit, self._point)
        )
        self.before = self._count(self._unit, self._units, ends)

    @staticmethod
    def _count(mask: np.ndarray, running: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Marks before each place."""
        found, block = running[places // BLOCK], places // BLOCK
        for number in np.unique(block).tolist():
            inside = np.concatenate([[0], np.cumsum(mask[number * BLOCK:(number + 1) * BLOCK], dtype=np.int64)])
            own = block == number
            found[own] += inside[places[own] - number * BLOCK]
        return found

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before)

    def points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code points between places."""
        return self._count(self._point, self._points, ends) - self._count(self._point, self._points, starts)

    def places(self, units: np.ndarray) -> np.ndarray:
        """Byte place of a unit of each text, counted from 0; of the text's end for its number of units."""
        wanted = self.before[:-1] + units
        block = np.searchsorted(self._units, wanted, "right") - 1
        found = self._ends[1:].astype(np.int64)
        inside = units < self.counts()
        for number in np.unique(block[inside]).tolist():
            own = inside & (block == number)
            marks = np.flatnonzero(self._unit[number * BLOCK:(number + 1) * BLOCK])
            found[own] = marks[wanted[own] - self._units[number]] + number * BLOCK
        return found


def _bytes_of(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of all texts, null ones empty, and the places between them."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = whole.buffers()[2]
    view = memoryview(data)[offsets[0]:offsets[-1]] if data is not None else memoryview(b"")
    return view, offsets - offsets[0]


def numbers_of(key: Column, seed: int) -> list[Column]:
    """h1 to h4."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    df: DataFrame, key: str, text: str, *, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE,
    out: str = "output", keep_text: bool = True,
) -> DataFrame:
    """Adds ``out``, the transformed text, and n (units), form, prefix_chars and middle_chars (null
    if plain) and ``<out>_sha256``."""
    new = ["n", "form", "prefix_chars", "middle_chars", out, f"{out}_sha256"]
    kept = [c for c in df.columns if c not in new and (keep_text or c != text)]
    types = [LongType(), StringType(), LongType(), LongType(), StringType(), StringType()]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(n, t) for n, t in zip(new, types))])

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        view, ends = _bytes_of(batch["body"])
        buffers, units = Buffers(view), Units(np.frombuffer(view, np.uint8), ends)
        n = units.counts()
        h = [batch[c].to_numpy(zero_copy_only=False) for c in NUMBERS]
        first, second = h[0] % (n + 1), h[1] % (n + 1)
        low, high = units.places(np.minimum(first, second)), units.places(np.maximum(first, second))
        forms, hashes, written = [], [], []
        for row, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            whole = bytes(view[start:end])
            table = [(0, start, end - start)] if whole else []
            form = "spm" if h[3][row] % 100 < spm_rate else "psm"
            if not whole or h[2][row] % 100 >= rate or any(s in whole for s in SENTINELS):
                form = "plain"
            else:
                pieces = cut(table, [int(low[row]) - start, int(high[row]) - start])
                table = arrange(buffers, pieces, form)
            forms.append(form)
            hashes.append(buffers.hash(table))
            written.append(buffers.write(table))
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.RecordBatch.from_arrays([
            *batch.columns[:len(kept)], pa.array(n), pa.array(forms, pa.string()),
            pa.array(units.points(ends[:-1], low), mask=plain), pa.array(units.points(low, high), mask=plain),
            pa.array(written, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string()),
        ], names=[*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, "body", BATCH_BYTES):
                yield of_batch(part)

    numbers = dict(zip(NUMBERS, numbers_of(column(df, key), seed)))
    return for_arrow(df, kept, **numbers, body=column(df, text)).mapInArrow(run, schema)


def undo(
    df: DataFrame, text: str = "output", form: str = "form", *, out: str = "restored", keep_text: bool = True
) -> DataFrame:
    """Adds ``out``, the text from which the transformed ``text`` was made, and ``<out>_sha256``."""
    new = [out, f"{out}_sha256"]
    kept = [c for c in df.columns if c not in new and (keep_text or c != text)]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(n, StringType()) for n in new)])

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        view, ends = _bytes_of(batch["body"])
        buffers, hashes, written = Buffers(view), [], []
        for start, end, kind in zip(ends[:-1].tolist(), ends[1:].tolist(), batch["kind"].to_pylist()):
            table = [(0, start, end - start)]
            if kind in ARRANGEMENTS:
                table = restore(buffers, table, bytes(view[start:end]), kind)
            hashes.append(buffers.hash(table))
            written.append(buffers.write(table))
        return pa.RecordBatch.from_arrays([
            *batch.columns[:len(kept)], pa.array(written, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string()),
        ], names=[*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, "body", BATCH_BYTES):
                yield of_batch(part)

    return for_arrow(df, kept, kind=column(df, form), body=column(df, text)).mapInArrow(run, schema)
